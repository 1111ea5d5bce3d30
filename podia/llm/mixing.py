"""Mixing sources to target weights: fixed-length blocks, multinomial draws per output shard, permuted block indices."""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podia.llm.common import ROW, WHOLE, materialise, numbered, of_whole, small_batches, words_of
from podia.llm.feistel import permute, place_of

#: Weights of the sources by rank, repeating; no source gives more than EPOCHS times its size.
WEIGHTS, EPOCHS = (1.0, 2.0, 3.0), 3
#: Words of a block; the last block of a source has what is left.
BLOCK_WORDS = 512
#: Blocks of an output shard.
SHARD_BLOCKS = 4096
#: Rows of a source that one window sorts, about.
RUN_ROWS = 2_500


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """(id, source, size, digest, row): the number of words of each row's whole text, null 0, a hash of the text, and its number, from row_col if that is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = [len(words_of(t.as_py() or b"")) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count, pa.int64()), batch.column(3), batch.column(4)], ["id", "source", "size", "digest", "row"])

    small_batches(docs.sparkSession)
    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("digest"), (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("row"))
    return cols.mapInArrow(run, "id long, source string, size long, digest long, row long")


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight, target), one row a source.

    Sources in order of code points, null last, take the weights in turn and
    share the total of all sizes by weight. A target stops at `epochs` times
    the source's size; the excess is shared again by weight, until none is
    above. That end state is the level L at which the targets min(cap, L *
    weight) add up to the total: in order of cap / weight the first sources
    are capped, as many as lie below the level that the rest then have.

    The table of sources, not that of documents, is ordered in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name)).withColumn("weight", weight)
    per = per.withColumn("cap", (epochs * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("left_weight", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("level", F.col("left") / F.col("left_weight"))
    per = per.withColumn("place", F.row_number().over(by_ratio))
    free = F.col("ratio") >= F.col("level")
    level = F.min_by(F.when(free, F.col("level")), F.when(free, F.col("place"))).over(whole)
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", level * F.col("weight")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _plan(per_source: DataFrame, block_words: int, epochs: int = EPOCHS) -> DataFrame:
    """targets() with the number of blocks and the words wanted of each source: its target in whole words."""
    per = per_source.withColumn("block_words", F.lit(block_words).cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    return per.withColumn("wanted", F.least(F.round("target").cast("long"), epochs * F.col("source_size")))


def last_draw(wanted: int, size: int, blocks: int, block_words: int, key: int) -> tuple[int, int]:
    """The number of draws that give a source's wanted words, and how many words the last of them gives.

    Each epoch gives all blocks once, in the order of its permutation; the
    source's last block is shorter, so it matters where in the order it stands.
    """
    epoch, rest = divmod(wanted, size)
    if not rest:
        return epoch * blocks, block_words
    tail = size - (blocks - 1) * block_words
    draws = -(-rest // block_words)
    before = (draws - 1) * block_words
    if (at := place_of(blocks - 1, blocks, key + epoch)) < draws:
        draws = -(-(rest - tail) // block_words) + 1
        before = (draws - 1) * block_words - (block_words - tail if at < draws - 1 else 0)
    return epoch * blocks + draws, rest - before


def _pieces(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, block, at, row, id, from_word, words): the stretch of each document in each block of its source's stream, at that place of the block.

    The stream has a source's documents in runs: a keyed hash deals the rows of
    a large source to as many runs as keep a run near RUN_ROWS, and each run is
    in order of id and text; so a source with most of the rows is no single task's work.
    """
    counts = rows.groupBy("source").agg(F.count("*").alias("rows"))
    runs = plan.join(counts, plan["source"].eqNullSafe(counts["source"])).select(plan["source"].alias("s"), "block_words", F.ceil(F.col("rows") / RUN_ROWS).cast("long").alias("runs"))
    dealt = rows.join(runs, rows["source"].eqNullSafe(runs["s"])).drop("s").withColumn("run", F.pmod(F.xxhash64("id", "digest", F.lit("run")), F.col("runs")))
    in_run = Window.partitionBy("source", "run").orderBy(F.col("id").asc_nulls_last(), "digest", "row")
    local = dealt.withColumn("end", F.sum("size").over(in_run))
    start = dealt.groupBy("source", "run").agg(F.sum("size").alias("words"))
    start = start.withColumn("base", F.sum("words").over(Window.partitionBy("source").orderBy("run")) - F.col("words")).select(F.col("source").alias("s"), F.col("run").alias("r"), "base")
    placed = local.join(start, local["source"].eqNullSafe(start["s"]) & (local["run"] == start["r"])).withColumn("stop", F.col("base") + F.col("end")).withColumn("start", F.col("stop") - F.col("size"))
    first, last = F.floor(F.col("start") / F.col("block_words")), F.floor((F.col("stop") - 1) / F.col("block_words"))
    cut = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    lo, hi = F.greatest("start", F.col("block") * F.col("block_words")), F.least("stop", (F.col("block") + 1) * F.col("block_words"))
    return cut.select("source", "block", (lo - F.col("block") * F.col("block_words")).alias("at"), "row", "id", (lo - F.col("start")).alias("from_word"), (hi - lo).alias("words"))


def slots(plan: DataFrame, shard_blocks: int = SHARD_BLOCKS, seed: int = 7) -> DataFrame:
    """(shard, source, slot, block, epoch, most): the mix, one row for each drawn block, of which it takes `most` words.

    Each output shard's counts by source are multinomial draws, given that a
    source's draws add up to its target: so its draws are spread over the
    shards by one multinomial draw. The n-th slot of a source maps through the
    permutation of its blocks that its name, the seed and the epoch n div
    blocks name; so no block comes again before all have come. The last draw of
    a source is cut where its target is reached.
    """
    per = plan.filter("wanted > 0").select("source", "source_size", "blocks", "block_words", "wanted", F.xxhash64("source", F.lit(seed)).alias("key"))
    about = F.ceil(F.col("wanted") / F.col("block_words")) + F.ceil(F.col("wanted") / F.col("source_size")) + 1  # draws at most: each epoch has one short block
    total = per.agg(F.sum(about)).first()[0] or 0
    shards = max(1, -(-total // shard_blocks))
    # Each stretch of a source's draws is a row, so that a large source is many tasks' work.
    per = per.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((about - 1) / 65536)))).repartition("source", "stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                draws, last = last_draw(r["wanted"], r["source_size"], r["blocks"], r["block_words"], r["key"])
                lo, hi = r["stretch"] * 65536, min(draws, (r["stretch"] + 1) * 65536)
                if lo >= hi:
                    continue
                rng = np.random.default_rng([r["key"] & (1 << 63) - 1, r["stretch"], seed])
                shard = np.sort(rng.integers(0, shards, hi - lo))  # as many of each shard as a multinomial draw gives
                n = np.arange(lo, hi)
                epoch = n // r["blocks"]
                block = np.concatenate([permute(n[epoch == e] % r["blocks"], r["blocks"], r["key"] + int(e)) for e in range(int(epoch[0]), int(epoch[-1]) + 1)])
                most = np.where(n == draws - 1, last, r["block_words"])
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array([r["source"]] * len(n), pa.string()), pa.array(n), pa.array(block), pa.array(epoch), pa.array(most)], ["shard", "source", "slot", "block", "epoch", "most"])

    return per.mapInArrow(run, "shard long, source string, slot long, block long, epoch long, most long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, seed: int = 7, row_col: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parts of a mix: rows (id, row, source, size), the plan by source, and drawn pieces.

    Drawn pieces are (shard, source, slot, epoch, block, at, row, id, from_word,
    words): the blocks of each shard joined by index with the documents' stretches.
    Null sources are a source of their own, last in order; null or empty texts
    have size 0 and no pieces; repeated rows are documents of their own, told
    apart by `row`; an empty table gives empty parts.
    """
    rows = materialise(sizes(docs, id_col, text_col, source_col, row_col), "sizes")
    plan = materialise(_plan(targets(rows, weights), block_words), "plan")
    pieces = _pieces(rows, plan)
    drawn = slots(plan, seed=seed).withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    # Both grow with the corpus, the draws unseen by the optimiser's estimate: never broadcast.
    drawn = drawn.join(pieces.hint("merge"), drawn["s"].eqNullSafe(pieces["source"]) & (drawn["b"] == pieces["block"])).drop("s", "b")
    drawn = drawn.withColumn("words", F.least("words", F.col("most") - F.col("at"))).filter("words > 0").drop("most")
    return rows, plan, drawn


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, and taken, the words that the mix takes of it."""
    rows, plan, drawn = mix(docs, id_col, text_col, source_col, seed=seed)
    taken = drawn.groupBy("row").agg(F.sum("words").alias("taken"))
    plan = plan.select(F.col("source").alias("s"), "source_size", "target")
    out = rows.join(plan, rows["source"].eqNullSafe(plan["s"])).join(taken, "row", "left")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cuts(text: str, pieces: list[tuple[int, int]]) -> list[str]:
    """The stretches (from_word, words) of a text, one by one."""
    spans = [m.span() for m in _WORD.finditer(text)]
    return [text[spans[lo][0] : spans[lo + n - 1][1]] for lo, n in pieces]


def cut(text: str, pieces: list[tuple[int, int, int]]) -> str:
    """The words of the pieces (epoch, from_word, words), in this order; neighbours in an epoch keep the white space between them."""
    runs: list[list[int]] = []
    for epoch, start, n in sorted(pieces):
        if runs and runs[-1][0] == epoch and runs[-1][2] == start:
            runs[-1][2] += n
        else:
            runs.append([epoch, start, start + n])
    spans = [m.span() for m in _WORD.finditer(text)]
    whole = [text if (lo, hi) == (0, len(spans)) else text[spans[lo][0] : spans[hi - 1][1]] for _, lo, hi in runs]
    return "\n".join(whole)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", seed: int = 7) -> DataFrame:
    """The mix as documents: each with just the words that the mix takes of it, repeats included, and its new length.

    Documents of which nothing is taken go; the other columns stay. Rows are
    told apart by numbers written once, so repeated rows each have what is
    taken of them. The pieces of a document are gathered; they are as many as
    its blocks, thrice at most.
    """
    rows = numbered(docs, "mix-rows")
    drawn = _drawn(rows, id_col, text_col, source_col, seed)
    pieces = drawn.groupBy("row").agg(F.collect_list(F.struct("epoch", "from_word", "words")).alias("pieces"))

    @F.pandas_udf("string")
    def taken(texts: pd.Series, pieces: pd.Series) -> pd.Series:
        return pd.Series([cut(t, [(p["epoch"], p["from_word"], p["words"]) for p in own]) for t, own in zip(texts, pieces, strict=True)])

    met = rows.join(pieces, F.col(ROW) == F.col("row")).select(WHOLE, taken(of_whole(text_col).cast("string"), "pieces").alias("text"))
    new = {text_col: F.col("text")}
    if length_col in docs.columns:
        new[length_col] = F.length("text").cast(dict(docs.dtypes)[length_col])
    return met.select(*[new.get(c, of_whole(c)).alias(c) for c in docs.columns])


def _drawn(rows: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """The drawn pieces of numbered rows."""
    cols = rows.select(ROW, of_whole(id_col).alias("id"), of_whole(text_col).alias("text"), of_whole(source_col).alias("source"))
    return mix(cols, "id", "text", "source", seed=seed, row_col=ROW)[2]


def write_mix(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> None:
    """Write the mix by shard: Parquet under path/shard=N with (source, slot, at, id, text), in a pseudorandom order of slots.

    Each row is a document's stretch of a drawn block; the rows of a slot, in
    order of `at`, are the block. Stretches are cut document by document, so
    that no text is sent more than once. Null texts have no stretches.
    """
    rows = numbered(docs.select(id_col, text_col, source_col), "mix-rows")
    pieces = _drawn(rows, id_col, text_col, source_col, seed).groupBy("row").agg(F.collect_list(F.struct("shard", "slot", "at", "from_word", "words")).alias("pieces"))

    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series, pieces: pd.Series) -> pd.Series:
        return pd.Series([cuts(t, [(p["from_word"], p["words"]) for p in own]) for t, own in zip(texts, pieces, strict=True)])

    own = rows.join(pieces, F.col(ROW) == F.col("row")).withColumn("parts", parts(of_whole(text_col).cast("string"), "pieces"))
    own = own.select(of_whole(source_col).alias("source"), of_whole(id_col).alias("id"), F.explode(F.arrays_zip("pieces", "parts")).alias("p"))
    own = own.select("source", "p.pieces.slot", "p.pieces.at", "id", F.col("p.parts").alias("text"), "p.pieces.shard")
    shuffled = own.repartition("shard").sortWithinPartitions("shard", F.xxhash64("source", "slot", F.lit(seed)), "source", "slot", "at")
    shuffled.write.partitionBy("shard").parquet(path)

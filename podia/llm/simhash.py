"""SimHash near-dedup with Golay-code fuzzy keys: segments decoded to nearby codewords, joined, verified, linked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podia.llm import golay
from podia.llm.common import ROW, few, materialise, numbered, of_whole, one_of_each, small_batches, sweep
from podia.llm.components import components

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Bits of the three segments of a fingerprint, low to high.
SEGMENTS = (23, 23, 18)
#: Fingerprints compared at once in one task; larger buckets are dealt out in blocks of this size.
BLOCK = 2048


def fingerprint(data: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; 0 without words.

    A-Z count as a-z. Texts with fewer words than a shingle have one shingle,
    all of them. A bit is set if it is set in over half of the XXH64 hashes.
    """
    words = data.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    end = start + size
    k = min(shingle, len(words))
    start, end = start[: len(words) - k + 1].tolist(), end[k - 1 :].tolist()
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(start), 1 << 16):
        hashes = np.array([digest(line[s:e], seed) for s, e in zip(start[at : at + (1 << 16)], end[at : at + (1 << 16)], strict=True)], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(start), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    small_batches(docs.sparkSession)
    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cols.mapInArrow(run, "id long, fp long")


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of uint64 fingerprints, and the place in fps of each key's fingerprint.

    Any two fingerprints that differ in 4 bits or fewer share a key. By the
    pigeonhole principle over three segments, either
    - a segment is equal, and one of the other two differs in 2 bits or fewer:
      key of the equal segment and of each codeword near the other, for all
      six choices; or
    - each segment differs, in 2 bits at most: key of a codeword near the
      first, one near the second, and a third of the last segment, of whose
      three thirds one is equal.
    """
    shifts = np.cumsum((0, *SEGMENTS[:-1]))
    part = [((fps >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in zip(shifts, SEGMENTS, strict=True)]
    near = [golay.nearby(p) for p in part]
    keys, places = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                word, there = near[j]
                keys.append(((np.int64(3 * i + j) << 56) | (part[i][:, None] << 12) | word)[there])
                places.append(np.nonzero(there)[0])
    both = near[0][1][:, :, None] & near[1][1][:, None, :]
    pair = (near[0][0][:, :, None] << 12) | near[1][0][:, None, :]
    third = SEGMENTS[2] // 3
    for i in range(3):
        own = (part[2] >> (third * i)) & ((1 << third) - 1)
        keys.append(((np.int64(9 + i) << 56) | (own << 24)[:, None, None] | pair)[both])
        places.append(np.nonzero(both)[0])
    return np.concatenate(keys), np.concatenate(places)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
            keys, places = fuzzy_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[places])], ["key", "fp"])


def _group_links(fps: np.ndarray, roots: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Pairs of roots that a pair of near fingerprints joins: as few as link them, not all pairs."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    bits = fps.view(np.uint64)
    for at in range(0, len(bits), 256):
        close = (np.bitwise_count(bits[at : at + 256, None] ^ bits[None, :]) <= distance) & (roots[at : at + 256, None] != roots[None, :])
        for i, j in zip(*np.nonzero(close), strict=True):
            a, b = top(int(roots[at + i])), top(int(roots[j]))
            if a != b:
                up[max(a, b)] = min(a, b)
                yield max(a, b), min(a, b)


def _block_links(distance: int):
    """Of rows (key, lo, hi, fp, root), sorted by the first three: the links within each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in _with_end(batches):
            new = None if batch is None else np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows = new if rest is None else rest if new is None else np.concatenate([rest, new])
            if rows is None or not len(rows):
                continue
            change = np.nonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1))[0] + 1
            bounds = [0, *change.tolist(), len(rows)]
            last = len(bounds) - 1 if new is None else len(bounds) - 2
            links = [x for s, e in zip(bounds[:last], bounds[1 : last + 1], strict=True) for x in _group_links(rows[s:e, 3].copy(), rows[s:e, 4], distance)]
            rest = rows[bounds[last] :]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(id, fingerprint, component_id): fingerprints at 4 differing bits or fewer link; a component has its smallest id.

    Rows with equal fingerprints are one node, so copies never meet in pairs.
    Each distinct fingerprint has about 115 fuzzy keys; what shares a key is
    first linked to the key's smallest fingerprint, one row each. Only keys
    whose fingerprints are then still in several components are compared
    further, in blocks of bounded size, giving as few links as join them.

    Null or empty texts have fingerprint 0 and link like any other. A null id
    is never a component_id unless all of its component are null. Repeated
    rows come out as often as they went in. An empty table gives an empty
    result; other columns of docs are ignored.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    by_key = Window.partitionBy("key")
    keyed = nodes.select("fp").mapInArrow(_key_rows, "key long, fp long")
    keyed = keyed.withColumn("low", F.min("fp").over(by_key)).withColumn("n", F.count("*").over(by_key)).filter("n > 1")
    keyed = materialise(keyed, "shared-keys")

    to_low = keyed.filter((F.col("fp") != F.col("low")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("low"))) <= DISTANCE))
    first = components(to_low.select(F.col("fp").alias("a"), F.col("low").alias("b")))

    many = keyed.filter("n > 2").select("key", "fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_ = many.withColumn("least", F.min("root").over(by_key)).withColumn("most", F.max("root").over(by_key)).withColumn("n", F.count("*").over(by_key)).filter("least <> most")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = open_.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").cast("long").alias("lo"), F.greatest("own", "other").cast("long").alias("hi"), "fp", "root")
    more = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(_block_links(DISTANCE), "a long, b long")
    second = components(more)

    roots = first.join(second.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = second.join(first.select("node"), "node", "left_anti")
    linked = nodes.join(roots.unionByName(alone).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = materialise(linked, "linked")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    answer = linked.join(least, "root").select("fp", "component_id")
    return rows.join(answer, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(data: bytes, shingle: int, seed: int = SEED) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's word shingles; A-Z count as a-z, fewer words are one shingle."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(shingle, len(words))
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    end = (start + size)[k - 1 :].tolist()
    start = start[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[s:e], seed) for s, e in zip(start, end, strict=True)), np.uint64, len(start)))


def set_fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of distinct shingle hashes: repeated lines weigh no more than others."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


#: Bands of minimum hashes, and hashes in each: at similarity 0.8 all but one pair in 1,500 share a band.
BANDS, BAND_ROWS = 40, 8
_DRAWN = np.random.default_rng(SEED)
_FACTORS = _DRAWN.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _DRAWN.integers(0, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band: two sets share a band's key with probability similarity ** BAND_ROWS; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[None, at : at + 1024] * _FACTORS[:, None] + _OFFSETS[:, None]).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def _sketches(shingle: int):
    """Of rows (number, text): a digest of the shingle set, its size, its fingerprint and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for text in batch.column(1).cast(pa.binary()):
                hashes = shingle_hashes(text.as_py() or b"", shingle)
                sets.append((xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes), set_fingerprint(hashes), band_keys(hashes)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([x[0] for x in sets], pa.binary()),
                    pa.array([x[1] for x in sets], pa.int64()),
                    pa.array(np.array([x[2] for x in sets], np.uint64).view(np.int64)),
                    pa.array([x[3] for x in sets], pa.list_(pa.int64())),
                ],
                [ROW, "digest", "n", "fp", "bands"],
            )

    return run


def _sets(shingle: int):
    """Of rows (node, text): the node's shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_hashes(t.as_py() or b"", shingle).view(np.int64) for t in part.column(1).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "hashes"])

    return run


def _node_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Golay keys of each node's fingerprint, and its band keys, which are negative."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            node, fp, bands = batch.slice(at, 4096).columns
            keys, places = fuzzy_keys(fp.to_numpy(zero_copy_only=False).view(np.uint64))
            places = np.concatenate([places, pa.compute.list_parent_indices(bands).to_numpy(zero_copy_only=False)])
            keys = np.concatenate([keys, pa.compute.list_flatten(bands).to_numpy(zero_copy_only=False) | np.int64(-1 << 63)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), node.take(pa.array(places))], ["key", "node"])


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least similarity."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _several_roots(keyed: DataFrame) -> DataFrame:
    """The rows (key, root, ...) of keys that hold several roots."""
    by_key = Window.partitionBy("key")
    return keyed.withColumn("least", F.min("root").over(by_key)).withColumn("most", F.max("root").over(by_key)).filter("least <> most").drop("least", "most")


def _shared_by_two(sets: DataFrame) -> DataFrame:
    """(a, b, rare): how many hashes just the sets of nodes a and b have; with a = b, those that one set alone has."""
    by_hash = sets.select("node", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("c"), F.min("node").alias("a"), F.max("node").alias("b"))
    return by_hash.filter("c <= 2").groupBy("a", "b").agg(F.count("*").alias("rare"))


def _hopeful(keyed: DataFrame, rare: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """keyed (key, band, node, n, own, root, ...) without the rows that can link with nothing of their band key, and
    the pairs (a, b) that rare allows, to be compared apart; in rows of band keys, own is how many hashes of a node rare counts.

    Of its n hashes a set shares n - own at most with one that rare has no pair of; so with a set of m it has a
    similarity of (n - own) / (own + m) at most, m being the key's least size or n - own. So edited copies of one text
    that are too far from each other don't meet in pairs. rare is _shared_by_two of all nodes in band keys.
    """
    own = rare.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("node"), "rare").groupBy("node").agg(F.sum("rare").alias("counted"))
    known = keyed.join(own, "node", "left").withColumn("own", F.when(F.col("band"), F.coalesce("counted", F.lit(0))).otherwise(F.col("own"))).drop("counted")
    most = F.col("n") - F.col("own")
    rows = known.withColumn("least", F.min("n").over(Window.partitionBy("key")))
    rows = rows.filter(~F.col("band") | (most >= F.lit(similarity) * (F.col("own") + F.greatest("least", most)))).drop("least")
    each = known.filter("band").select("node", F.struct("n", "own", "root").alias("s")).distinct()
    met = rare.filter("a < b").join(each.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(each.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    both = F.least(F.col("x.n") - F.col("x.own"), F.col("y.n") - F.col("y.own")) + F.col("rare")
    met = met.filter((F.col("x.root") != F.col("y.root")) & (both >= F.lit(similarity) * (F.col("x.n") + F.col("y.n") - both)))
    return rows, met.select("a", "b")


def similar_groups(rows: DataFrame, text_col: str, shingle: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """(ROW, component_id) of numbered rows: texts whose sets of word shingles have a Jaccard similarity of at least
    similarity link; a component is named by the number of one of its rows.

    Candidates share a Golay key of the sets' SimHash (exact for 4 bits) or one
    of BANDS keys of minimum hashes; each link is verified on the whole sets.
    Rows with equal sets are one node. What shares a key is first compared with
    two of the key's nodes, and after each what can link with nothing of a
    band key leaves it (_hopeful); only keys whose nodes are then still in several
    components are compared pair by pair, in blocks.
    """
    spark = rows.sparkSession
    small_batches(rows.sparkSession)
    texts = rows.select(ROW, F.col(text_col).cast("string").alias("text"))
    sketch = texts.mapInArrow(_sketches(shingle), f"{ROW} long, digest binary, n long, fp long, bands array<long>")
    sketch = materialise(sketch, "sketches")
    nodes = sketch.groupBy("digest").agg(F.min(ROW).alias("node"))
    of_row = materialise(sketch.select(ROW, "digest").join(nodes, "digest").select(ROW, "node"), "nodes")
    single = sketch.join(of_row.filter(F.col(ROW) == F.col("node")).select(ROW), ROW).select(F.col(ROW).alias("node"), "n", "fp", "bands")
    by_key = Window.partitionBy("key")
    keyed = single.select("node", "fp", "bands").mapInArrow(_node_keys, "key long, node long")
    keyed = materialise(keyed.withColumn("many", F.count("*").over(by_key)).filter("many > 1").drop("many"), "shared-keys")
    keyed = keyed.join(single.select("node", "n", "fp"), "node").withColumns({"band": F.col("key") < 0, "own": F.lit(0).cast("long")})
    keyed = materialise(keyed, "shared-nodes")
    sweep(spark)
    parts = ("node", "n", "fp", "own", "root")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs that are alike; only what is in a pair has its set made, so that keys shared by chance cost no set."""
        pairs = materialise(pairs, "pairs")
        paired = few(pairs.select(F.col("a").alias(ROW)).unionByName(pairs.select(F.col("b").alias(ROW))).distinct(), "paired-nodes")
        sets = materialise(texts.join(paired, ROW, "left_semi").mapInArrow(_sets(shingle), "node long, hashes array<long>"), "shingle-sets")
        return materialise(_alike(pairs, sets, similarity), "links")

    def may(left: str, right: str) -> Column:
        """Whether sizes, without hashes that just two sets have (what these allow is met), allow the similarity and, for Golay keys, the fingerprints are near."""
        most = F.least(F.col(f"{left}.n") - F.col(f"{left}.own"), F.col(f"{right}.n") - F.col(f"{right}.own"))
        size = most >= F.lit(similarity) * (F.col(f"{left}.n") + F.col(f"{right}.n") - most)
        return size & (F.col("band") | (F.bit_count(F.col(f"{left}.fp").bitwiseXOR(F.col(f"{right}.fp"))) <= DISTANCE))

    links, met, open_ = None, None, keyed.withColumn("root", F.col("node"))
    for turn in range(2):
        order = F.struct((F.col("own") / F.col("n")).alias("share"), F.xxhash64("node", F.lit(turn)).alias("h"), *parts)  # first by chance, then what edited copies come from
        star = open_.select("key", "band", F.struct(*parts).alias("one"), F.min(order).over(by_key).alias("hub"))
        star = star.filter((F.col("one.root") != F.col("hub.root")) & may("one", "hub"))
        star = star.select(F.least("one.node", "hub.node").alias("a"), F.greatest("one.node", "hub.node").alias("b"))
        found = verified((star if met is None else star.unionByName(met)).distinct())
        links = found if links is None else links.unionByName(found)
        roots = components(links)
        open_ = keyed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = materialise(_several_roots(open_), "open-keys")
        sweep(spark)
        banded = few(open_.filter("band").select(F.col("node").alias(ROW)).distinct(), "banded-nodes")
        sets = texts.join(banded, ROW, "left_semi").mapInArrow(_sets(shingle), "node long, hashes array<long>")
        rare = materialise(_shared_by_two(sets), "rare-shingles")
        hopeful, met = _hopeful(open_, rare, similarity)
        open_, met = materialise(_several_roots(hopeful), "hopeful-keys"), materialise(met, "met-pairs")
        keyed = open_.drop("root")
        sweep(spark)

    dealt = open_.withColumn("blocks", F.ceil(F.count("*").over(by_key) / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    here = dealt.select("key", F.col("own").alias("block"), F.struct(*parts).alias("one"))
    there = dealt.select("key", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.struct(*parts).alias("hub"))
    pairs = here.join(there, ["key", "block"]).filter((F.col("one.node") < F.col("hub.node")) & (F.col("one.root") != F.col("hub.root")) & may("one", "hub"))
    pairs = pairs.select(F.col("one.node").alias("a"), F.col("hub.node").alias("b")).unionByName(met).distinct()
    roots = components(links.unionByName(verified(pairs)))
    linked = of_row.join(roots, "node", "left").select(ROW, F.coalesce("root", "node").alias("component_id"))
    return linked


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with just one row of each group of similar_groups: one with the smallest non-null id.

    Rows are told apart by numbers written once, so null and repeated ids do no
    harm. Texts without words are alike. All columns stay as they are, whatever their names.
    """
    rows = numbered(docs, "near-rows")
    groups = similar_groups(rows.select(ROW, of_whole(text_col).alias("text")), "text", shingle, similarity).select(ROW, F.col("component_id").alias("group"))
    groups = materialise(groups, "near-groups")
    several = groups.groupBy("group").agg(F.count("*").alias("c")).filter("c > 1").select("group")
    named = groups.join(several, "group", "left_semi").join(rows.select(ROW, of_whole(id_col).alias("id")), ROW)
    return one_of_each(rows, materialise(named, "near-named"))

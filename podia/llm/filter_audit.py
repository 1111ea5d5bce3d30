"""Filter interaction audit: every order of a set of filters replayed over the flags of all documents."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podia.llm.common import materialise, small_batches

#: The filters of flags(), in the order of their bits.
FILTERS = "ABCDE"
#: Failure conditions: fewer words, a lesser share of distinct words, a greater share of A-Z, one of these characters.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, ODD = 200, 50, 3, b"#$%&*|"
#: Rows of a large group of equal texts, and how many such groups there are at most: the bound of what is broadcast.
LARGE_ROWS, MAX_LARGE = 1000, 100_000

_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_INNER_BYTES = bytes(range(0x80, 0xC0))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text whose words are held at once; what is kept of earlier ones is the set of distinct words.
PIECE = 1 << 20


def _pieces(data: bytes) -> Iterator[bytes]:
    """data cut at white space into pieces of about PIECE bytes."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE)
        end = cut.end() if cut else len(data)
        yield data[at:end]
        at = end


def text_mask(data: bytes) -> int:
    """Bits 0 to 3 of a UTF-8 text: whether it fails A, B, C and D."""
    n, distinct = 0, set()
    for piece in _pieces(data):
        words = piece.split()
        n += len(words)
        distinct.update(words)
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    points = len(data.translate(None, _INNER_BYTES))
    fails = (n < MIN_WORDS, 100 * len(distinct) < MIN_DISTINCT_PERCENT * n, 100 * capitals > MAX_CAPITAL_PERCENT * points, len(data.translate(None, ODD)) < len(data))
    return sum(bit << i for i, bit in enumerate(fails))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, digests = [], []
        for text in batch.column(2).cast(pa.binary()):
            data = text.as_py() or b""
            masks.append(text_mask(data))
            digests.append(hashlib.sha256(data).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "sha"])


def flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic), one row per row of docs: the filters that its whole text fails, and its labels.

    Bit i of mask is the i-th of FILTERS: A few words, B repeated words, C
    capitals, D odd characters, E a text equal to that of a smaller id, in any
    part. A null text is empty, so it fails A alone, and E behind another
    empty one; a null part is the empty string. A row without an id is
    no one's smaller, has none smaller, and no labels; rows that repeat an
    id are rows of their own, none before the other. labels (the id, quality, toxic) may
    repeat an id: good if one of its rows has quality 1, toxic likewise.
    Empty tables give an empty result; other columns are ignored.

    Texts are read once and never shuffled, only their digests (SHA-256). The
    first id of equal texts is a partial aggregate; large groups meet it by a
    broadcast, of MAX_LARGE rows at most, so that no group is one task's work.
    """
    small_batches(docs.sparkSession)
    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).cast("string").alias("text"))
    rows = materialise(cols.mapInArrow(_features, "id long, part string, mask int, sha binary"), "audit-rows")
    firsts = rows.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("size")).filter("size > 1")
    firsts = materialise(firsts, "audit-firsts")
    large = F.col("size") >= max(LARGE_ROWS, -(-rows.count() // MAX_LARGE))
    hot = F.broadcast(firsts.filter(large))
    met = rows.join(hot, "sha", "left_anti").join(firsts.filter(~large), "sha", "left").unionByName(rows.join(hot, "sha"))
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    met = met.select("id", "part", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"))

    said = labels.select(F.col(id_col).cast("long").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    said = said.filter("id is not null").groupBy("id").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic"))
    named = met.filter("id is not null").join(said, "id", "left")
    nameless = met.filter("id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    no = F.lit(False)
    return named.unionByName(nameless).select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def orders(spark, filters: str = FILTERS) -> DataFrame:
    """(filter_order, bits): every order of the filters, and the bits of their masks in that order."""
    if not 1 <= len(filters) <= 6 or len(set(filters)) < len(filters):
        raise ValueError("between one and six different letters, as all their orders are broadcast")
    rows = [("".join(order), [1 << filters.index(x) for x in order]) for order in permutations(filters)]
    return spark.createDataFrame(rows, "filter_order string, bits array<int>")


def replay(flagged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """What each filter does at each place of each order, by part of flagged (part, mask, good, toxic).

    Columns: part, filter_order, step, kept (after the step), removed (by it),
    redundant (failing its filter, removed earlier), unique_fails (failing its
    filter alone), good_lost, toxic_lost (of the removed), shapley (what the filter
    removes, summed over all orders). Every part has a row for each step of each order.

    Documents of a part with the same flags and labels are one row with their
    number, combined before they are shuffled. These rows meet every order, a broadcast
    of at most 720 rows; the first failure there is computed once and then seen from each step.
    """
    flagged = flagged.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("documents"))
    table = F.broadcast(orders(flagged.sparkSession, filters))
    n = len(filters)

    def fails(k: int) -> Column:
        return F.col("mask").bitwiseAND(F.col("bits")[k]) != 0

    first = F.coalesce(*[F.when(fails(k), k + 1) for k in range(n)], F.lit(n + 1))
    runs = flagged.crossJoin(table).select(*flagged.columns, "filter_order", "bits", first.alias("first"))
    steps = runs.select(*flagged.columns, "filter_order", "first", F.posexplode("bits").alias("place", "bit"))
    step, bit, first = F.col("place") + 1, F.col("bit"), F.col("first")
    here = first == step

    def total(which: Column) -> Column:
        return F.sum(F.when(which, F.col("documents")).otherwise(0))

    counts = steps.groupBy("part", "filter_order", step.alias("step")).agg(
        total(first > step).alias("kept"),
        total(here).alias("removed"),
        total((F.col("mask").bitwiseAND(bit) != 0) & (first < step)).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"),
        total(here & F.col("good")).alias("good_lost"),
        total(here & F.col("toxic")).alias("toxic_lost"),
    )
    own = Window.partitionBy("part", F.expr("substring(filter_order, step, 1)"))
    return counts.withColumn("shapley", F.sum("removed").over(own))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """replay() over the flags of all docs."""
    return replay(flags(docs, labels, id_col, text_col, part_col))

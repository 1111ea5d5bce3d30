"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podia.llm.common import ROW, SPACE_RUN, few, materialise, numbered, of_whole, one_of_each

PREFIX_CHARS = 256
#: Rows of a large group of copies, and how many such groups there are at most: the bound of what is broadcast.
LARGE_ROWS, MAX_LARGE = 1000, 100_000


def normalised(text: Column) -> Column:
    """Each run of white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Round one keeps the length of the normalised text and groups by it; round
    two groups what shares a length by the hash of a prefix; only groups that
    survive both are read in full and hashed (SHA-256). With digest_all the
    caller wants every row's digest, so that the same scan hashes all texts;
    grouping is refined in the same three rounds. Without it text_sha256 is null for rows
    whose text was never contested.

    Only id, length and hashes are shuffled, never texts, except that without
    digest_all texts meet the contested ids if these are too many to broadcast. Copies are aggregated before
    they are shuffled; rows of groups of over LARGE_ROWS copies, of which there
    are MAX_LARGE at most, learn their keep_id by a broadcast.

    Null or empty text: equal to each other. Null id: a row like any other;
    keep_id is the smallest non-null id of the group (null if none). Rows that
    repeat an id and a text count each in group_size and get the same answer.
    An empty table gives an empty result; other columns of docs are ignored.
    """
    text = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("text"))
    narrow = [F.col("id"), F.length("text").alias("n"), F.xxhash64(F.substring("text", 1, prefix_chars)).alias("prefix")]
    if digest_all:
        narrow.append(F.unhex(F.sha2("text", 256)).alias("sha"))
    rows = materialise(text.select(*narrow), "dedup-keys")

    per_prefix = rows.groupBy("n", "prefix").agg(F.count("*").alias("c"))
    by_length = per_prefix.groupBy("n").agg(F.sum("c").alias("c")).filter("c > 1").drop("c")
    open_ = per_prefix.filter("c > 1").drop("c").join(by_length, "n", "left_semi")
    if digest_all:
        texts = rows.groupBy("n", "prefix", "sha").agg(F.min("id").alias("keep_id"), F.count("*").alias("size"))
        groups = texts.join(open_, ["n", "prefix"], "left_semi")
    else:
        contested = few(rows.join(open_, ["n", "prefix"], "left_semi").select(F.col("id").alias("other")), "contested")
        sha = text.join(contested, F.col("id").eqNullSafe(F.col("other")), "left_semi").select("id", F.length("text").alias("n"), F.unhex(F.sha2("text", 256)).alias("sha"))
        sha = materialise(sha, "dedup-sha")
        groups = sha.groupBy("n", "sha").agg(F.min("id").alias("keep_id"), F.count("*").alias("size"))
        free = rows.join(contested, F.col("id").eqNullSafe(F.col("other")), "left_anti").select("id", "n", F.lit(None).cast("binary").alias("sha"))
        rows = sha.unionByName(free)
    groups = materialise(groups.filter("size > 1").select("n", "sha", "keep_id", "size"), "dedup-groups")
    # What has a large group's key is met by broadcast, so that no group is one task's work; the others are met by a shuffle.
    large = F.col("size") >= max(LARGE_ROWS, -(-rows.count() // MAX_LARGE))
    hot = F.broadcast(groups.filter(large))
    cold = rows.join(hot, ["n", "sha"], "left_anti").join(groups.filter(~large), ["n", "sha"], "left")
    out = cold.unionByName(rows.join(hot, ["n", "sha"]))
    keep = F.when(F.col("size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with just one row of each text: one with the smallest non-null id; all columns stay as they are.

    Rows are told apart by numbers written once, never by their ids, so null
    and repeated ids cost no row its text and save none that is a copy. A row
    is kept as a struct meanwhile, so columns may have any names.
    """
    rows = numbered(docs, "exact-rows")
    groups = exact_groups(rows.select(F.col(ROW), of_whole(text_col).alias("text")), ROW, "text").filter("group_size > 1")
    groups = groups.select(F.col(ROW), F.col("keep_id").alias("group"))
    named = few(groups, "exact-groups").join(rows.select(ROW, of_whole(id_col).alias("id")), ROW)
    return one_of_each(rows, materialise(named, "exact-named"))

"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podia.llm import exact_dedup, filter_audit, iblt, langid, licences, metric_join, mixing, sharding, simhash, token_shards, toolcalls, turns, unigram
from podia.llm.common import load, scratch

#: Vocabulary files; set PODIA_PIECES and PODIA_RANKS where they lie elsewhere.
PIECES = os.environ.get("PODIA_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
RANKS = os.environ.get("PODIA_RANKS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
SHARDS = [f"shard-{i:03d}" for i in range(128)]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(load(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(load(spark, sf_dir, "documents"))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of all conversations, the record as a digest."""
    links = toolcalls.link(toolcalls.as_calls(load(spark, sf_dir, "conversations")), toolcalls.DIALOGUE)
    return links.select("conv_id", "call_id", "call_turn", "level", "result_turn", "status", "n_calls", "n_results", F.size("dangling").alias("n_dangling"), F.size("violations").alias("n_violations"), F.length("record").alias("record_chars"), F.sha2("record", 256).alias("record_sha256"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare_with_edits(load(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard among 128 shards, and the shard once the last of them is gone."""
    docs = load(spark, sf_dir, "documents").select("doc_id", sharding.slot_of(F.col("doc_id"), 65537).alias("slot"))
    placed = sharding.place(sharding.place(docs, "doc_id", SHARDS), "doc_id", SHARDS[:-1], out="shard_without_last")
    return placed.select("doc_id", "slot", "shard", "shard_without_last", (F.col("shard") != F.col("shard_without_last")).alias("moved"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(load(spark, sf_dir, "documents"), digest_all=True)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's digest columns, and its spans as JSON: label, notice, start, stop (code points of the text), edits."""
    return licences.licence_scan(load(spark, sf_dir, "documents")).withColumn("spans", F.to_json("spans"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded: doc_id, n_chars, n_pieces, a digest of the ids, and of what they decode to."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    coded = unigram.encode(docs, PIECES, decoded_col="decoded", zipf=True)
    return coded.select("doc_id", F.length("text").alias("n_chars"), F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxh64"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("same"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token shards in training order and read back: one row a sequence, the ids as a digest."""
    path = scratch(spark, "token-shards")
    token_shards.write_shards(load(spark, sf_dir, "documents"), path, RANKS)
    return token_shards.read_slots(spark, path).withColumn("tokens_xxh64", F.xxhash64("tokens")).drop("tokens")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repairs(turns.damage(load(spark, sf_dir, "conversations")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.near_vectors(load(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_tool_calls": op3_tool_calls,
    "op4_fingerprints": op4_fingerprints,
    "op5_sharding": op5_sharding,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language": op7_language,
    "op8_licences": op8_licences,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_token_shards": op10_token_shards,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_near_vectors": op13_near_vectors,
}

ORACLE = {
    "op6_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n
    """,
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
        w AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
        l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (
            SELECT part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
                   CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
                   || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                   || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
                   || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
                   || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails
            FROM w LEFT JOIN l ON w.doc_id = l.doc_id
        ),
        c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (
            SELECT a.x || b.x || c3.x || d4.x || e.x AS filter_order FROM c a, c b, c c3, c d4, c e
            WHERE len(list_distinct([a.x, b.x, c3.x, d4.x, e.x])) = 5
        ),
        s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM o),
        g AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM s),
        r AS (
            SELECT part, filter_order, step, own, f.good, f.toxic, contains(fails, own) AS fail, fails = own AS only_own,
                   translate(fails, before, '') <> fails AS gone
            FROM f, g
        ),
        k AS (
            SELECT part, filter_order, step, own, count(*) FILTER (NOT gone AND NOT fail) AS kept, count(*) FILTER (NOT gone AND fail) AS removed,
                   count(*) FILTER (gone AND fail) AS redundant, count(*) FILTER (only_own) AS unique_fails,
                   count(*) FILTER (NOT gone AND fail AND good) AS good_lost, count(*) FILTER (NOT gone AND fail AND toxic) AS toxic_lost
            FROM r GROUP BY part, filter_order, step, own
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
        FROM k
    """,
    "op13_near_vectors": r"""
        WITH RECURSIVE v AS MATERIALIZED (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        ),
        u AS MATERIALIZED (
            SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v
            WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda y: y * y)) > 0
        ),
        link AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a, u b WHERE a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.9
        ),
        reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION
            SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b
        ),
        component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
        links AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM component LEFT JOIN links USING (vec_id)
    """,
}

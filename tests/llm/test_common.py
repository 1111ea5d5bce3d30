import os

import corpus_pipeline
from podia.llm import common, exact_dedup, mixing, sharding, simhash

from .cases import TEXTS, documents, empty
from .test_text_models import corpus


def paths():
    return [p.removeprefix("file:") for p, _ in common._written]


def test_tables_go_when_nothing_reads_them(spark):
    docs = documents(spark, corpus(30) + TEXTS)
    held = simhash.near_groups(docs)
    cached = common.materialise(docs, "held-by-a-cache").persist()
    cached.count()
    cached = cached.select("doc_id")
    common.materialise(docs, "unread")
    before = set(paths())
    out = docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "")
        out = common.materialise(out, "stage")
    assert out.count() > 0
    common.sweep(spark)
    left = paths()
    assert all(os.path.exists(p) for p in left)
    assert not any("unread" in p for p in left) and any("held-by-a-cache" in p for p in left)
    assert held.count() == docs.count() and cached.count() == docs.count()
    mine = [p for p in left if p not in before]
    assert 1 <= len(mine) <= 2 and all("stage" in p for p in mine)  # the last, and at most what its job still holds


def test_columns_may_have_any_names(spark):
    names = ["row_number", "whole", "row", "pieces", "group"]
    docs = documents(spark, corpus(40) + TEXTS).withColumnsRenamed(dict(zip(["id", "fp", "size", "key", "root"], names, strict=True)))
    for kept in (exact_dedup.drop_exact_copies(docs), simhash.drop_near_copies(docs), mixing.mixed_documents(docs)):
        assert kept.columns == docs.columns
        assert {(r.row_number, r.whole, r.row, r.pieces, r.group) for r in kept.collect()} == {(7, "x", "y", "z", "r")}


def test_shards_keep_a_column_of_that_name_and_nulls(spark, tmp_path):
    docs = documents(spark).withColumnRenamed("key", "shard").selectExpr("*", "map(1, 2) as m", "named_struct('m', map('a', 'b')) as s", "'q' as slot")
    sharding.write_shards(docs, "doc_id", ["a", "b"], str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r.shard for r in back.collect()} <= {"a", "b"} and {r.shard_ for r in back.collect()} == {"z"}
    sharding.write_shards(empty(spark), "doc_id", ["a"], str(tmp_path / "none"))
    placed = sharding.place(docs, "shard", ["a", "b"])
    assert len({r.shard for r in placed.collect()}) == 1 and {r.slot for r in placed.collect()} == {"q"}

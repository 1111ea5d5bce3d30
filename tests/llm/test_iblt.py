import hashlib
import re

import pytest
from pyspark.sql import functions as F

from podia.llm import iblt

from .cases import documents, empty

PART = re.compile(iblt._PARAGRAPH)


def dice(a, b):
    a, b = set(PART.findall(a)), set(PART.findall(b))
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize(("run_rows", "max_cuts"), [(1000, 65_536), (3, 65_536), (1, 2)])
def test_matches_brute_force(spark, monkeypatch, run_rows, max_cuts):
    monkeypatch.setattr(iblt, "RUN_ROWS", run_rows)
    monkeypatch.setattr(iblt, "MAX_CUTS", max_cuts)
    docs = documents(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None), reverse=True)
    ids = [i for i, _ in rows]
    unique = [k for k, i in enumerate(ids) if ids.count(i) == 1 and (k + 1 == len(ids) or ids.count(ids[k + 1]) == 1)]
    got = {r.doc_id: r for r in iblt.compare_with_edits(docs).collect()}
    assert iblt.compare_with_edits(docs).count() == docs.count()
    for k in unique:
        i, t = rows[k]
        if k + 1 == len(rows):
            continue  # its next ones are the rows without an id
        nxt = rows[k + 1][1]
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(dice(t, edited)) and r.near_next == pytest.approx(dice(t, nxt))
    assert got[4].fingerprint == got[5].fingerprint == got[6].fingerprint != got[1].fingerprint


@pytest.mark.parametrize(("run_rows", "max_cuts"), [(1000, 65_536), (7, 65_536), (3, 4)])
def test_each_document_meets_the_next(spark, monkeypatch, run_rows, max_cuts):
    """Over uneven ids, negative ones and rows without an id: by descending id, then by the text's hash, then the first again."""
    monkeypatch.setattr(iblt, "RUN_ROWS", run_rows)
    monkeypatch.setattr(iblt, "MAX_CUTS", max_cuts)
    ids = [*range(-20, 30), *(3**i for i in range(20, 39)), -(2**62), *[None] * 25]
    docs = documents(spark, [(i, f"{n} text " + "abc" * (n % 5), "en", "a") for n, i in enumerate(dict.fromkeys(ids[:-25]))] + [(None, f"{n} unnamed", "en", "a") for n in range(25)])
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie), reverse=True)
    want = []
    for r, nxt in zip(rows, rows[1:] + rows[:1], strict=True):
        h = len(r.text) // 2
        want.append((hashlib.sha256((r.text[: len(r.text) - h] + nxt.text[:h]).encode()).hexdigest(), r.doc_id))
    got = [(r.edited_sha256, r.doc_id) for r in iblt.compare_with_edits(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_digests_that_differ_are_recovered(spark):
    line = lambda i: f"line number {i}"
    texts = [("", None), ("same\nlines", "same\nlines"), ("a b\nc", "c\nd"), ("\n".join(map(line, range(900))), "\n".join(map(line, range(3, 1400, 2))))]
    df = spark.createDataFrame([(i, a, b, "x", "y") for i, (a, b) in enumerate(texts)] * 2, "id long, old string, new string, gone string, paragraphs string")
    got = iblt.differing_paragraphs(df)
    assert got.columns == ["id", "old", "new", "paragraphs", "gone", "added"]
    parts = [set(PART.findall(t or "")) for pair in texts for t in pair]
    digest = {r.p: r.d for r in spark.createDataFrame([(p,) for p in set().union(*parts)], "p string").select("p", F.shiftrightunsigned(F.xxhash64("p"), 1).alias("d")).collect()}
    rows = got.collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        a, b = parts[2 * r.id], parts[2 * r.id + 1]
        assert r.gone == sorted(digest[p] for p in a - b) and r.added == sorted(digest[p] for p in b - a)
    sketches = iblt.sketch_docs(documents(spark).withColumn("sketch", F.lit("old")))
    assert sketches.count() == documents(spark).count() and "fp" in sketches.columns
    assert iblt.differing_paragraphs(df.limit(0)).count() == iblt.sketch_docs(empty(spark)).count() == 0


def test_one_and_no_document(spark):
    assert iblt.compare_with_edits(empty(spark)).count() == 0
    one = iblt.compare_with_edits(documents(spark, [(3, "abc def", "en", "a")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abc abc").hexdigest()


@pytest.mark.parametrize(("n", "m", "shared"), [(0, 0, 0), (1, 0, 0), (5, 4, 3), (40, 60, 11), (700, 300, 200), (5000, 4000, 3900)])
def test_difference_of_any_size(spark, n, m, shared):
    a = F.transform(F.sequence(F.lit(1), F.lit(n + 1)), lambda i: F.xxhash64(i))
    b = F.transform(F.sequence(F.lit(n - shared + 1), F.lit(n - shared + m + 1)), lambda i: F.xxhash64(i))
    df = spark.range(1).select(F.slice(a, 1, n).alias("a"), F.slice(b, 1, m).alias("b"))
    df = df.withColumn("sa", F.expr(iblt.sketch("a"))).withColumn("sb", F.expr(iblt.sketch("b")))
    assert df.select(F.expr(iblt.difference("a", "b", "sa", "sb"))).first()[0] == n + m - 2 * shared


def test_peeling_recovers_and_gives_up(spark):
    digests = F.transform(F.sequence(F.lit(1), F.col("id").cast("int")), lambda i: F.xxhash64(i))
    df = spark.range(1, 60).withColumn("d", digests)
    found = {r.id: r.n for r in df.select("id", F.expr(iblt.peel(iblt.sketch("d"), iblt.CELLS)).alias("n")).collect()}
    assert all(n in (i, None) for i, n in found.items())
    assert found[1] == 1 and found[4] == 4 and found[59] is None


def test_native_only(spark):
    plan = iblt.compare_with_edits(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

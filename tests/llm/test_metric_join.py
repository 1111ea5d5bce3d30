import math

import numpy as np
import pytest

from podia.llm import metric_join

NAN, INF = float("nan"), float("inf")


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 3, "x", 1.5) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, digest string, node double").repartition(3)


def brute_force(rows, similarity=0.9, kind=np.float32):
    """(id, n_links, component_id, kept) of every row."""
    good = []
    for i, v in rows:
        ok = v is not None and len(v) and None not in v
        a = np.array(v, kind).astype(float) if ok else None
        good.append(a if ok and np.isfinite(a).all() and a.any() else None)
    n = len(rows)
    link = [[j for j in range(n) if j != i and good[i] is not None and good[j] is not None and len(good[i]) == len(good[j]) and cosine(good[i], good[j]) >= similarity] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(link[i]), least, least == rows[i][0]))
    return sorted(out, key=repr)


def cosine(a, b):
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return a @ b / (np.linalg.norm(a) * np.linalg.norm(b))


def answer(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def clustered(seed, n=260, dims=8):
    """Groups from tight to as wide as the threshold, chains, copies and lone vectors."""
    rng = np.random.default_rng(seed)
    rows = []
    for width in (0.01, 0.1, 0.2, 0.35, 0.5):
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        rows += [(centre + rng.normal(size=dims) * width / math.sqrt(dims)) * rng.uniform(0.1, 9) for _ in range(n // 10)]
    at = rng.normal(size=(2, dims))
    rows += [np.cos(t) * at[0] + np.sin(t) * at[1] for t in np.arange(0, 3, 0.11)]
    rows += list(rng.normal(size=(n - len(rows), dims)))
    rows += [rows[3]] * 7 + [rows[-1]] * 3
    return [(int(i), [float(np.float32(x)) for x in v]) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize(("seed", "per_pivot", "block"), [(1, 100, 1 << 24), (2, 1, 1 << 24), (3, 4, 300), (4, 1, 100)])
def test_matches_brute_force(spark, monkeypatch, seed, per_pivot, block):
    monkeypatch.setattr(metric_join, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(metric_join, "BLOCK_BYTES", block)
    monkeypatch.setattr(metric_join, "AT_ONCE", 1 << 10)
    rows = clustered(seed)
    got = answer(metric_join.near_vectors(table(spark, rows)))
    assert got == brute_force(rows)
    assert sum(x[1] > 0 for x in got) > 100


AWKWARD = [
    (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, -0.0]), (3, [0.9, math.sqrt(0.19), 0.0]), (4, [0.899, math.sqrt(1 - 0.899**2), 0.0]),
    (5, None), (6, []), (7, [0.0, 0.0, 0.0]), (8, [1.0, None, 0.0]), (9, [1.0, NAN, 0.0]), (10, [INF, 0.0, 0.0]),
    (11, [1.0, 0.0]), (12, [1.0, 0.01]), (13, [5.0]), (14, [7.0]), (15, [-7.0]), (1, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]),
    (None, [0.0, 0.0, 3.0]), (16, [1e30, 1e28, 0.0]), (17, [1e-30, 0.0, 0.0]), (None, None), (18, [0.0, 1e-40, 0.0]), (18, [0.0, 1.0, 0.0]),
]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_awkward_vectors(spark, kind):
    rows = AWKWARD + ([(20, [1e300, 0.0, 0.0]), (21, [1e-300, 0.0, 0.0])] if kind == "double" else [])
    got = answer(metric_join.near_vectors(table(spark, rows, kind)))
    assert got == brute_force(rows, kind=np.float32 if kind == "float" else np.float64)


def test_lengths_without_a_pivot(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "PIVOT_SAMPLE", 2)
    monkeypatch.setattr(metric_join, "BLOCK_BYTES", 24)
    rows = [(i, [float(i % 7 + 1)] * (1 + i % 5)) for i in range(60)]
    assert answer(metric_join.near_vectors(table(spark, rows))) == brute_force(rows)


def test_other_thresholds_and_empty_tables(spark):
    rows = clustered(9, 120)
    assert answer(metric_join.near_vectors(table(spark, rows), similarity=0.5)) == brute_force(rows, 0.5)
    assert metric_join.near_vectors(table(spark, [])).count() == 0
    assert answer(metric_join.near_vectors(table(spark, [(1, None), (2, [0.0])]))) == [(1, 0, 1, True), (2, 0, 2, True)]
    with pytest.raises(ValueError, match="above 0"):
        metric_join.near_vectors(table(spark, rows), similarity=0)

import random
from collections import defaultdict

import numpy as np
import pytest

from podia.llm import mixing
from podia.llm.common import scratch
from podia.llm.feistel import permute, place_of

from .cases import documents, empty


def rows(sizes):
    return [(i, " ".join(f"w{i}x{j}" for j in range(n)), "en", s) for i, (s, n) in enumerate(sizes)]


def water_fill(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, open_, target = sum(size.values()), set(names), {}
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            return target | share
        target |= {s: 3 * size[s] for s in over}
        open_ -= over
    return target


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(n):
    for key in (0, 1, -5, 2**63 - 1):
        assert sorted(permute(np.arange(n), n, key).tolist()) == list(range(n))
    if n == 1000:
        assert (permute(np.arange(n), n, 1) != permute(np.arange(n), n, 2)).mean() > 0.9


def test_targets_and_taken(spark):
    rng = np.random.default_rng(2)
    docs = rows([("a", int(x)) for x in rng.integers(0, 80, 60)] + [("b", 3), ("c", 900), (None, 40), ("d", 0), ("d", 0)])
    size, taken, by_doc = defaultdict(int), defaultdict(int), {}
    got = mixing.taken_words(documents(spark, docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size
        by_doc[r.doc_id] = r.taken
    want = water_fill(size)
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
    assert sum(want.values()) == pytest.approx(sum(size.values()))
    for s in size:
        assert abs(taken[s] - want[s]) <= 1
    assert by_doc == {r.doc_id: r.taken for r in mixing.taken_words(documents(spark, docs)).collect()}


def test_the_last_draw_reaches_the_target():
    """Whatever the source's size, block length and target: the words of the draws add up to what is wanted."""
    rng = random.Random(1)
    for _ in range(2000):
        size, words, key = rng.randint(1, 60), rng.randint(1, 12), rng.getrandbits(62)
        blocks, wanted = -(-size // words), rng.randint(1, 3 * size)
        draws, last = mixing.last_draw(wanted, size, blocks, words, key)
        order = [b for e in range(3) for b in permute(np.arange(blocks), blocks, key + e).tolist()][:draws]
        length = [words if b < blocks - 1 else size - (blocks - 1) * words for b in order]
        assert sum(length[:-1]) + min(last, length[-1]) == wanted and last > 0
        assert place_of(int(permute(np.array([blocks // 2]), blocks, key)[0]), blocks, key) == blocks // 2


def test_written_mix_has_the_blocks(spark):
    docs = documents(spark, rows([("a", 3000), ("a", 50), ("b", 900), ("c", 5000), (None, 7), ("b", 900)]) + [(8, None, "en", "a"), (9, " ", "en", "b")])
    path = scratch(spark, "mix")
    mixing.write_mix(docs, path)
    got = spark.read.parquet(path).collect()
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs).collect() if r.taken}
    words = defaultdict(int)
    for r in got:
        words[r.id] += len(r.text.split())
    assert words == taken
    blocks, whole = defaultdict(list), {r.doc_id: (r.text or "").split() for r in docs.collect()}
    for r in got:
        blocks[r.source, r.slot].append((r.at, r.text.split()))
        assert " ".join(r.text.split()) in " ".join(whole[r.id])
    for parts in blocks.values():
        at = 0
        for place, text in sorted(parts):
            assert place == at
            at += len(text)
        assert at <= mixing.BLOCK_WORDS
    assert sum(sum(len(t) for _, t in p) < mixing.BLOCK_WORDS for p in blocks.values()) <= 2 * 4 + 4 * 3


def test_repeated_rows_are_mixed_one_by_one(spark):
    docs = documents(spark, [*rows([("a", 30), ("b", 20)]), *rows([("a", 30)]), *rows([("a", 30)]), (None, "x y z", "en", None), (None, "x y z", "en", None)])
    want = sorted(r.taken for r in mixing.taken_words(docs).collect() if r.taken)
    assert sorted(len(r.text.split()) for r in mixing.mixed_documents(docs).collect()) == want


def test_awkward_rows(spark):
    got = mixing.taken_words(documents(spark)).collect()
    assert len(got) == documents(spark).count()
    assert all(r.taken <= 3 * r.size for r in got)
    assert mixing.taken_words(empty(spark)).count() == 0
    assert mixing.mixed_documents(empty(spark)).count() == 0


def test_mixed_documents_have_the_taken_words(spark):
    docs = documents(spark, rows([("a", 30), ("a", 50), ("b", 20), ("c", 500), (None, 7)]))
    taken = {r.doc_id: r.taken for r in mixing.taken_words(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert {i: len(r.text.split()) for i, r in got.items()} == {i: n for i, n in taken.items() if n}
    assert all(r.n_chars == len(r.text) and set(r.text.split()) <= {f"w{i}x{j}" for j in range(500)} for i, r in got.items())


def test_cut():
    text = " one  two\nthree four "
    assert mixing.cut(text, [(0, 0, 2), (0, 2, 2)]) == text
    assert mixing.cut(text, [(1, 3, 1), (0, 1, 2)]) == "two\nthree\nfour"

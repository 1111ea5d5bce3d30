import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from podia.llm import filter_audit

from .cases import TEXTS, documents, empty

LABELS = "doc_id long, quality int, toxic int, part string"


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], LABELS)


def brute_force(rows, labelled):
    """rows: (doc_id, text, part)."""
    docs = []
    for i, t, part in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            fails.add("E")
        own = [(q, x) for j, q, x in labelled if j == i and i is not None]
        docs.append((part or "", fails, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out = defaultdict(Counter)
    shapley = Counter()
    for part, fails, good, toxic in docs:
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                c = out[part, "".join(order), step]
                here = not gone and f in fails
                c["removed"] += here
                c["redundant"] += gone and f in fails
                c["unique_fails"] += fails == {f}
                c["good_lost"] += here and good
                c["toxic_lost"] += here and toxic
                gone |= here
                c["kept"] += not gone
                shapley[part, f] += here
    return {k: (*(c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def answer(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_matches_brute_force_on_awkward_rows(spark):
    words = " ".join(f"w{i}" for i in range(250))
    more = [(20, words, "en", "a"), (21, words, None, "a"), (22, words + " #", "de", "a"), (22, words + " #", "de", "a"), (19, words + " #", "", "a"), (30, "ABC " * 250, "en", "a"), (None, words, "en", "a")]
    rows = TEXTS + more
    told = [(20, 1, 0), (21, 1, 1), (22, 0, 1), (22, 1, None), (30, None, 1), (1, 1, 0), (999, 1, 1), (None, 1, 1)]
    got = answer(filter_audit.audit(documents(spark, rows), labels(spark, told)))
    want = brute_force([(i, t, lang) for i, t, lang, _ in rows], told)
    assert len(got) == 120 * 5 * 3
    assert got == want


def test_large_groups_take_the_same_way(spark, monkeypatch):
    rows = [(i, "the same text" if i % 3 else f"text {i} of its own", "en" if i % 2 else "de", "a") for i in range(60)]
    want = answer(filter_audit.audit(documents(spark, rows), labels(spark, [(1, 1, 1)])))
    monkeypatch.setattr(filter_audit, "LARGE_ROWS", 5)
    assert answer(filter_audit.audit(documents(spark, rows), labels(spark, [(1, 1, 1)]))) == want
    assert want == brute_force([(i, t, lang) for i, t, lang, _ in rows], [(1, 1, 1)])


def test_long_texts_are_counted_by_pieces(monkeypatch):
    text = ("Aé bb \t cc# " * 5000 + "last").encode()
    whole = filter_audit.text_mask(text)
    monkeypatch.setattr(filter_audit, "PIECE", 7)
    assert filter_audit.text_mask(text) == whole == 0b1110
    assert filter_audit.text_mask(b"") == 1
    assert filter_audit.text_mask(b"x" * 100) == 1


def test_empty_tables_and_orders(spark):
    assert filter_audit.audit(empty(spark), labels(spark, [])).count() == 0
    assert filter_audit.audit(documents(spark), labels(spark, [])).filter("good_lost > 0").count() == 0
    assert filter_audit.orders(spark).count() == 120
    with pytest.raises(ValueError, match="different"):
        filter_audit.orders(spark, "AA")

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from podia.llm import exact_dedup, golay, simhash
from podia.llm.components import components

from .cases import documents, empty


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups_match_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = exact_dedup.exact_groups(docs, digest_all=True).collect()
    assert len(got) == len(rows)
    want = sorted(((i, min((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_digest_all_only_changes_the_digest(spark):
    docs = documents(spark)
    pick = lambda df: sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)
    assert pick(exact_dedup.exact_groups(docs)) == pick(exact_dedup.exact_groups(docs, digest_all=True))


def test_same_length_and_prefix_are_not_enough(spark):
    start = "p" * 300
    docs = documents(spark, [(1, start + "ab", "en", "a"), (2, start + "ba", "en", "a"), (3, start + "ab", "en", "a")])
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_drop_exact_copies_keeps_columns(spark):
    docs = documents(spark)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 3, 4, 7, 10, 11}
    assert not {r.doc_id for r in kept.collect()} & {2, 5}
    assert exact_dedup.drop_exact_copies(empty(spark)).count() == 0
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_fingerprint_by_definition():
    rng = random.Random(5)
    for n in (0, 1, 3, 4, 5, 40):
        words = [rng.choice(["Aa", "b", "É", "ccc"]) for _ in range(n)]
        text = " \n".join(words)
        low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
        grams = [" ".join(low[i : i + 4]) for i in range(max(1, n - 3))] if n else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if n else 0
        assert simhash.fingerprint(text.encode()) == want


def test_xxhash_is_sparks(spark):
    text = "the quick brown fox, æøå"
    assert spark.sql(f"select xxhash64('{text}')").first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_golay_neighbours_meet():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    for bits in (0, 1, 2):
        other = words.copy()
        for _ in range(bits):
            other ^= 1 << rng.integers(0, 23, len(words))
        (a, has_a), (b, has_b) = golay.nearby(words), golay.nearby(other)
        assert ((a[:, :, None] == b[:, None, :]) & has_a[:, :, None] & has_b[:, None, :]).any(axis=(1, 2)).all()


def test_keys_meet_at_four_bits():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for errors in range(1, 5):
        near = fps.copy()
        for i in range(len(near)):
            for b in rng.choice(64, errors, replace=False):
                near[i] ^= np.uint64(1) << np.uint64(b)
        keys = [defaultdict(set), defaultdict(set)]
        for found, x in zip(keys, (fps, near), strict=True):
            for k, p in zip(*(a.tolist() for a in simhash.fuzzy_keys(x)), strict=True):
                found[p].add(k)
        assert all(keys[0][i] & keys[1][i] for i in range(len(fps)))


def brute_components(fps):
    ids = sorted((i for i in fps if i is not None))
    order = [*ids, *(i for i in fps if i is None)]
    up = {i: i for i in order}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in order:
        for b in order:
            if bin(fps[a] ^ fps[b]).count("1") <= 4:
                x, y = top(a), top(b)
                if x != y:
                    lo, hi = sorted((x, y), key=order.index)
                    up[hi] = lo
    return {i: top(i) for i in order}


def test_near_groups_match_brute_force(spark):
    docs = documents(spark)
    got = simhash.near_groups(docs).collect()
    assert len(got) == docs.count()
    fps = {i: int(f, 16) for i, f, _ in got if i is not None}
    assert {i: c for i, _, c in got if i is not None} == {**brute_components(fps)}
    assert simhash.near_groups(empty(spark)).count() == 0
    assert simhash.drop_near_copies(docs).columns == docs.columns


def test_chains_blocks_and_hubs(spark, monkeypatch):
    """Chains of fingerprints four bits apart, a dense cluster, and bystanders, in tiny blocks."""
    rng = random.Random(3)
    fps, x = [0], 0
    for _ in range(40):
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
        fps.append(x)
    centre = rng.getrandbits(64)
    for _ in range(60):
        y = centre
        for b in rng.sample(range(12), rng.randint(0, 3)):
            y ^= 1 << b
        fps.append(y)
    fps += [rng.getrandbits(64) for _ in range(50)]
    table = {i: f for i, f in enumerate(fps)}
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in table.items()]
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: spark.createDataFrame(signed, "id long, fp long"))
    got = {r.doc_id: r.component_id for r in simhash.near_groups(documents(spark), block=8).collect()}
    assert got == brute_components(table)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[i] for i in range(31)}) == 1 and len({found[i] for i in range(100, 140)}) == 1
    assert len(set(found.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_null_and_repeated_ids_lose_no_text_and_save_no_copy(spark):
    words = lambda seed: " ".join(str(random.Random(seed).getrandbits(40)) for _ in range(60))
    rows = [(1, words(1), "en", "a"), (None, words(1), "en", "b"), (None, words(2), "en", "c"), (None, words(2), "en", "c"), (2, words(3), "en", "a"), (3, words(3), "en", "a"), (3, words(4), "en", "a"), (5, words(5), "en", "a"), (5, words(5), "en", "b")]
    want = sorted(((1, words(1)), (None, words(2)), (2, words(3)), (3, words(4)), (5, words(5))), key=str)
    for drop in (exact_dedup.drop_exact_copies, simhash.drop_near_copies):
        kept = drop(documents(spark, rows))
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == want
        texts = [r.text for r in drop(documents(spark)).collect()]
        assert "nobody knows this text at all" in texts and texts.count("one") == 1


def jaccard_components(texts, shingle=5, similarity=0.8):
    def grams(t):
        words = t.lower().split()
        return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()

    sets, up = [grams(t) for t in texts], list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return [top(i) for i in range(len(texts))]


def test_near_copies_by_five_word_similarity(spark):
    """Copies just above and below 0.8, beyond four bits too, and unlike texts that share one often repeated line."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(20):
        words = [word() for _ in range(rng.randint(80, 160))]
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 4):
            other = list(words)
            for at in rng.sample(range(len(words)), edits):
                other[at] = word()
            texts.append(" ".join(other))
    line = "all rights reserved by the makers of this page " * 40
    texts += [line + " ".join(word() for _ in range(60)) for _ in range(10)]
    want = {i for i, top in enumerate(jaccard_components(texts)) if i == top}
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == want
    far = [bin(simhash.fingerprint(texts[0].encode()) ^ simhash.fingerprint(t.encode())).count("1") for t in texts[1:5]]
    assert max(far) > simhash.DISTANCE


def test_only_what_is_in_a_pair_has_its_set_made(spark, monkeypatch):
    """A key that two texts share costs no set if their sizes rule the similarity out."""
    made, write = [], simhash.materialise

    def counted(df, name):
        table = write(df, name)
        made.extend([(name, table.count())] if name in ("shared-nodes", "shingle-sets") else [])
        return table

    monkeypatch.setattr(simhash, "materialise", counted)
    words = [f"w{i}" for i in range(100)]
    docs = documents(spark, [(1, " ".join(words[:74]), "en", "s"), (2, " ".join(words), "en", "s")])
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == {1, 2}
    assert dict(made)["shared-nodes"] > 0 and sum(n for name, n in made if name == "shingle-sets") == 0


def test_edited_copies_of_one_text_do_not_meet_in_pairs(spark, monkeypatch):
    """Copies of a text with few edits link with it, those with more link with nothing; pairs grow with the texts, not their square."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    words, texts = [word() for _ in range(150)], []
    for edits in [0] + [1, 2, 4, 5] * 40:
        other = list(words)
        for at in rng.sample(range(0, 150, 6), edits):
            other[at] = word()
        texts.append(" ".join(other))
    made, write = [], simhash.materialise

    def counted(df, name):
        table = write(df, name)
        made.extend([table.count()] if name == "pairs" else [])
        return table

    monkeypatch.setattr(simhash, "materialise", counted)
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    want = {i for i, top in enumerate(jaccard_components(texts)) if i == top}
    assert {r.doc_id for r in simhash.drop_near_copies(docs).collect()} == want and 1 < len(want) < len(texts)
    assert made[0] < 10 * len(texts) and sum(made[1:]) < len(texts)

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from podia.llm import sharding, token_shards
from podia.llm.common import scratch
from podia.llm.feistel import permute
from podia.llm.queries import RANKS

from .cases import TEXTS, documents, empty


def turns(shards, slots):
    """Shards take turns, each its next free slot in its order of preference: written anew from the definition."""
    import hashlib

    def order(name):
        seed = hashlib.sha256(name.encode()).digest()
        at, skip = int.from_bytes(seed[:8], "big") % slots, int.from_bytes(seed[8:16], "big") % (slots - 1) + 1
        return [(at + j * skip) % slots for j in range(slots)]

    orders, table = {s: iter(order(s)) for s in shards}, {}
    while len(table) < slots:
        for s in shards:
            if len(table) < slots:
                table[next(x for x in orders[s] if x not in table)] = s
    return [shards.index(table[i]) for i in range(slots)]


def test_lookup_table():
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 101)
    assert table == turns(shards, 101)
    counts = Counter(table).values()
    assert max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(shards[:-1], 101)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 30
    for bad in ((["a", "a"], 101), ([], 101), (["a"], 100), (["a"] * 1, 10**7 + 19)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placement(spark):
    docs = documents(spark).withColumn("shard", F.lit("old"))
    shards = [f"s{i}" for i in range(5)]
    got = sharding.place(docs, "doc_id", shards, 101).collect()
    assert len(got) == len(TEXTS)
    by_id = {}
    for r in got:
        assert r.shard in shards and by_id.setdefault(r.doc_id, r.shard) == r.shard
    assert sharding.place(empty(spark), "doc_id", shards, 101).count() == 0
    table = sharding.lookup_table(shards, 101)
    slots = {r.doc_id: r.s for r in docs.select("doc_id", sharding.slot_of(F.col("doc_id"), 101).alias("s")).collect()}
    assert all(by_id[i] == shards[table[s]] for i, s in slots.items())


def test_written_shards_are_whole(spark):
    path = scratch(spark, "placed")
    sharding.write_shards(documents(spark), "doc_id", ["a", "b", "c"], path, 101, split=2)
    assert spark.read.parquet(path).count() == len(TEXTS)


@pytest.fixture(scope="module")
def source(spark):
    path = scratch(spark, "texts")
    documents(spark).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize(("seq_len", "per_shard"), [(16, 50), (1000, 7), (100_000_0, 3)])
def test_shards_hold_every_token_once(spark, source, seq_len, per_shard):
    path = scratch(spark, "shards")
    m = token_shards.write_shards(source, path, RANKS, seq_len, per_shard)
    ids, end = token_shards.ids_of(RANKS)
    want = Counter()
    for _, t, _, _ in TEXTS:
        want.update([*np.frombuffer(ids.of(t or ""), "<u2").tolist(), end])
    rows = token_shards.read_slots(spark, path).collect()
    assert sorted(r.slot for r in rows) == list(range(m["sequences"])) and len({r.sequence for r in rows}) == len(rows)
    assert Counter(x for r in rows for x in np.frombuffer(r.tokens, "<u2").tolist()) == want
    assert sum(r.n_tokens for r in rows) == sum(want.values())
    domain = token_shards.PARTS * token_shards.PER_PART
    rows.sort(key=lambda r: r.slot)
    values = permute(np.array([r.sequence for r in rows]), domain, m["key"]).tolist()
    assert values == sorted(set(values))
    width = -(-domain // m["shards"])
    assert [r.shard for r in rows] == [v // width for v in values]
    sizes = Counter(r.shard for r in rows)
    assert all(r.place == r.slot - sum(n for s, n in sizes.items() if s < r.shard) for r in rows)
    files = spark.read.format("binaryFile").load(f"{path}/shards").select("shard", "length").collect()
    assert {f.shard: f.length for f in files} == {s: m["stride"] * n for s, n in sizes.items()}
    again = scratch(spark, "shards")
    token_shards.write_shards(source, again, RANKS, seq_len, per_shard)
    assert sorted(token_shards.read_slots(spark, again).collect()) == rows


def test_resumed_reading(spark, source):
    path = scratch(spark, "shards")
    m = token_shards.write_shards(source, path, RANKS, 64, 10)
    whole = {r.slot: r.tokens for r in token_shards.read_slots(spark, path).collect()}
    part = {r.slot: r.tokens for r in token_shards.read_slots(spark, path, 17, 42).collect()}
    assert part == {i: whole[i] for i in range(17, 42)}
    assert token_shards.read_slots(spark, path, m["sequences"]).count() == 0


def test_no_documents(spark):
    path = scratch(spark, "shards")
    assert token_shards.write_shards(empty(spark), path, RANKS)["sequences"] == 0
    assert token_shards.read_slots(spark, path).count() == 0


def test_parts_encode_like_the_whole():
    ids, _ = token_shards.ids_of(RANKS)
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(" \n\t ab'sé1  \x1c\x85.!日") for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(ids.of(text), "<u2").tolist() == ids.encoding.encode_ordinary(text)


def test_batches_encode_like_each_text():
    ids, end = token_shards.ids_of(RANKS)
    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\t ab'sé1  \x1c\x85\u3000.!日") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += [None, "", " ", "  ", "a ", " a", *(t for _, t, _, _ in TEXTS)]
    for few in (texts, texts[:1], texts[-1:], texts[::7]):
        want = [x for t in few for x in [*ids.encoding.encode_ordinary(t or ""), end]]
        assert np.frombuffer(token_shards._stream(pa.array(few, pa.string()), RANKS), "<u2").tolist() == want


def test_forgotten_words_are_encoded_again(monkeypatch):
    ids, _ = token_shards.ids_of(RANKS)
    monkeypatch.setattr(token_shards, "REMEMBER", 20)
    own = token_shards.Ids(ids.encoding, {})
    own.begins = ids.begins
    for i in range(0, 60, 3):
        words = [f"word{j}" for j in range(i % 30, i % 30 + 9)] + ["the"]
        assert own.words(words) == [own.encode(f" {w}") for w in words]
        assert len(own.known) < 30 and len(own.older) < 30

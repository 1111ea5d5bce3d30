"""Token ids in training order: a keyed permutation gives every sequence a place, and shards of fixed stride hold them in order.

Texts are encoded once. A sequence's number is its partition's and its place
in it, so it needs no count of what comes before; the permutation acts on all
numbers there can be, and shards are equal ranges of its values. How many
sequences a shard holds is known once it is written: slots, from 0 without
gaps, are the ranks of the values.
"""

import base64
import json
import re
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podia.llm.common import MAX_BROADCAST_IDS, small_batches
from podia.llm.feistel import permute

#: How byte-level BPE cuts a text before it merges bytes (a fixed value of these vocabularies).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker remembers, and the longest of them: 25 MB or so, however long words are.
REMEMBER, LONGEST = 100_000, 64
#: Partitions that a table may have, and sequences that one may give; the permutation acts on their product.
PARTS, PER_PART = 1 << 21, 1 << 32
#: Bytes of text that give one id, as guessed to set the number of shards.
BYTES_PER_ID = 3
#: A record: the number of tokens, the sequence's number before the permutation, the ids (uint16); and a guard byte,
#: which Spark's text sink puts after each line: so any store that Spark writes to can hold shards.
HEADER = "<Iq"
HEADER_BYTES = struct.calcsize(HEADER)
GUARD = b"\n"
#: A space with white space after it: only texts without may be cut before every space.
SPACES = r" [\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BEFORE_WORD = re.compile(r" (?=\S)")


class Ids:
    """Ids (uint16, little endian) of words with the space before them: encoded once, then remembered.

    Of what was met, the words of the last two generations stay, so frequent ones are never encoded again.
    """

    def __init__(self, encoding, ranks: dict[bytes, int]):
        self.encoding, self.known, self.older = encoding, {}, {}
        self.begins = np.zeros(len(ranks), bool)
        self.begins[[rank for token, rank in ranks.items() if token[:1] == b" "]] = True

    def encode(self, part: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(part), "<u2").tobytes()

    def of(self, text: str) -> bytes:
        """The ids of any text, cut before the spaces that begin a word: there a piece of the pattern always begins."""
        first, *rest = BEFORE_WORD.split(text)
        return self.encode(first) + b"".join(self.encode(f" {part}") for part in rest)

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, none with a space in it or white space first.

        New ones are encoded in one go: only a word's first token begins with a space.
        """
        if len(self.known) >= REMEMBER // 2:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        missing = {w: self.older.get(w) for w, f in zip(words, found, strict=True) if f is None}
        if new := [w for w, f in missing.items() if f is None]:
            ids = np.array(self.encoding.encode_ordinary(" " + " ".join(new)), "<u2")
            at = (np.append(np.flatnonzero(self.begins[ids]), len(ids)) * 2).tolist()
            data = ids.tobytes()
            missing.update(zip(new, (data[i:j] for i, j in zip(at, at[1:])), strict=True))
        self.known.update((w, i) for w, i in missing.items() if len(w) <= LONGEST)
        return [missing[w] if f is None else f for w, f in zip(words, found, strict=True)]


@cache
def ids_of(path: str) -> tuple[Ids, int]:
    """The vocabulary of a tiktoken rank file, and the free id after its last, which ends documents."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(ranks) > 65_535:
        raise ValueError("ids must fit 16 bits, with one to spare")
    return Ids(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks), len(ranks)


def _words(texts: pa.Array, vocabulary: str) -> tuple[pa.Array, np.ndarray]:
    """(entries, index): the ids of a batch of texts, each ended by the end id, are entries[index] end to end.

    Texts are split at spaces by Arrow, and each distinct word is looked up
    once. A text's first word has an entry of its own, as no space comes before
    it; so has a whole text with runs of white space, which is cut by
    BEFORE_WORD instead. The end id of the text before stands in that entry too.
    """
    ids, end = ids_of(vocabulary)
    stop = struct.pack("<H", end)
    texts = pc.fill_null(texts, "")
    spaced = pc.match_substring_regex(texts, SPACES)
    parts = pc.split_pattern(pc.if_else(spaced, "", texts), " ")
    firsts = parts.offsets.to_numpy()[:-1]
    words = parts.flatten().dictionary_encode()
    index = words.indices.to_numpy().astype(np.int64)
    entries = ids.words(words.dictionary.to_numpy(zero_copy_only=False).tolist())
    index[firsts] = np.arange(len(entries), len(entries) + len(firsts))
    for k, (at, runs) in enumerate(zip(firsts.tolist(), spaced.to_pylist(), strict=True)):
        own = ids.of(texts[k].as_py()) if runs else ids.encode(words[at].as_py())
        entries.append(stop + own if k else own)
    return pa.array([*entries, stop], pa.large_binary()), np.append(index, len(entries))


def _stream(texts: pa.Array, vocabulary: str) -> memoryview:
    """The ids of a batch of texts, end to end, each text's ended by the end id."""
    entries, index = _words(texts, vocabulary)
    return memoryview(entries.take(pa.array(index)).buffers()[2])


def _stride(seq_len: int) -> int:
    return HEADER_BYTES + 2 * seq_len + len(GUARD)


def write_shards(docs: DataFrame, path: str, vocabulary: str, seq_len: int = 1024, per_shard: int = 8192, key: int = 20_24, text_col: str = "text", shards: int | None = None) -> dict:
    """Write the whole texts of docs as shuffled token shards under path, and return the manifest written beside them.

    Each partition's documents, ended by the end id, are one stream, cut into
    sequences of seq_len ids; the last is filled with the end id. The
    permutation that key names (a Feistel network with cycle-walking on
    PARTS * PER_PART numbers) gives each sequence's number a value. Values go
    by equal ranges to shards, which sort them and write one file each, of
    equal records: one pass over the texts, one shuffle, and no sampling of
    ranges, as values are evenly spread. There are about per_shard sequences
    in a shard, or as many shards as told. The index has each shard's number
    of sequences, as its file's length says, and the slot of its first.

    docs must be a table, whose partitions come the same when a lost executor's
    work is done again; write anything else first. Null and empty texts are
    documents without ids; repeated rows are written as often as they come; an
    empty table gives a manifest of no shards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    if shards is None:
        whole = texts.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
        shards = -(-(whole["n"] + (whole["bytes"] or 0) // BYTES_PER_ID) // (seq_len * per_shard))
    width = -(-PARTS * PER_PART // max(1, shards))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        if part >= PARTS:
            raise ValueError(f"more than {PARTS} partitions")
        record = np.dtype([("n", "<u4"), ("number", "<i8"), ("ids", "V", 2 * seq_len)])  # HEADER, then the ids

        def out(ids: bytes, at: int, n: int = seq_len) -> pa.RecordBatch:
            rows = np.empty(len(ids) // (2 * seq_len), record)
            rows["n"], rows["number"], rows["ids"] = n, np.arange(at, at + len(rows)), np.frombuffer(ids, record["ids"])
            values = permute(rows["number"].astype(np.int64), PARTS * PER_PART, key)
            ends = np.arange(0, (len(rows) + 1) * record.itemsize, record.itemsize, np.int32)
            records = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(values // width, pa.int32()), records], ["value", "shard", "record"])

        held, at = bytearray(), part * PER_PART
        for batch in batches:
            if not batch.num_rows:
                continue
            held += _stream(batch.column(0), vocabulary)
            while len(held) >= 2 * seq_len:
                n = min(len(held) // (2 * seq_len), 1024)
                yield out(bytes(held[: n * 2 * seq_len]), at)
                at += n
                del held[: n * 2 * seq_len]
        if held:
            n = len(held) // 2
            yield out(bytes(held) + struct.pack("<H", ids_of(vocabulary)[1]) * (seq_len - n), at, n)
        if at - part * PER_PART >= PER_PART:
            raise ValueError(f"more than {PER_PART} sequences in a partition")

    total = 0
    if shards:
        records = texts.mapInArrow(pack, "value long, shard int, record binary").repartitionById(shards, F.col("shard"))
        records = records.sortWithinPartitions("shard", "value").select(F.col("record").cast("string").alias("record"), "shard")
        records.write.partitionBy("shard").options(lineSep=GUARD.decode(), maxRecordsPerFile=0).text(f"{path}/shards")
        files = _files(spark, path).select("shard", (F.col("length") / _stride(seq_len)).cast("long").alias("n"))
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
        files.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).write.parquet(f"{path}/index")
        total = spark.read.parquet(f"{path}/index").agg(F.sum("n")).first()[0]
    manifest = {"sequences": total, "seq_len": seq_len, "shards": shards, "stride": _stride(seq_len), "key": key}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary, shard int").load(f"{path}/shards")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def read_slots(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """(slot, shard, place, sequence, n_tokens, tokens) of the slots from start up to stop, tokens as little-endian uint16.

    sequence is the number from which the permutation's value came. Training
    resumes at any slot: the index says which shards to open and, as strides
    are fixed, where in the first and the last the range begins and ends; only
    its records are decoded. Spark's reader hands over a file as a whole, so a
    resumed read loads less than a shard (17 MB by default) in vain at each end.
    """
    m = read_manifest(spark, path)
    stop = m["sequences"] if stop is None else min(stop, m["sequences"])
    schema = "slot long, shard int, place int, sequence long, n_tokens int, tokens binary"
    if start >= stop:
        return spark.createDataFrame([], schema)
    stride = m["stride"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = memoryview(content.as_buffer())
                lo, hi = max(start - first, 0), min(stop - first, len(data) // stride)
                for at in range(lo, hi, 1024):
                    places = range(at, min(at + 1024, hi))
                    rows = [data[p * stride : (p + 1) * stride] for p in places]
                    if any(r[-1:] != GUARD for r in rows):
                        raise ValueError(f"shard {shard} has a record out of line")
                    heads = [struct.unpack(HEADER, r[:HEADER_BYTES]) for r in rows]
                    bodies = [bytes(r[HEADER_BYTES : HEADER_BYTES + 2 * n]) for r, (n, _) in zip(rows, heads, strict=True)]
                    slots = np.array(places) + first
                    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array([shard] * len(rows), pa.int32()), pa.array(list(places), pa.int32()), pa.array([h[1] for h in heads]), pa.array([h[0] for h in heads], pa.int32()), pa.array(bodies, pa.binary())], ["slot", "shard", "place", "sequence", "n_tokens", "tokens"])

    wanted = spark.read.parquet(f"{path}/index").filter((F.col("first") < stop) & (F.col("first") + F.col("n") > start))
    ends = wanted.agg(F.count("*").alias("n"), F.min("shard").alias("lo"), F.max("shard").alias("hi")).first()
    wanted = wanted.select("shard", "first")
    files = _files(spark, path).filter(F.col("shard").between(ends["lo"], ends["hi"])).select("shard", "content")
    files = files.join(F.broadcast(wanted) if ends["n"] <= MAX_BROADCAST_IDS else wanted, "shard")
    return files.select("shard", "first", "content").mapInArrow(run, schema)

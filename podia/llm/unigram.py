"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, white-space markers."""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from podia.llm.common import small_batches

#: Stands for a space in pieces.
MARKER = "▁"
#: A run of markers and what follows up to the next marker: no piece goes beyond one.
UNIT = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")
#: Distinct units whose pieces a worker remembers before it forgets them all.
REMEMBER = 100_000
#: Characters of text that are encoded together, and cells of the Viterbi table.
TEXT_AT_ONCE, CELLS = 2_000_000, 500_000
#: Units longer than this (bytes) are encoded one at a time.
LONG = 128
#: How far an unknown character's score is below the least piece's.
UNKNOWN_BELOW = 10.0


def double_array(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays base, check and value of a trie: from state s byte c leads to t = base[s] + c + 1 if check[t] is s.

    value[t] is the index of the piece that ends in state t, -1 if none.
    State 0 is the root. Nodes are placed breadth first, each at the least base
    at which all of its children find free cells.
    """
    root: dict = {}
    for i, piece in enumerate(pieces):
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[-1] = i
    used = bytearray(b"\1") + bytearray(1 << 20)
    base, check, value = [0] * len(used), [-1] * len(used), [-1] * len(used)
    queue, low = [(0, root)], 1
    for state, node in queue:
        value[state] = node.get(-1, -1)
        codes = sorted(c + 1 for c in node if c >= 0)
        if not codes:
            continue
        low = used.index(0, low)
        at = max(low, codes[0] + 1)
        while True:
            at = used.index(0, at)
            start = at - codes[0]
            if not any(used[start + c] for c in codes[1:]):
                break
            at += 1
        base[state] = start
        for c in codes:
            used[start + c], check[start + c] = 1, state
            queue.append((start + c, node[c - 1]))
        if start + 1024 > len(used):
            raise ValueError("too many pieces")
    size = max(i for i, u in enumerate(used) if u) + 258
    return tuple(np.array(x[:size], np.int32) for x in (base, check, value))


@dataclass
class Vocabulary:
    """Pieces with log scores; ids 0 to len - 1. byte_ids has the id of each byte's own piece."""

    surface: list[bytes]
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: float
    seen: dict[str, int] = field(default_factory=dict)
    #: Ids of the remembered units, one after the other, and where each unit's begin and the last one's end.
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    @classmethod
    def of(cls, pieces: list[str], scores: dict[int, float], byte_ids: list[int]) -> "Vocabulary":
        """scores: of the ordinary pieces, by id; the others (control, bytes) are never found in a text."""
        if len(byte_ids) != 256:
            raise ValueError("byte fallback needs a piece for each byte")
        if any(re.search(f"[^{MARKER}]{MARKER}", pieces[i]) for i in scores):
            raise ValueError("a piece has a marker after its beginning")
        ids = list(scores)
        base, check, value = double_array([pieces[i].encode() for i in ids])
        value = np.where(value >= 0, np.array([*ids, -1])[value], -1)
        log = np.full(len(pieces), -np.inf)
        log[ids] = [scores[i] for i in ids]
        surface = [p.replace(MARKER, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            surface[i] = bytes([b])
        return cls(surface, base, check, value, log, np.array(byte_ids), min(scores.values()) - UNKNOWN_BELOW)

    def viterbi(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the best segmentation of each unit, one after the other, and where each unit's end.

        All units advance together, a byte at a time. A character that is no
        piece itself stands as its bytes, at the unknown score. Of equal
        scores the one with the longer last piece wins.
        """
        n, width = len(units), max(map(len, units))
        size = np.fromiter(map(len, units), np.int64, n)
        text = np.frombuffer(b"".join(u.ljust(width, b"\0") for u in units), np.uint8).reshape(n, width).astype(np.int32)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        came = np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        for i in range(width):
            all_rows = rows = np.nonzero((best[:, i] > -np.inf) & (i < size))[0]
            state = np.zeros(len(rows), np.int32)
            first = text[rows, i]
            chars = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4)))
            whole = np.zeros(n, bool)
            end = np.zeros(n, np.int64)
            end[rows] = np.minimum(i + chars, size[rows])
            j = i
            while len(rows):
                to = self.base[state] + text[rows, j] + 1
                there = self.check[to] == state
                rows, state, j = rows[there], to[there], j + 1
                found = self.value[state]
                hit = found >= 0
                on, ids = rows[hit], found[hit]
                whole[on[end[on] == j]] = True
                score = best[on, i] + self.scores[ids]
                better = score > best[on, j]
                on = on[better]
                best[on, j], came[on, j], piece[on, j] = score[better], i, ids[better]
                more = j < size[rows]
                rows, state = rows[more], state[more]
            rows = all_rows[~whole[all_rows]]
            to = end[rows]
            score = best[rows, i] + self.unknown
            better = score > best[rows, to]
            rows, to = rows[better], to[better]
            best[rows, to], came[rows, to], piece[rows, to] = score[better], i, -1
        # Back from the ends; what is unknown gives one id for each of its bytes.
        out = np.full((n, width), -1, np.int32)
        at, rows = size.copy(), np.nonzero(size > 0)[0]
        while len(rows):
            stop = at[rows]
            start, ids = came[rows, stop], piece[rows, stop]
            known = ids >= 0
            out[rows[known], start[known]] = ids[known]
            for r, s, e in zip(rows[~known].tolist(), start[~known].tolist(), stop[~known].tolist(), strict=True):
                out[r, s:e] = self.byte_ids[text[r, s:e]]
            at[rows] = start
            rows = rows[start > 0]
        kept = out >= 0
        return out[kept], np.cumsum(kept.sum(axis=1))

    def _learn(self, units: list[str]) -> None:
        """Encode units that are new and remember their ids."""
        coded = [u.encode("utf-8", "surrogatepass") for u in units]
        order = sorted(range(len(units)), key=lambda i: len(coded[i]))
        found, bounds = [self.kept], [self.bounds]
        at = 0
        while at < len(order):
            width = len(coded[order[at]])
            take = 1
            while at + take < len(order):
                width = len(coded[order[at + take]])
                if width > LONG or (take + 1) * width > CELLS:
                    break
                take += 1
            part = order[at : at + take]
            ids, ends = self.viterbi([coded[i] for i in part])
            self.seen.update(zip(map(units.__getitem__, part), range(len(self.seen), len(self.seen) + take), strict=True))
            found.append(ids)
            bounds.append(ends + bounds[-1][-1])
            at += take
        self.kept, self.bounds = np.concatenate(found), np.concatenate(bounds)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the whole texts, one after the other, and where each text's end; none for null and empty texts.

        A text begins as if a space stood before it.
        """
        split = [UNIT.findall(MARKER + t.replace(" ", MARKER)) if t else [] for t in texts]
        new = {u for units in split for u in units if u not in self.seen}
        if len(self.seen) + len(new) > REMEMBER:
            self.seen.clear()
            self.kept, self.bounds = self.kept[:0], self.bounds[:1]
            new = {u for units in split for u in units}
        if new:
            self._learn(list(new))
        which = np.fromiter((i for units in split for i in map(self.seen.__getitem__, units)), np.int64)
        counts = self.bounds[which + 1] - self.bounds[which]
        ends = np.cumsum(counts)
        places = np.repeat(self.bounds[which + 1] - ends, counts) + np.arange(ends[-1] if len(ends) else 0)
        at = np.cumsum([len(units) for units in split])
        return self.kept[places], np.concatenate([[0], ends])[at]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: markers become spaces, byte pieces bytes, and the space put before the text goes."""
        joined = b"".join(map(self.surface.__getitem__, ids))
        return joined.removeprefix(b" ").decode("utf-8", "replace")

    def fresh(self) -> "Vocabulary":
        return Vocabulary(self.surface, self.base, self.check, self.value, self.scores, self.byte_ids, self.unknown)


@cache
def load_vocabulary(path: str, zipf: bool = False) -> Vocabulary:
    """The pieces of a SentencePiece model file with byte fallback, and their log scores.

    A unigram model has log probabilities, which count as they are. Those of
    other kinds (BPE) have ranks: they are refused, unless zipf is asked for,
    by which the piece of rank r has Zipf's frequency, 1 / r in proportion.
    The file says of which kind it is.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as file:
        spec = proto.ModelProto.FromString(file.read()).trainer_spec
    if spec.model_type != proto.TrainerSpec.UNIGRAM and not zipf:
        raise ValueError(f"{path} is no unigram model: its scores are no log probabilities; ask for zipf to read them as ranks")

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    plain = [i for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {i: model.get_score(i) for i in plain}
    ranked = sorted(plain, key=lambda i: (-scores[i], i))
    if zipf:
        whole = np.log(sum(1 / r for r in range(1, len(ranked) + 1)))
        scores = {i: float(-np.log(r) - whole) for r, i in enumerate(ranked, 1)}
    return Vocabulary.of([model.id_to_piece(i) for i in every], scores, [i for i in every if model.is_byte(i)])


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows with TEXT_AT_ONCE bytes, or a row that has more alone."""
    start = total = 0
    for i, size in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and total + (size or 0) > TEXT_AT_ONCE:
            yield start, i
            start, total = i, 0
        total += size or 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, zipf: bool = False) -> DataFrame:
    """docs with the ids of each whole text, an array of int (replacing a column of that name).

    With decoded_col what the ids decode to comes with them, as decode() gives it. zipf: see load_vocabulary().

    No shuffle: the vocabulary (its size is the model file's, not the data's)
    is broadcast, units of text are met by a bounded memory of each worker and
    encoded together if they are new. Null and empty texts have no ids;
    repeated rows get equal ids; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in (ids_col, decoded_col) if c])
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path, zipf).fresh())
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo, hi in _parts(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                found, ends = own.encode(part.column(at).to_pylist())
                bounds = np.concatenate([[0], ends])
                new = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found))]
                if decoded_col:
                    new.append(pa.array([own.decode(found[s:e].tolist()) for s, e in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*batch.schema.names, *[c for c in (ids_col, decoded_col) if c]])

    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with the text of each row's ids (replacing a column of that name); null ids give null.

    It undoes encode for every text without U+2581, which reads as a space.
    """
    docs = docs.drop(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path, True).fresh())  # decoding needs no scores
    at = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [None if ids is None or not ids.is_valid else own.decode(ids.values.to_pylist()) for ids in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(text_col, T.StringType())]))

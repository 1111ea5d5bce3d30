"""Embedding near-dedup: an exact range join by cosine over cells of pivots, bounded by the triangle inequality."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 (pa.compute)
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podia.llm.common import materialise
from podia.llm.components import components

SIMILARITY = 0.9
#: Vectors that pivots are chosen from. They only decide how much is compared, never what links.
PIVOT_SAMPLE = 4096
#: A table of n different vectors has sqrt(n / PER_PIVOT) pivots: cells and copies to the boundary then grow with the root.
PER_PIVOT = 100
#: Bytes of the vectors that a task holds and compares others with.
BLOCK_BYTES = 16 << 20
#: Cosines that are held at once.
AT_ONCE = 1 << 22
#: Allowance, in radians and as a cosine, for rounding in what only decides which vectors meet.
SLACK = 1e-6


def _digests(width: int):
    """Of rows (id, values): the id, the vector's bytes and their digest, both null where nothing can link."""
    kind = np.dtype(f"<f{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, data = [], []
            for values in batch.column(1):
                raw = None
                if values.is_valid and values.values.null_count == 0 and len(values.values):
                    vector = values.values.to_numpy(zero_copy_only=False).astype(kind) + kind.type(0)  # no negative zeros
                    wide = vector.astype(np.float64)
                    with np.errstate(over="ignore", invalid="ignore"):
                        scaled = wide / np.abs(wide).max() if wide.any() else wide
                    raw = vector.tobytes() if np.isfinite(wide).all() and scaled.any() else None
                data.append(raw)
                digests.append(None if raw is None else xxhash.xxh3_128_digest(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(data, pa.binary())], ["id", "digest", "data"])

    return run


def directions(data: list[bytes], width: int) -> np.ndarray:
    """The vectors, all of one length, as rows of length 1 in double precision."""
    wide = np.frombuffer(b"".join(data), f"<f{width}").reshape(len(data), -1).astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, k: int, angle: float) -> list[int]:
    """Places of up to k rows of sample, no two within angle: those with most others within half the angle first."""
    counts, strip = np.zeros(len(sample), np.int64), _strip(len(sample))
    for at in range(0, len(sample), strip):
        counts[at : at + strip] = (sample[at : at + strip] @ sample.T >= np.cos(angle / 2 - SLACK)).sum(axis=1)
    free, chosen = np.ones(len(sample), bool), []
    for i in np.argsort(-counts, kind="stable").tolist():
        if len(chosen) == k:
            break
        if free[i]:
            chosen.append(i)
            free &= sample @ sample[i] < np.cos(angle)
    return chosen


class Cells:
    """Pivots by length of vector, and what is known of their cells.

    A cell is what is nearest to a pivot; it has two rings: the core, within
    half the angle of the pivot, whose members all link with each other, and the
    rest. Ring 2 * pivot is a core, 2 * pivot + 1 a rest. A length without a pivot has
    one rest, whose number is -1.
    """

    def __init__(self, pivots: dict[int, np.ndarray], names: dict[int, list[int]], angle: float) -> None:
        self.pivots, self.angle = pivots, angle
        #: By length, the number of the first pivot; by pivot, its node.
        self.first: dict[int, int] = {}
        self.names: list[int] = []
        for dim in sorted(pivots):
            self.first[dim] = len(self.names)
            self.names += names[dim]
        #: By length and ring: least and greatest angle to the pivot, members, their copies.
        self.rings: dict[tuple[int, int], tuple[float, float, int, int]] = {}

    def of(self, dim: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest pivot's place and angle, and the angles to all pivots."""
        angles = np.arccos(np.clip(rows @ self.pivots[dim].T, -1, 1))
        place = angles.argmin(axis=1)
        return place, angles[np.arange(len(rows)), place], angles

    def ring(self, dim: int, place: np.ndarray, near: np.ndarray) -> np.ndarray:
        return 2 * (self.first[dim] + place) + (near > self.angle / 2 - SLACK)

    def blocks(self, dim: int, rings: np.ndarray, width: int) -> np.ndarray:
        """Into how many blocks, dealt by number, each ring's members are cut."""
        members = np.array([self.rings.get((dim, r), (0, 0, 0, 0))[2] for r in rings.tolist()], np.int64)
        return np.maximum(1, -(-members * dim * width // BLOCK_BYTES))

    def targets(self, dim: int, place: np.ndarray, near: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, ring): the rings of others that may hold a vector within the angle of a row, if that row is the one to go there.

        By the triangle inequality a member's angle to its pivot differs from the
        row's by no more than the angle; and as the member is nearest to its own
        pivot, the row lies no farther than the angle's chord beyond the plane between that
        pivot and its own. Of two rings, members of a rest go to a core; between two of a kind the
        parity of their numbers decides, so that each gets about as many guests as it sends.
        """
        reach, pivots, first = self.angle + SLACK, self.pivots[dim], self.first[dim]
        gap = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-30))
        here = np.arange(len(pivots))[None, :] == place[:, None]
        beyond = (np.cos(near)[:, None] - np.cos(angles)) / gap[place]
        side = here | (beyond <= 2 * np.sin(self.angle / 2) + SLACK)
        core = (near <= self.angle / 2 - SLACK)[:, None]
        number, own = np.arange(len(pivots))[None, :], place[:, None]
        turn = (number != own) & ((number < own) ^ ((number + own) % 2 == 1))
        rows, rings = [], []
        for rest in (0, 1):
            bounds = [self.rings.get((dim, 2 * (first + p) + rest), (np.inf, -np.inf, 0, 0)) for p in range(len(pivots))]
            low, high = (np.array([x[c] for x in bounds]) for c in (0, 1))
            may = side & (angles >= low - reach) & (angles <= high + reach) & (turn & ~core if rest else turn | ~core)
            i, p = np.nonzero(may)
            rows.append(i)
            rings.append(2 * (first + p) + rest)
        return np.concatenate(rows), np.concatenate(rings)


def _by_length(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Batches of nodes (node, copies, data), cut to `most` rows and by length of vector: (length, batch, directions)."""
    for whole in batches:
        for at in range(0, whole.num_rows, most):
            batch = whole.slice(at, most)
            lengths = pa.compute.binary_length(batch.column(2)).to_numpy() // width
            for dim in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.nonzero(lengths == dim)[0]))
                yield dim, part, directions(part.column(2).to_pylist(), width)


def _stats(cells: Cells, width: int):
    """Of nodes: by length and ring, the least and greatest angle to the pivot, members and copies; a row a ring and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch, rows in _by_length(batches, width, _strip(len(cells.names))):
            near, rings = np.zeros(len(rows)), np.full(len(rows), -1)
            if dim in cells.first:
                place, near, _ = cells.of(dim, rows)
                rings = cells.ring(dim, place, near)
            kinds, inverse = np.unique(rings, return_inverse=True)
            low, high = np.full(len(kinds), np.inf), np.zeros(len(kinds))
            np.minimum.at(low, inverse, near)
            np.maximum.at(high, inverse, near)
            members, copies = np.bincount(inverse), np.bincount(inverse, batch.column(1).to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(kinds), dim), kinds, low, high, members, copies)], ["dim", "ring", "low", "high", "members", "copies"])

    return run


def _strip(others: int) -> int:
    """How many vectors are held against so many others at once."""
    return max(16, AT_ONCE // max(1, others))


def _deal(cells: Cells, width: int):
    """Of nodes (node, copies, data): a row for each block where they are compared, guest or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, batch, rows in _by_length(batches, width, _strip(64 * len(cells.names))):
            every, own = np.arange(len(rows)), np.full(len(rows), -1)
            i, rings = every[:0], own[:0]
            if dim in cells.first:
                place, near, angles = cells.of(dim, rows)
                own = cells.ring(dim, place, near)
                i, rings = cells.targets(dim, place, near, angles)
            block = batch.column(0).to_numpy() % cells.blocks(dim, own, width)
            before = np.where(own % 2 == 1, block, 0)  # blocks of its own rest that it visits; a core needs none
            times = cells.blocks(dim, rings, width)
            place = np.concatenate([every, np.repeat(every, before), np.repeat(i, times)])
            ring = np.concatenate([own, np.repeat(own, before), np.repeat(rings, times)])
            part = np.concatenate([block, *(np.arange(n) for n in (*before.tolist(), *times.tolist()) if n)])
            guest = np.concatenate([np.zeros(len(rows), np.int64), np.ones(len(place) - len(rows), np.int64)])
            dealt = batch.take(pa.array(place))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), dim)), pa.array(ring), pa.array(part), pa.array(guest), *dealt.columns], ["dim", "ring", "block", "guest", "node", "copies", "data"])

    return run


class Block:
    """A block's own vectors, and what is found of their links: rows (a, null, links of a), and (a, b, 0) for links that join."""

    def __init__(self, cells: Cells, dim: int, ring: int, similarity: float, width: int) -> None:
        core = ring >= 0 and ring % 2 == 0
        self.core = (cells.rings[dim, ring][3], cells.names[ring // 2]) if core else None
        self.similarity, self.width = similarity, width
        self.data: list[bytes] = []
        self.nodes: list[int] = []
        self.copies: list[int] = []
        self.rows = None

    def close(self) -> Iterator[tuple[int, int | None, int]]:
        """All own vectors are there: their links among themselves."""
        self.rows, self.data = directions(self.data, self.width), []
        self.ids, self.weights = np.array(self.nodes), np.array(self.copies)
        self.found = np.zeros(len(self.ids), np.int64)
        self.root = np.arange(len(self.ids))
        if self.core:  # all within half the angle of the pivot
            total, pivot = self.core
            self.found += total - self.weights
            self.root[:] = 0
            yield from ((x, pivot, 0) for x in self.ids.tolist() if x != pivot)
            return
        strip = _strip(len(self.ids))
        for at in range(0, len(self.ids), strip):
            close = self.rows[at : at + strip] @ self.rows[at:].T >= self.similarity
            close[:, : len(close)] = np.triu(close[:, : len(close)], 1)
            i, j = np.nonzero(close)
            self._count(self.found, i + at, self.weights[j + at])
            self._count(self.found, j + at, self.weights[i + at])
            yield from self._join(i + at, j + at)

    @staticmethod
    def _count(found: np.ndarray, places: np.ndarray, weights: np.ndarray) -> None:
        if len(places):
            found += np.bincount(places, weights, len(found)).astype(np.int64)

    def _join(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int | None, int]]:
        """Of links between own vectors, as few as join what isn't joined yet."""
        while True:
            apart = self.root[i] != self.root[j]
            i, j = i[apart], j[apart]
            if not len(i):
                return
            a, b = self.root[i], self.root[j]
            high, once = np.unique(np.maximum(a, b), return_index=True)  # one link a root and turn
            to = np.arange(len(self.root))
            to[high] = np.minimum(a, b)[once]
            yield from ((x, y, 0) for x, y in zip(self.ids[i[once]].tolist(), self.ids[j[once]].tolist(), strict=True))
            while (to[to] != to).any():
                to = to[to]
            self.root = to[self.root]

    def meet(self, data: list[bytes], nodes: np.ndarray, copies: np.ndarray) -> Iterator[tuple[int, int | None, int]]:
        """Links of own vectors with guests."""
        strip = _strip(len(self.ids))
        for at in range(0, len(data), strip):
            close = directions(data[at : at + strip], self.width) @ self.rows.T >= self.similarity
            i, j = np.nonzero(close)
            if not len(i):
                continue
            guests, first, i = np.unique(i, return_index=True, return_inverse=True)
            ids, lead = nodes[at : at + strip][guests], j[first]
            counts = np.zeros(len(guests), np.int64)
            self._count(counts, i, self.weights[j])
            self._count(self.found, j, copies[at : at + strip][guests][i])
            for node, n, own in zip(ids.tolist(), counts.tolist(), self.ids[lead].tolist(), strict=True):
                yield node, None, n
                yield node, own, 0
            yield from self._join(lead[i], j)

    def counts(self) -> Iterator[tuple[int, int | None, int]]:
        """The links found of own vectors."""
        some = np.nonzero(self.found)[0]
        yield from ((x, None, n) for x, n in zip(self.ids[some].tolist(), self.found[some].tolist(), strict=True))


def _compare(cells: Cells, similarity: float, width: int):
    """Of rows sorted by block, own vectors first: what Block finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def put(found: Iterator[tuple]) -> pa.RecordBatch:
            rows = list(found)
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows], pa.int64()) for c in range(3)], ["a", "b", "links"])

        def ended() -> Iterator[pa.RecordBatch]:
            if block.rows is None:
                yield put(block.close())
            yield put(block.counts())

        now, block = None, None
        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy() for c in range(4)])
            cuts = (np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist()
            for s, e in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if s == e:
                    continue
                dim, ring, number, guest = keys[s].tolist()
                nodes, copies, data = batch.slice(s, e - s).columns[4:]
                if (dim, ring, number) != now:
                    if block is not None and block.nodes:
                        yield from ended()
                    now, block = (dim, ring, number), Block(cells, dim, ring, similarity, width)
                if not guest:
                    block.data += data.to_pylist()
                    block.nodes += nodes.to_pylist()
                    block.copies += copies.to_pylist()
                elif block.nodes:
                    if block.rows is None:
                        yield put(block.close())
                    yield put(block.meet(data.to_pylist(), nodes.to_numpy(), copies.to_numpy()))
        if block is not None and block.nodes:
            yield from ended()

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of vectors: those whose cosine is at least similarity link.

    n_links counts the other vectors linked directly, component_id is the
    smallest id reachable by links, itself included, and kept says that this is the row's
    own. Cosines are computed in double precision. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths. A null id is no component_id unless all of its component
    are null; rows that repeat an id are vectors of their own. An empty
    table gives an empty result; other columns are ignored. similarity lies above 0.

    Equal vectors are one node. Every node goes to the cell of its nearest pivot, and as a guest to those
    cells before it in order which the triangle inequality can't rule out, so that each pair meets just
    once. What is within half the angle of a pivot links without a comparison, so a dense group costs no more than its size.
    Large cells are cut into blocks; a task holds a block and streams its guests.
    Counts are summed where they are found and links are as few as join: no pair is a row.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity lies above 0 and is 1 at most")
    spark = vectors.sparkSession
    element, width = ("float", 4) if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else ("double", 8)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{element}>").alias("values"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = materialise(rows.mapInArrow(_digests(width), f"id {kind}, digest binary, data binary"), "vectors")
    nodes = rows.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.first("data").alias("data"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    bare = nodes.select("node", "copies", "data")

    n = nodes.count()
    sample = bare.orderBy(nodes["digest"]).limit(PIVOT_SAMPLE).collect()
    angle = math.acos(similarity)
    pivots, names = {}, {}
    for dim in {len(r.data) // width for r in sample}:
        same = [r for r in sample if len(r.data) == dim * width]
        rows_of = directions([bytes(r.data) for r in same], width)
        chosen = choose_pivots(rows_of, math.ceil(math.sqrt(n / PER_PIVOT) * len(same) / len(sample)), angle)
        pivots[dim], names[dim] = rows_of[chosen], [same[i].node for i in chosen]
    cells = Cells(pivots, names, angle)
    stats = bare.mapInArrow(_stats(cells, width), "dim long, ring long, low double, high double, members long, copies long")
    stats = stats.groupBy("dim", "ring").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("members").alias("members"), F.sum("copies").alias("copies"))
    cells.rings = {(r.dim, r.ring): (r.low, r.high, r.members, r.copies) for r in stats.collect()}

    dealt = bare.mapInArrow(_deal(cells, width), "dim long, ring long, block long, guest long, node long, copies long, data binary")
    dealt = dealt.repartition("dim", "ring", "block").sortWithinPartitions("dim", "ring", "block", "guest")
    found = materialise(dealt.mapInArrow(_compare(cells, similarity, width), "a long, b long, links long"), "vector-links")
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    edges = found.filter("b is not null").select("a", "b")
    roots = components(edges)
    met = nodes.select("node", "digest", "first", "copies").join(roots, "node", "left").join(links, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = materialise(met.select("digest", "first", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vectors-linked")
    least = met.groupBy("root").agg(F.min("first").alias("component"))
    answer = met.join(least, "root").select("digest", "n_links", "component")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component"))
    linked = rows.filter("digest is not null").select("id", "digest").join(answer, "digest")
    alone = rows.filter("digest is null").select("id", "digest").withColumns({"n_links": F.lit(0).cast("long"), "component": F.lit(None).cast(kind)})
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))

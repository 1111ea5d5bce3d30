"""Conversation structure repair: the cheapest edits that give turns the order system?, (user, assistant)+."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podia.llm.common import small_batches

#: What edits cost; a truncated turn that isn't deleted adds REROLE once more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What the retained turns end with: nothing yet, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Turns to insert between what the retained turns end with and the next one's role, and before the end; None: not allowed.
BETWEEN = {
    SYSTEM: {NONE: 0, SYSTEM: None, USER: None, ASSISTANT: None},
    USER: {NONE: 0, SYSTEM: 0, USER: 1, ASSISTANT: 0},
    ASSISTANT: {NONE: 1, SYSTEM: 1, USER: 0, ASSISTANT: 1},
}
AT_END = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Letters that a row may add to an audit, ASCII-least first; none is another's prefix.
STEPS = ("D", "IK", "IR", "K", "R")
LEGAL = {"su", "ua", "au"}
FAR = float("inf")


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults drawn by crc32("conv_id:turn") % 20, and `present`.

    0 drops the row (present is false), 1 empties its text, 2 removes its
    `[.!?]`, 3 repeats it, 4 makes it the user's. A null is one space: in the drawn
    text, as a role and as a text; ids and turns themselves stay null.
    """
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(named.cast("binary")) % 20
    plain = rows.select("conv_id", "turn", F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), times.alias("copy")).drop("copy")


def fault(text: bytes) -> str:
    """blank, truncated or nothing: what a text alone shows."""
    inner = text.strip()
    return "blank" if not inner else "" if inner[-1:] in (b".", b"!", b"?") else "truncated"


class Repair:
    """One conversation's counts and cheapest edits, fed turn by turn.

    Dynamic programming over the retained (kept or reroled) turns. A gap
    between two of them costs the deletions in it, a difference of prefix sums,
    and the turns that their roles require to be inserted; so for each state, what
    retained turns end with, only the least cost less the prefix sum is needed.
    Equal costs are settled by the audits: a state's audit has all
    turns so far and no insertion at its end, so none is another's prefix, and
    their order decides that of all that begin with them. Each state carries its
    place in that order and the digest of its repaired turns; texts are never
    held. Held are four bytes a turn to trace the audit back, and a
    digest of each turn to tell duplicates.
    """

    def __init__(self) -> None:
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns: tuple[int, int, int] | None = None  # least, greatest, distinct
        self.before: str | None = None
        self.seen: set[bytes] = set()
        self.deleted = 0
        self.least: list[float] = [0, FAR, FAR, FAR]
        self.place = [0, 1, 2, 3]
        self.digest = [hashlib.sha256() for _ in range(4)]
        self.back = bytearray()

    def add(self, turn: int | None, role: str, text: bytes) -> None:
        """The next turn; those with a turn number come in its order."""
        if turn is not None:
            low, high, n = self.turns or (turn, turn, 0)
            self.turns = low, turn, n + (not n or turn != high)
        initial = role[:1]
        if self.before is not None:
            self.counts["illegal"] += self.before + initial not in LEGAL
        self.before = initial
        own = role.encode("utf-8", "surrogatepass")
        said = hashlib.blake2b(b"%d:%b%b" % (len(own), own, text), digest_size=16).digest()
        what = fault(text)
        if what != "blank" and said in self.seen:
            what = "duplicate"
        self.seen.add(said)
        if what:
            self.counts[what] += 1
        self._edit(initial, what, own, text)

    def _edit(self, initial: str, what: str, role: bytes, text: bytes) -> None:
        before, after = self.deleted, self.deleted + DELETE
        found = [(self.least[s], self.place[s], 0, s) for s in range(4)]  # deleted: the least cost stays as it is
        if what not in ("blank", "duplicate"):
            extra = TRUNCATED if what == "truncated" else 0
            ways = [(STATE[initial], "K", extra)] if initial in STATE else []
            for to, letter, cost in [*ways, (USER, "R", REROLE + extra), (ASSISTANT, "R", REROLE + extra)]:
                for s, inserts in BETWEEN[to].items():
                    if inserts is not None and self.least[s] < FAR:
                        step = STEPS.index("I" * inserts + letter)
                        found[to] = min(found[to], (self.least[s] + before + INSERT * inserts + cost - after, self.place[s], step, s))
        self.deleted = after
        self.back += bytes(5 * s + step for _, _, step, s in found)
        order = sorted(range(4), key=lambda s: found[s][1:3])
        self.digest = [self._said(STEPS[step], s, to, role, text) for to, (_, _, step, s) in enumerate(found)]
        self.least = [x[0] for x in found]
        self.place = [order.index(s) for s in range(4)]

    def _said(self, step: str, state: int, to: int, role: bytes, text: bytes):
        """The digest of state's repaired turns with what step adds."""
        if step == "D":
            return self.digest[state]
        out = self.digest[state].copy()
        for letter in step:
            out.update(b"\n" if state != NONE else b"")
            state = to if letter == "K" else _next(state)
            out.update(role if letter == "K" else _ROLE[state])
            out.update(b":")
            if letter != "I":
                out.update(text)
        return out

    def result(self) -> dict:
        """gaps, the counts of faults, the least cost, its audit and the digest of the repaired turns."""
        cost, _, _, state = min((self.least[s] + self.deleted + INSERT * n, self.place[s], "I" * n, s) for s, n in AT_END.items())
        tail = "I" * AT_END[state]
        digest = self.digest[state]
        end = state
        for _ in tail:
            digest = digest.copy()
            digest.update(b"\n")
            end = _next(end)
            digest.update(_ROLE[end] + b":")
        letters = [tail]
        for at in range(len(self.back) - 4, -1, -4):
            state, step = divmod(self.back[at + state], 5)
            letters.append(STEPS[step])
        low, high, n = self.turns or (0, -1, 0)
        return {"gaps": high - low + 1 - n, **self.counts, "cost": int(cost), "audit": "".join(reversed(letters)), "repaired_sha256": digest.hexdigest()}


_ROLE = {USER: b"user", ASSISTANT: b"assistant"}


def _next(state: int) -> int:
    """What a turn of a free role is, behind state."""
    return ASSISTANT if state == USER else USER


COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _columns(rows: DataFrame) -> DataFrame:
    """rows dealt by conversation, each in the order of its turns; ties by role and text, by bytes."""
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in rows.columns else F.lit(True)
    cols = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), present.alias("present"))
    small_batches(rows.sparkSession)
    return cols


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split()[0] for x in COUNTS.split(",")]
    now, repair = None, None
    for batch in batches:
        done: list[tuple] = []
        convs = batch.column(0).to_pylist()
        for i, conv in enumerate(convs):
            if repair is None or conv != now:
                if repair is not None:
                    done.append((now, repair.result()))
                now, repair = conv, Repair()
            if batch.column(4)[i].as_py():
                repair.add(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3)[i].as_buffer().to_pybytes())
        yield _batch(batch.schema.field(0).type, names, done)
    if repair is not None:
        yield _batch(batch.schema.field(0).type, names, [(now, repair.result())])


def _batch(kind: pa.DataType, names: list[str], done: list[tuple]) -> pa.RecordBatch:
    numbers = {n: pa.int64() for n in names[:-2]}
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], kind), *(pa.array([x[1][n] for x in done], numbers.get(n, pa.string())) for n in names)], ["conv_id", *names])


def repairs(rows: DataFrame) -> DataFrame:
    """One row per conv_id of rows (conv_id, turn, role, text, and perhaps present): its faults and its cheapest repair.

    Columns: gaps, blank, duplicate, truncated, illegal, cost, audit (the
    letters of Keep, Rerole, Delete, Insert in order; of equal costs the ASCII-least), and
    repaired_sha256, the SHA-256 of the repaired `role:text` lines. Turns are taken by
    turn, nulls first; of equal turns by role and text. Rows whose present is
    false only show that there is such a conversation: without others it has
    zeros, an empty audit and the digest of nothing. A null role or text is one
    space, a null conv_id a conversation like any other; repeated rows are duplicates.
    A turn whose role is empty has no initial, so it can't be kept as it is.
    An empty table gives an empty result; other columns are ignored.

    A conversation's audit and digest are single values over all its turns in order, so one task reads them;
    it streams them, and holds of each no more than Repair says, never texts.
    """
    cols = _columns(rows)
    kind = cols.schema["conv_id"].dataType.simpleString()
    return cols.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_repairs, f"conv_id {kind}, {COUNTS}")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by conversation, its audit first: the repaired turns."""
    audit, at, place, state = "", 0, 0, NONE
    for batch in batches:
        out: list[tuple] = []

        def put(conv, turn, role, text, letter, out=out):
            nonlocal place
            out.append((conv, place, turn, role, text, letter))
            place += 1

        def inserts(conv):
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                at, state = at + 1, _next(state)
                put(conv, None, _ROLE[state].decode(), "", "I")

        for conv, turn, role, text, present, edits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if edits is not None:
                audit, at, place, state = edits, 0, 0, NONE
                inserts(conv)
            elif present:
                letter = audit[at]
                at += 1
                if letter == "K":
                    state = STATE[role[:1]]
                    put(conv, turn, role, text, "K")
                elif letter == "R":
                    state = _next(state)
                    put(conv, turn, _ROLE[state].decode(), text, "R")
                inserts(conv)
        kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["conv_id", "place", "turn", "role", "text", "edit"])


def repaired_turns(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the turns that repairs() of the same rows, in `repaired`, leaves or inserts.

    edit is K, R or I; place counts from 0 within the conversation. An
    inserted turn has no turn number and an empty text.
    """
    cols = _columns(rows).withColumn("audit", F.lit(None).cast("string"))
    empty = {"turn": F.lit(None).cast("long"), "role": F.lit(""), "text": F.lit(""), "present": F.lit(False)}
    first = repaired.select("conv_id", "audit").withColumns(empty).select(*cols.columns)
    kind = cols.schema["conv_id"].dataType.simpleString()
    dealt = first.unionByName(cols).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "text")
    return dealt.mapInArrow(_apply, f"conv_id {kind}, place long, turn long, role string, text string, edit string")

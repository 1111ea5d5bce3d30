"""Who met whom how often: wins and meets of all pairs of athletes, without shuffling pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Meetings counted and rows held by one task, about; and meetings counted at once within it.
TASK_MEETS, TASK_ROWS, AT_ONCE = 20_000_000, 1_000_000, 1_000_000
#: With top: rows of a block, about, and blocks that the number of meetings alone may ask for.
BLOCK_ROWS, MOST_BLOCKS = 3_000_000, 8
#: Athletes of either side whose common races are multiplied at once, pairs counted at once, and cells of a table by athlete and race held at once.
ROWS_AT_ONCE, COLUMNS_AT_ONCE, PAIRS_AT_ONCE, MOST_CELLS = 256, 8192, 20_000, 4_000_000
#: Athletes among whom a first guess at another's best is sought.
GUESSED = 1024
#: Cells that a product passes in the time in which one meeting is counted.
CELLS_A_MEETING = 500


def _met(left: pd.DataFrame, right: pd.DataFrame, same: bool, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, a_wins, meets) of codes that met at least `least` times, for stretches of a; if both sides are the same, a < b.

    Both tables have race, who, rank, the right one sorted by race. A stretch has every
    meeting of its athletes, and about AT_ONCE of them, or one athlete's.
    """
    first = np.searchsorted(right["race"].to_numpy(), left["race"].to_numpy(), "left")
    size = np.searchsorted(right["race"].to_numpy(), left["race"].to_numpy(), "right") - first
    b_who, b_rank = right["who"].to_numpy(), right["rank"].to_numpy()
    order = np.argsort(left["who"].to_numpy(), kind="stable")
    who, rank, first, size = left["who"].to_numpy()[order], left["rank"].to_numpy()[order], first[order], size[order]
    width = int(b_who.max(initial=0)) + 1
    starts = np.flatnonzero(np.append(True, who[1:] != who[:-1])[: len(who)])
    load = np.add.reduceat(size, starts) if len(who) else size
    at = 0
    while at < len(starts):
        stop = at + max(1, int(np.searchsorted(np.cumsum(load[at:]), AT_ONCE, "right")))
        lo, hi = starts[at], starts[stop] if stop < len(starts) else len(who)
        at = stop
        n, base = size[lo:hi], int(who[lo])
        places = np.repeat(first[lo:hi] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        key = np.repeat((who[lo:hi] - base) * width, n) + b_who[places]
        lead = b_rank[places] - np.repeat(rank[lo:hi], n)
        keep = lead != 0
        if same:
            keep &= np.repeat(who[lo:hi], n) < b_who[places]
        key, lead = key[keep], lead[keep]
        span = (int(who[hi - 1]) - base + 1) * width
        if span <= 8 * len(key):
            meets, wins = np.bincount(key, minlength=span), np.bincount(key[lead > 0], minlength=span)
            found = np.flatnonzero(meets >= least)
            meets, wins = meets[found], wins[found]
        else:
            found, back, meets = np.unique(key, return_inverse=True, return_counts=True)
            wins = np.bincount(back[lead > 0], minlength=len(found))
            enough = meets >= least
            found, meets, wins = found[enough], meets[enough], wins[enough]
        yield found // width + base, found % width, wins, meets


def _best(me: np.ndarray, other: np.ndarray, wins: np.ndarray, meets: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """The first `top` rows of each me: most meets, then most wins, then the least code of the other."""
    order = np.lexsort((other, -wins, -meets, me))
    whose = me[order]
    begin = np.flatnonzero(np.append(True, whose[1:] != whose[:-1])[: len(whose)])
    place = np.arange(len(whose)) - np.repeat(begin, np.diff(np.append(begin, len(whose))))
    kept = order[place < top]
    return me[kept], other[kept], wins[kept], meets[kept]


class _Table:
    """Some athletes of a side: how many rows each has in which race, and the first of them."""

    def __init__(self, side: _Side, lo: int, hi: int):
        self.lo, self.hi = lo, min(hi, len(side.who))
        begin, end = side.start[self.lo], side.start[self.hi]
        cell = np.repeat(np.arange(self.hi - self.lo), side.n[self.lo : self.hi]) * side.races + side.race[begin:end]
        shape = self.hi - self.lo, side.races
        self.times = np.bincount(cell, minlength=shape[0] * shape[1]).astype(np.float32).reshape(shape)
        new = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
        self.first = np.zeros(shape, np.int32)
        self.first.ravel()[cell[new]] = begin + new


class _Side:
    """Athletes of a block, those with most rows first, with their rows by athlete and race; best meetings so far, and the fewest that can be among them."""

    def __init__(self, who: np.ndarray, race: np.ndarray, rank: np.ndarray, races: int, least: int):
        codes, at, n = np.unique(who, return_inverse=True, return_counts=True)
        busy = np.argsort(-n, kind="stable")
        place = np.empty(len(busy), np.int32)
        place[busy] = np.arange(len(busy))
        at = place[at]
        order = np.lexsort((race, at))
        self.races, self.who, self.n = races, codes[busy], n[busy]
        self.race, self.rank = race[order], rank[order]
        self.start = np.append(0, np.cumsum(self.n))
        self.enough = np.full(len(codes), least, np.float32)
        self.guessed = np.zeros(len(codes), bool)
        self.best: dict[tuple[str, int], tuple[np.ndarray, ...]] = {}

    def keep(self, part: tuple[str, int], lo: int, hi: int, found: list[tuple[np.ndarray, ...]], top: int) -> None:
        """Put found (athlete's place, other, wins, meets) of places lo to hi to the best of a part of the work."""
        best = _best(*(np.concatenate(x) for x in zip(self.best.get(part, (np.zeros(0, np.int64),) * 4), *found, strict=True)), top)
        self.best[part] = best
        n = np.bincount(best[0] - lo, minlength=hi - lo)
        full = np.flatnonzero(n == top)
        self.enough[lo + full] = np.maximum(self.enough[lo + full], best[3][np.cumsum(n)[full] - 1])

    def all(self) -> tuple[np.ndarray, ...]:
        me, *others = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 4, *self.best.values(), strict=True))
        return self.who[me], *others


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of n[i] things, i and the thing's place."""
    whose = np.repeat(np.arange(len(n)), n)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(n) - n, n)


def _counted(a: _Side, b: _Side, table: _Table, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wins of a's athletes i over b's athletes j of a table, and their meetings; equal ranks are none."""
    wins, meets = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for lo in range(0, len(i), PAIRS_AT_ONCE):
        some = slice(lo, lo + PAIRS_AT_ONCE)
        pair, place = _spread(a.n[i[some]])
        row = a.start[i[some]][pair] + place
        cell = (j[some] - table.lo)[pair], a.race[row]
        met, place = _spread(table.times[cell].astype(np.int64))
        lead = b.rank[table.first[cell][met] + place] - a.rank[row][met]
        meets[some] = np.bincount(pair[met[lead != 0]], minlength=len(i[some]))
        wins[some] = np.bincount(pair[met[lead > 0]], minlength=len(i[some]))
    return wins, meets


def _guess(a: _Side, b: _Side, table: _Table, both: np.ndarray, lo: int, top: int, columns: bool) -> None:
    """For athletes met for the first time: how often the `top`-th of some likely others met them."""
    likely = both[:, :GUESSED] if not columns else both.T
    side, first = (b, table.lo) if columns else (a, lo)
    new = np.flatnonzero(~side.guessed[first : first + len(likely)])
    if not len(new) or likely.shape[1] <= 4 * top:
        return
    side.guessed[first + new] = True
    mine, others = np.repeat(new, 2 * top), np.argpartition(-likely[new], 2 * top, axis=1)[:, : 2 * top].ravel()
    i, j = (others, mine) if columns else (mine, others)
    met = np.where(both[i, j] < 0, 0, _counted(a, b, table, i + lo, j + table.lo)[1]).reshape(len(new), 2 * top)
    side.enough[first + new] = np.maximum(side.enough[first + new], np.sort(met, axis=1)[:, -top])


def _nearest(a: _Side, b: _Side, top: int) -> None:
    """Leave with each athlete of two sides (or of one, given twice) the first `top` of the other, by _best().

    A product of two tables by athlete and race gives how often two athletes
    were in one race: no fewer than they met. Only pairs for which that isn't
    less than the meetings of the `top`-th best so far of either are counted
    themselves. Each pair is multiplied once, and tables are held for some athletes at a time.
    """
    columns = max(1, min(COLUMNS_AT_ONCE, MOST_CELLS // max(1, b.races)))
    for at in range(0, len(b.who), columns):
        table = _Table(b, at, at + columns)
        waiting: list[tuple[np.ndarray, ...]] = []
        for lo in range(0, table.hi if a is b else len(a.who), ROWS_AT_ONCE):
            mine = _Table(a, lo, lo + ROWS_AT_ONCE)
            both = mine.times @ table.times.T
            if a is b and mine.hi > at:
                both[np.arange(mine.lo, mine.hi)[:, None] >= np.arange(at, table.hi)] = -1
            _guess(a, b, table, both, lo, top, columns=False)
            _guess(a, b, table, both, lo, top, columns=True)
            i, j = np.divmod(np.flatnonzero((both >= a.enough[lo : mine.hi, None]) | (both >= b.enough[at : table.hi])), both.shape[1])
            for some in range(0, len(i), AT_ONCE):
                x, y = i[some : some + AT_ONCE] + lo, j[some : some + AT_ONCE] + at
                wins, meets = _counted(a, b, table, x, y)
                far = meets >= a.enough[x]
                a.keep(("row", lo), lo, mine.hi, [(x[far], b.who[y[far]], wins[far], meets[far])], top)
                far = meets >= b.enough[y]
                waiting.append((y[far], a.who[x[far]], (meets - wins)[far], meets[far]))
                if sum(len(w[0]) for w in waiting) > 2 * columns:
                    b.keep(("column", at), at, table.hi, waiting, top)
                    waiting = []
        b.keep(("column", at), at, table.hi, waiting, top)


def _top(left: pd.DataFrame, right: pd.DataFrame, same: bool, least: int, top: int) -> tuple[np.ndarray, ...]:
    """(a, b, a_wins, meets): of the meetings of two blocks, or of one, the first `top` of each athlete, by the cheaper of two ways."""
    races = np.unique(np.concatenate([left["race"].unique(), right["race"].unique()]))
    coded = [np.searchsorted(races, x["race"].to_numpy()).astype(np.int32) for x in ([left] if same else [left, right])]
    in_left, in_right = (np.bincount(x, minlength=len(races)).astype(float) for x in (coded[0], coded[-1]))
    n_left, n_right = left["who"].nunique(), right["who"].nunique()
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
    if float(n_left) * n_right * len(races) <= CELLS_A_MEETING * (in_left @ in_right):
        sides = [_Side(x["who"].to_numpy(), code, x["rank"].to_numpy(), len(races), least) for x, code in zip([left, right], coded, strict=False)]
        del coded
        _nearest(sides[0], sides[-1], top)
        found += [x.all() for x in sides]
    else:
        for a, b, wins, meets in _met(left, right.sort_values("race", kind="stable"), same, least):
            found += [_best(a, b, wins, meets, top), _best(b, a, meets - wins, meets, top)]
            if sum(len(x[0]) for x in found[1:]) > AT_ONCE:
                found = [_best(*(np.concatenate(x) for x in zip(*found, strict=True)), top)]
    return _best(*(np.concatenate(x) for x in zip(*found, strict=True)), top)


def _rows(group: pa.Table, codes: np.ndarray, of: np.ndarray | None) -> pd.DataFrame:
    """(race, rank, who) of a group's athletes that are chosen, taken from its lists without an object for each; races are numbered."""
    races = np.unique(np.concatenate([np.unique(x.flatten().to_numpy()) for x in group["race"].chunks]))
    found, at = [], 0
    for batch in group.select(["race", "rank"]).to_batches():
        whose, at = codes[at : at + len(batch)], at + len(batch)
        if of is not None:
            chosen = of[at - len(batch) : at]
            batch, whose = batch.filter(pa.array(chosen)), whose[chosen]
        race, rank = batch.column(0), batch.column(1)
        found.append((np.searchsorted(races, race.flatten().to_numpy()).astype(np.int32), _narrow(rank.flatten().to_numpy()), np.repeat(whose, pc.list_value_length(race).to_numpy())))
    race, rank, who = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"race": race, "rank": rank, "who": who}, copy=False)


def _narrow(ranks: np.ndarray) -> np.ndarray:
    return ranks.astype(np.int32) if len(ranks) and ranks.min() >= 0 and ranks.max() < 2**31 else ranks


def pairs(rows: DataFrame, least: int, top: int | None = None) -> DataFrame:
    """Of rows (who, race, rank): (a, b, a_wins, meets) for those who met at least `least` times; equal ranks are no meeting.

    Without top each pair comes once, a < b. With top both sides have a row,
    and of each task only those that can be among the first `top` of a.

    Athletes are dealt to K blocks by hash, and each two blocks are one task,
    which so has every meeting of its pairs: each athlete is sent K times, as one row, and
    pairs never are. A large race is dealt with its riders over all tasks.
    Without top, K follows from the number of meetings and rows, such that a task has TASK_MEETS and TASK_ROWS, about. With
    top a task keeps little of what it counts, so that K follows from the rows alone, BLOCK_ROWS each, but for
    the MOST_BLOCKS that many meetings are dealt to at least.
    """
    fields = rows.groupBy("race").agg(F.count("*").alias("n"))
    whole = fields.agg(F.sum("n").alias("rows"), F.sum(F.col("n").cast("double") * F.col("n")).alias("meets")).first()
    by_meets = max(1, math.ceil(math.sqrt((whole["meets"] or 0) / TASK_MEETS)))
    if top is None:
        k = max(by_meets, math.ceil(2 * (whole["rows"] or 0) / TASK_ROWS))
    else:
        k = max(min(by_meets, MOST_BLOCKS), math.ceil((whole["rows"] or 0) / BLOCK_ROWS))
    own = F.pmod(F.xxhash64("who"), F.lit(k)).cast("int")
    packed = rows.select("who", F.struct(F.xxhash64("race").alias("race"), F.col("rank").cast("long").alias("rank")).alias("r")).groupBy("who").agg(F.collect_list("r").alias("r"))
    dealt = packed.select("who", F.col("r.race").alias("race"), F.col("r.rank").alias("rank"), own.alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("who", "race", "rank", (hi * (hi + 1) / 2 + lo).cast("int").alias("task"), (F.col("own") == F.col("other")).alias("same"), (F.col("own") > F.col("other")).alias("right"))

    def met(group: pa.Table) -> pa.Table:
        names = group["who"].combine_chunks()
        order = pc.sort_indices(names)
        names, codes = names.take(order), np.empty(len(names), np.int32)
        codes[order.to_numpy()] = np.arange(len(names))
        on_right, same = group["right"].to_numpy(), group["same"][0].as_py()
        left = _rows(group, codes, ~on_right if not same else None)
        right = left if same else _rows(group, codes, on_right)
        if top is not None:
            a, b, wins, meets = _top(left, right, same, least, top)
        else:
            found = [(np.zeros(0, np.int64),) * 4]
            for a, b, wins, meets in _met(left, right.sort_values("race", kind="stable"), same, least):
                low, high = np.minimum(a, b), np.maximum(a, b)
                found.append((low, high, np.where(a < b, wins, meets - wins), meets))
            a, b, wins, meets = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"a": names.take(pa.array(a)), "b": names.take(pa.array(b)), "a_wins": wins, "meets": meets})

    return dealt.repartitionById(k * (k + 1) // 2, F.col("task")).groupBy("task").applyInArrow(met, "a string, b string, a_wins long, meets long")

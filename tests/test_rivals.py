import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from podia.operators import meetings


def riders(n, who, races, ranks, seed=7):
    r = random.Random(seed)
    return [(f"w{r.randrange(who):03}", f"r{r.randrange(races)}", r.randrange(1, ranks)) for _ in range(n)]


def firsts(rows, least, top):
    """The first `top` of each rider, by all pairs."""
    found = Counter()
    for a, r, x in rows:
        for b, s, y in rows:
            if r == s and a != b and x != y:
                found[a, b, "met"] += 1
                found[a, b, "won"] += x < y
    all_ = sorted((a, -n, -found[a, b, "won"], b) for (a, b, what), n in found.items() if what == "met" and n >= least)
    place = Counter()
    kept = set()
    for a, n, won, b in all_:
        place[a] += 1
        if place[a] <= top:
            kept.add((a, b, -won, -n))
    return kept


@pytest.mark.parametrize("cells", [0, 10**9])
@pytest.mark.parametrize(("n", "who", "races", "ranks"), [(900, 60, 5, 9), (500, 40, 90, 4)])
def test_both_ways_give_the_first_of_all_pairs(monkeypatch, cells, n, who, races, ranks):
    for name, value in {"CELLS_A_MEETING": cells, "ROWS_AT_ONCE": 7, "COLUMNS_AT_ONCE": 23, "PAIRS_AT_ONCE": 50, "AT_ONCE": 100}.items():
        monkeypatch.setattr(meetings, name, value)
    rows = riders(n, who, races, ranks)
    side = pd.DataFrame(rows, columns=["name", "race", "rank"]).sort_values("race", kind="stable")
    side["who"], names = pd.factorize(side["name"], sort=True)
    got = {(names[a], names[b], int(w), int(m)) for a, b, w, m in zip(*meetings._top(side, side, True, 3, 2), strict=True)}
    assert got == firsts(rows, 3, 2)


def test_rows_sent_follow_from_rows_not_from_meetings(spark, monkeypatch):
    """More meetings ask for no more than MOST_BLOCKS blocks, and an athlete is one row a block."""
    monkeypatch.setattr(meetings, "TASK_MEETS", 1)
    rows = riders(400, 30, 3, 9)
    found = meetings.pairs(spark.createDataFrame(rows, "who string, race string, rank int"), 3, top=2)
    assert f"{meetings.MOST_BLOCKS * (meetings.MOST_BLOCKS + 1) // 2}" in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroups")[1]
    best = {}
    for r in found.collect():
        best.setdefault(r.a, []).append((-r.meets, -r.a_wins, r.b))
    assert {(a, b, -w, -m) for a, x in best.items() for m, w, b in sorted(x)[:2]} == firsts(rows, 3, 2)


def test_tables_are_held_for_some_athletes_at_a_time(monkeypatch):
    """Each pair is multiplied once, and no table has all athletes of a block."""
    monkeypatch.setattr(meetings, "COLUMNS_AT_ONCE", 16)
    monkeypatch.setattr(meetings, "ROWS_AT_ONCE", 8)
    held, table = [], meetings._Table
    monkeypatch.setattr(meetings, "_Table", lambda side, lo, hi: held.append(min(hi, len(side.who)) - lo) or table(side, lo, hi))
    rows = riders(900, 60, 5, 9)
    sides = [pd.DataFrame([(w, r, x) for w, r, x in rows if (int(w[1:]) % 2 == 0) == even], columns=["who", "race", "rank"]) for even in (True, False)]
    names = sorted({w for w, _, _ in rows})
    sides = [x.assign(who=x["who"].map(names.index)) for x in sides]
    got = {(names[a], names[b], int(w), int(m)) for a, b, w, m in zip(*meetings._top(*sides, False, 3, 2), strict=True)}
    assert max(held) == 16 and sorted(n for n in held if n > 8) == [14, 16]
    mixed = {(a, b, w, m) for a, b, w, m in firsts(rows, 3, 60) if int(a[1:]) % 2 != int(b[1:]) % 2}
    best = {a: sorted((-m, -w, b) for x, b, w, m in mixed if x == a)[:2] for a, *_ in mixed}
    assert got == {(a, b, -w, -m) for a, x in best.items() for m, w, b in x}


def test_rows_come_from_lists_of_several_batches():
    lists = pa.chunked_array([pa.array([[5, 5, 9], []], pa.list_(pa.int64())), pa.array([[7]], pa.list_(pa.int64()))])
    group = pa.table({"race": lists, "rank": pa.chunked_array([pa.array([[1, 2, 3], []], pa.list_(pa.int64())), pa.array([[2**40]], pa.list_(pa.int64()))])})
    found = meetings._rows(group, np.array([2, 0, 1]), None)
    assert found.values.tolist() == [[0, 1, 2], [0, 2, 2], [2, 3, 2], [1, 2**40, 1]]
    assert meetings._rows(group, np.array([2, 0, 1]), np.array([False, False, True])).values.tolist() == [[1, 2**40, 1]]

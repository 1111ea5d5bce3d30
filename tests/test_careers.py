import random
from collections import defaultdict

import pytest

from podia.operators import identity, insights
from tests.test_operators import records, row
from tests.test_shuffles import shuffled


def odd_rows():
    r = random.Random(11)
    rows = []
    for i in range(600):
        name = r.choice(["n1", "n2", "n3 x", "王", "o*", "", None])
        given = {"uci_id": r.choice([None, None, "U1" if name == "n1" else None]), "tsu_rider_id": r.choice([None, "T1"]) if name in ("", None) else r.choice(["T2", "T3", None, None]) if name == "n3 x" else None}
        rows.append(row(name, rank=r.choice([None, 1, 2]), race=r.choice(["A", "B", "C", "", None]), year=r.choice([0, None, 2020, 2021, 2023, 2024]), gender=r.choice(["M", "F", None]) if i % 3 else "M", team=r.choice([None, "", "t1", "t2"]), name_masked=r.choice(["m1", "m2"]), **given))
    rows += [row("pair", rank=1, race="B", year=2020, gender="M"), row("pair", rank=1, race="A", year=2021, gender="F"), row("once", race="D"), row("many", year=2020, team="t1"), row("many", year=2020, team="t2"), row("many", team="t3")]
    return rows


def longest(years):
    return max((sum(all(y + k in years for k in range(n + 1)) for n in range(len(years))) for y in years), default=0)


def told(rows):
    """Careers in plain steps, of rows as collected with their keys."""
    by = defaultdict(list)
    for x in sorted(rows, key=lambda x: x.row_ord):
        by[x.gk].append(x)
    out = {}
    for gk, own in by.items():
        teams, genders = {x.team for x in own if x.team}, [x.gender for x in own if x.gender in ("M", "F")]
        name = "".join((own[0].name_raw or "").split())
        low = not gk.startswith(("t:", "u:")) and (len(set(genders)) > 1 or len(teams) >= 5 or (len(teams) >= 3 and len(name) <= 2))
        if gk in identity.NOBODY or len(own) < 2 or low:
            continue
        spelt = [x.name_masked for x in own]
        m, f = genders.count("M"), genders.count("F")
        years = defaultdict(set)
        for x in own:
            if x.race_key is not None and x.year:
                years[x.race_key].add(x.year)
        lrk = min(years, key=lambda k: (-len(years[k]), k), default=None)
        out[gk] = (min(spelt, key=lambda s: (-spelt.count(s), spelt.index(s))), "M" if m > f else "F" if f > m else None, len(own), sum(x.rank_overall == 1 for x in own), len({x.race_key or "" for x in own}), longest({x.year for x in own if x.year}), lrk, lrk, len(years[lrk]) if lrk is not None else 0)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return records(spark, odd_rows()).localCheckpoint()


def test_careers_of_odd_rows(spark, rows):
    keyed = identity.with_group_keys(rows)
    expected = told(keyed.collect())
    ids = {r.id: r.gk for r in keyed.select("gk", identity.athlete_id(keyed.gk).alias("id")).distinct().collect()}
    got = {ids[r.id]: tuple(r)[1:] for r in insights.careers(rows).collect()}
    assert len(expected) > 3 and got == expected


def test_an_identitys_rows_meet_by_name_and_once_by_key(rows):
    """No window and no join by identity over rows: they are shuffled by name, and as one row a name by key."""
    found = insights.careers(rows)
    assert shuffled(found, "gk") == 1 and shuffled(found, "name_raw") == 2 and shuffled(found, "id") == 0
    assert "__rows" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_boards_need_no_other_look_at_the_rows(rows):
    found = insights.boards(insights.careers(rows))
    assert shuffled(found, "gk") == 1 and shuffled(found, "id") == 0 and shuffled(found, "name_raw") == 2
    starts = [(r.nm, r.v) for r in found.orderBy("place").collect() if r.board == "most_starts"]
    assert starts == [(r.nm, r.n) for r in insights.careers(rows).orderBy("n", "id", ascending=[False, True]).limit(8).collect()]

import random
from collections import Counter, defaultdict

from podia.operators import races

COLUMNS = "race_key string, result_label string, year long, status string, finish_seconds double, age_band string, gender string, category_raw string"


def drawn(n=900):
    """Finishers of few races with repeated rows and times, nulls, empty texts, and a band that reads like a band and gender."""
    r = random.Random(5)
    one = lambda *values: r.choice(values)
    rows = [
        (one("a", "a", "b", None), one("x", "", None), one(2020, 2021, None), one(None, "FIN", "FIN", "DNF"), one(None, *[float(t) for t in range(60, 90)], 61.5, 7000.25),
         one(None, "", "30-39", "40-49", "30-39|g:M"), one("M", "F", "X", "", None), one("W30", "M40", "OPEN", "", None))
        for _ in range(n)
    ]
    return rows + rows[:200] + [("c", None, 2020, None, 100.0, "30-39", "M", "M30")] * 19


def expected(rows, least=20):
    """By plain lists: each cohort's sorted times and the places of percentiles among them."""
    times, years = defaultdict(list), defaultdict(set)
    for rk, label, y, status, t, band, g, cat in rows:
        if rk is None or t is None or status not in (None, "FIN"):
            continue
        of = (rk, label or "全部")
        years[of].add(y)
        cohorts = [("all", "all")] + [(f"age:{band}", "age")] * bool(band) + [(f"age:{band}|g:{g}", "age")] * (bool(band) and g in ("M", "F")) + [(f"cat:{cat}", "cat")] * bool(cat)
        for c in cohorts:
            times[*of, *c].append(int(t))
    found = {}
    for key, ts in times.items():
        if len(ts) >= least and len(times[*key[:2], "all", "all"]) >= least:
            ts.sort()
            found[key] = (len(ts), [ts[round(p / 100 * (len(ts) - 1))] for p in range(101)], sorted(y for y in years[key[:2]] if y is not None))
    return found


def test_percentiles_of_cohorts_are_those_of_their_lists(spark):
    rows = drawn()
    for least in (1, 20, 60):
        got = races.benchmarks(spark.createDataFrame(rows, COLUMNS).repartition(3), least).collect()
        assert {(x.rk, x.label, x.cohort, x.type): (x.n, x.bp, x.years) for x in got} == expected(rows, least)
        assert max(Counter((x.rk, x.label, x.cohort) for x in got).values()) == 1
    assert races.benchmarks(spark.createDataFrame([], COLUMNS)).collect() == []


def test_finishers_are_counted_before_they_are_of_cohorts(spark):
    """Rows meet once, as counts, for cohorts and for years; rows by cohort are never grouped by time, and the table is made once."""
    found = races.benchmarks(spark.createDataFrame(drawn(100), COLUMNS), 1)
    assert found.count() > 0
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan and plan.count("ReusedExchange") == 1
    grouped = [x for x in plan.splitlines() if "HashAggregate(keys=" in x and "cohort#" in x.split("], functions=")[0]]
    assert grouped and all(" t#" not in x.split("], functions=")[0] for x in grouped)

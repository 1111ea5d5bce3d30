import random

from podia.operators import athletes, identity, insights
from podia.plans.queries import QUERIES
from tests.test_operators import records, row


def shuffled(df, by):
    """How often the plan shuffles rows by a column."""
    return df._jdf.queryExecution().executedPlan().toString().count(f"Exchange hashpartitioning({by}#")


def keyed(spark):
    r = random.Random(3)
    rows = [row(f"n{r.randrange(9)}", rank=i % 5 + 1, race=f"r{i % 7}", year=2020 + i % 4, date=f"202{i % 4}-0{r.randrange(1, 4)}-01", gender="MF"[i % 2], team=f"t{r.randrange(3)}", age_group="U19 30 40".split()[i % 3]) for i in range(200)]
    return identity.with_group_keys(records(spark, rows))


def test_rows_meet_by_identity_once(spark):
    rows = keyed(spark)
    hist = athletes.history(rows)
    assert shuffled(athletes.season_recap(hist), "id") == 1 and shuffled(athletes.season_recap(hist), "gk") == 0
    assert shuffled(athletes.index(rows), "gk") == 1
    assert shuffled(athletes.features(rows, least=1), "gk") <= 2


def test_recap_takes_the_busiest_month_and_the_year_before(spark):
    rows = [row("n", rank=i % 2 + 1, race=f"r{i}", year=y, date=d) for i, (y, d) in enumerate([(2020, "2020-05-01"), (2020, "2020-03-01"), (2021, None), (2023, "2023-02-01"), (2023, "2023-02-09"), (2023, "2023-01-01")])]
    got = {r.y: (r.busiest_month, r.delta is None) for r in athletes.season_recap(athletes.history(identity.with_group_keys(records(spark, rows)))).collect()}
    assert got == {2020: (3, True), 2021: (None, False), 2023: (2, True)}


def test_tables_are_joined_once(spark):
    for name in ("increment_counts", "insights_careers", "merge_cross_listed", "athletes_calibrated"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan


def test_course_records_send_other_races_rows_counted(spark):
    """Only rows on a climb are joined one by one, and no rank is made; hidden names stand alone, links count all of an athlete's rows."""
    rows = [row("n", rank=1, race="r1", finish_seconds=9000.0), row("n", rank=2, race="r2"), row("m", rank=2, race="r1", finish_seconds=9100.0), row("o*", rank=3, race="r1", finish_seconds=9200.0), row("o*", rank=3, race="r2")]
    climbs = spark.createDataFrame([("r1", 3200, 52.0, 6.2, "Mount r1", "high")], "race_key string, elev_m int, dist_km double, grade double, name string, conf string")
    got = athletes.course_records(records(spark, rows).drop("rank_overall"), climbs).orderBy("rank").collect()
    assert [(r.rank, r.link, r.n) for r in got] == [(1, True, 3), (2, False, 3), (3, False, 3)]


def test_breakout_sends_percentages_by_identity_together(spark):
    """No window over an identity's rows, which are shuffled by gk as percentages and then as years; hidden names stand alone, and few results a year still need two in all."""
    rows = [row(f"x{y}{i}", rank=i, year=y) for y in (2020, 2021) for i in range(3, 9)]
    rows += [row("n", rank=r, year=y) for y, r in ((2020, 9), (2020, 10), (2021, 1), (2021, 2))] + [row("o*", rank=r, year=y) for y, r in ((2020, 1), (2020, 2), (2021, 9), (2021, 10))]
    found = insights.breakout(records(spark, rows))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__rows" not in plan and shuffled(found, "gk") == 2
    assert [(r.from_y, r.to_y, r.from_pct, r.to_pct, r.jump) for r in found.collect()] == [(2020, 2021, 5.0, 85.0, 80.0)]
    assert [r.jump for r in insights.breakout(records(spark, rows), least_a_year=1).collect()] == [80.0]

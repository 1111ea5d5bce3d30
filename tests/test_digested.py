from podia.operators import increment, races
from podia.plans import bindings, queries

SF = "/root/testdata/sf0.001"


def test_texts_are_hashed_before_rows_are_ranked(spark):
    """Ranks are those of results(), a row's hash tells any of its texts, and ranking moves no text but the race and its label."""
    rows = bindings.digested(spark, SF, "bib")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Window [") < plan.index("xxhash64(")
    keys = ["race_key", "year", "finish_seconds", "rank_overall", "bib"]
    assert rows.select(keys).exceptAll(bindings.results(spark, SF).select(keys)).count() == 0
    old, short = bindings.results(spark, SF), bindings.digested(spark, SF)
    assert short.count() == old.count() and short.select("rest").distinct().count() == old.drop("rank_overall").distinct().count()


def test_changed_race_years_come_of_rows_written_once(spark):
    found = queries.changed_race_years(spark, SF)
    assert "l_orderkey" not in found._jdf.queryExecution().optimizedPlan().toString()
    old = bindings.results(spark, SF)
    whole = increment.changed_race_years(increment.digests(old), increment.digests(queries._next_build(old)))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))


def test_rows_are_not_shuffled_to_race_years(spark):
    """Changed race-years are sent to the rows, and a null year is a year on either side."""
    rows = spark.createDataFrame([("a", 1, 1), ("a", None, 2), ("b", 1, 3)], "race_key string, year long, n int")
    wanted = spark.createDataFrame([("a", None, "changed")], "race_key string, year long, state string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own, other = increment.of_race_years(rows, wanted), increment.other_race_years(rows, wanted)
        assert all("BroadcastHashJoin" in x._jdf.queryExecution().executedPlan().toString() for x in (own, other))
        assert [r.n for r in own.collect()] == [2] and sorted(r.n for r in other.collect()) == [1, 3]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counts_need_no_race_names(spark):
    columns = bindings.digested(spark, SF, *queries.SLIMMED).columns
    assert "race_name_raw" not in columns and "name_raw" not in columns
    slim = races.slim(bindings.results(spark, SF))
    states = increment.counts(increment.states(slim), ["y", "g"]).collect()
    short = increment.counts(increment.states(races.slim(bindings.digested(spark, SF, *queries.SLIMMED))), ["y", "g"]).collect()
    assert sorted(map(str, states)) == sorted(map(str, short))

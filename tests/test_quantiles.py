import random

from pyspark.sql import functions as F

from podia.functions import measures as M
from podia.operators import insights
from tests.test_operators import records, row


def test_quantiles_are_those_of_all_values(spark):
    """With bins that hold all values, some or one; with repeated values, single values and null groups."""
    r = random.Random(5)
    values = [(g, r.choice([r.random() * 10, float(r.randrange(4))])) for g in ["a", "b", None] for _ in range(r.randrange(20, 60))] + [("c", 3.5)]
    rows = spark.createDataFrame(values, "g string, v double")
    wanted = {"low": 0.0, "q": 0.25, "m": 0.5, "h": 0.9, "top": 1.0}
    exact = {x.g: tuple(x)[1:] for x in rows.groupBy("g").agg(F.count("*").alias("n"), *[M.quantile(F.col("v"), q).alias(n) for n, q in wanted.items()]).collect()}
    counted = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
    assert {x.g: tuple(x)[1:] for x in M.quantiles(rows.withColumn("c", F.lit(1)), ["g"], "v", wanted, 1.0).collect()} == exact
    for bins in (0.001, 1.0, 50.0):
        assert {x.g: tuple(x)[1:] for x in M.quantiles(counted, ["g"], "v", wanted, bins).collect()} == exact


def test_age_curve_gathers_no_values(spark):
    """Percentages are counted by hash aggregates: no percentile holds all values of a band."""
    rows = [row(f"n{i}", rank=i + 1, age_group="30", gender="MF"[i % 2]) for i in range(101)]
    curve = insights.age_curve(records(spark, rows), least=51)
    assert "percentile" not in curve._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(x)[1:] for x in curve.collect()} == {("all", 101, 24.8, 49.5, 74.3), ("M", 51, 24.8, 49.5, 74.3)}

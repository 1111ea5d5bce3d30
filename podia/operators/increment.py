"""From one build to the next: which race-years changed, and products that are rewritten for these alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The facets of a finisher that overviews count by.
FACETS = ["mon", "s", "rc", "g", "ag", "plat", "reg"]


def digests(rows: DataFrame) -> DataFrame:
    """(race_key, year, n, mix, total): one row a race-year that differs if any of its rows does, whatever their order."""
    row = F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])
    return rows.groupBy("race_key", "year").agg(F.count("*").alias("n"), F.bit_xor(row).alias("mix"), F.sum(F.xxhash64(row, F.lit(1)).cast("decimal(38,0)")).alias("total"))


def _same(left: str, right: str) -> Column:
    return F.col(f"{left}.race_key").eqNullSafe(F.col(f"{right}.race_key")) & F.col(f"{left}.year").eqNullSafe(F.col(f"{right}.year"))


def changed_race_years(old: DataFrame, new: DataFrame) -> DataFrame:
    """(race_key, year, state): the race-years whose digests() differ, as changed, added or missing; a null year is a year."""
    both = old.alias("o").join(new.alias("n"), _same("o", "n"), "full")
    state = F.when(F.col("n.n").isNull(), "missing").when(F.col("o.n").isNull(), "added").when((F.col("o.n") != F.col("n.n")) | (F.col("o.mix") != F.col("n.mix")) | (F.col("o.total") != F.col("n.total")), "changed")
    chosen = [F.when(F.col("n.n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in ("race_key", "year")]
    return both.select(*chosen, state.alias("state")).filter("state is not null")


def of_race_years(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted race-years (race_key, year), which are broadcast: a row a race-year."""
    return rows.alias("r").join(F.broadcast(wanted.select("race_key", "year")).alias("w"), _same("r", "w"), "left_semi")


def other_race_years(rows: DataFrame, unwanted: DataFrame) -> DataFrame:
    """The rows of all other race-years than the unwanted (race_key, year), which are broadcast."""
    return rows.alias("r").join(F.broadcast(unwanted.select("race_key", "year")).alias("w"), _same("r", "w"), "left_anti")


def folder_of(race: Column, year: Column) -> Column:
    """The name under which a race-year's part of a product is kept."""
    return F.concat_ws("|", F.coalesce(race, F.lit("")), F.coalesce(year.cast("string"), F.lit("none")))


def refresh(product: Callable[[DataFrame], DataFrame], rows: DataFrame, changed: DataFrame, path: str, race: str = "rk", year: str = "y") -> int:
    """Rewrite a product under path for the changed race-years alone; gives their number.

    product makes rows of a race-year (in columns race and year) from results of that race-year
    alone, so it is given only those. Each race-year is a folder; those with rows are
    overwritten one by one by Spark's dynamic partition overwrite, those that have none any more are deleted.
    The list of changed race-years is on the driver: it has no more rows than there are races times years.
    """
    spark = rows.sparkSession
    parts = [r.part for r in changed.select(folder_of(F.col("race_key"), F.col("year")).alias("part")).distinct().collect()]
    if not parts:
        return 0
    made = product(of_race_years(rows, changed)).withColumn("part", folder_of(F.col(race), F.col(year)))
    have = {r.part for r in made.select("part").distinct().collect()}
    made.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    name, conf = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils, spark._jsc.hadoopConfiguration()
    for part in set(parts) - have:
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={name.escapePathName(part)}")
        gone.getFileSystem(conf).delete(gone, True)
    return len(parts)


def read_product(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")


def states(slim: DataFrame) -> DataFrame:
    """(rk, y, facets..., n, timed, seconds): finishers of a race-year by facets, as counts and sums that add up over race-years.

    A product for refresh(), so that overviews of everything are sums over it instead of another look at all results.
    """
    return slim.groupBy("rk", "y", *FACETS).agg(F.count("*").alias("n"), F.count("t").alias("timed"), F.sum("t").alias("seconds"))


def counts(of: DataFrame, by: list[str]) -> DataFrame:
    """Finishers and their mean time by some columns of states()."""
    summed = of.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("timed").alias("timed"), F.sum("seconds").alias("seconds"))
    return summed.select(*by, "n", F.round(F.col("seconds") / F.col("timed"), 6).alias("mean"))

"""Checks of a merged table, and comparison of two builds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podia.functions import text as X

#: Plausible finish times: 8 minutes to 60 hours.
LEAST_SECONDS, MOST_SECONDS = 8 * 60, 60 * 3600
ISSUES = ("missing_time", "missing_name", "missing_race", "time_unparsed", "time_out_of_range", "year_mismatch")


def flags(rows: DataFrame) -> DataFrame:
    """rows with one boolean column for each issue that a row has by itself."""
    s, time = F.col("finish_seconds"), F.col("finish_time") if "finish_time" in rows.columns else F.col("finish_seconds").cast("string")
    named = X.extract_year(F.col("race_name_raw"))
    return rows.withColumns(
        {
            "missing_time": X.blank(time),
            "missing_name": X.blank(F.col("name_masked")) & X.blank(F.col("name_raw")),
            "missing_race": X.blank(F.col("race_name_canonical")),
            "time_unparsed": ~X.blank(time) & s.isNull(),
            "time_out_of_range": F.coalesce(~s.between(LEAST_SECONDS, MOST_SECONDS), F.lit(False)),
            "year_mismatch": F.coalesce(named.between(2009, 2027) & (F.col("year") != 0) & (named != F.col("year")), F.lit(False)),
        }
    )


def duplicates(rows: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one's race, year, category, bib and time: (race_key, year, repeats)."""
    time = "finish_time" if "finish_time" in rows.columns else "finish_seconds"
    per = rows.groupBy("race_key", "year", "category_raw", "bib", time).agg(F.count("*").alias("n")).filter("n > 1")
    return per.groupBy("race_key", "year").agg(F.sum(F.col("n") - 1).alias("repeats"))


def inversions(rows: DataFrame) -> DataFrame:
    """(race_key, year, result_label, inversions): rows that are faster than one ranked before them in their sub-event."""
    ranked = rows.filter("rank_overall > 0 and finish_seconds is not null")
    before = Window.partitionBy("race_key", "year", "result_label").orderBy("rank_overall", "row_ord").rowsBetween(Window.unboundedPreceding, -1)
    slower = F.col("finish_seconds") + 1e-6 < F.max("finish_seconds").over(before)
    return ranked.withColumn("bad", slower).groupBy("race_key", "year", "result_label").agg(F.count_if("bad").alias("inversions")).filter("inversions > 0")


def report(rows: DataFrame) -> DataFrame:
    """(issue, rows): how many rows have each issue, in one pass over the flags."""
    counts = flags(rows).agg(*[F.count_if(i).alias(i) for i in ISSUES])
    stack = ", ".join(f"'{i}', {i}" for i in ISSUES)
    return counts.selectExpr(f"stack({len(ISSUES)}, {stack}) as (issue, rows)")


def samples(rows: DataFrame, k: int = 5) -> DataFrame:
    """(issue, place, ...): the first k rows of each issue by (source_ord, row_ord), with the columns by which to find them.

    Each partition keeps k rows an issue while it streams; only these meet, k
    times the partitions for an issue, and are ranked. Issues without rows give none.
    """
    shown = [c for c in ("source_ord", "row_ord", "source_platform", "race_key", "year", "name_masked", "finish_time", "finish_seconds") if c in rows.columns]
    issues = F.filter(F.array(*[F.when(F.col(i), F.lit(i)) for i in ISSUES]), lambda x: x.isNotNull())
    found = flags(rows).select(*shown, F.explode(issues).alias("issue"))
    order = ["source_ord", "row_ord"]

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            both = batch if kept is None else pd.concat([kept, batch])
            kept = both.sort_values(order, kind="stable", na_position="first").groupby("issue").head(k)
        if kept is not None:
            yield kept

    few = found.mapInPandas(first, found.schema)
    place = F.row_number().over(Window.partitionBy("issue").orderBy(*order))
    return few.withColumn("place", place).filter(F.col("place") <= k).select("issue", "place", *shown)


def coverage(rows: DataFrame) -> DataFrame:
    """(source_platform, rows, gender_known, age_known): how complete each source is."""
    age = F.col("age_group") if "age_group" in rows.columns else F.col("age_band")
    return rows.groupBy("source_platform").agg(F.count("*").alias("rows"), F.count_if(F.col("gender").isin("M", "F")).alias("gender_known"), F.count_if(~X.blank(age)).alias("age_known"))


def shrunk_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source_platform, old_rows, new_rows): sources that have fewer rows than before, or none any more."""
    count = lambda df, n: df.groupBy(F.coalesce("source_platform", F.lit("")).alias("source_platform")).agg(F.count("*").alias(n))
    both = count(old, "old_rows").join(count(new, "new_rows"), "source_platform", "left")
    return both.withColumn("new_rows", F.coalesce("new_rows", F.lit(0).cast("long"))).filter("new_rows < old_rows")


def guarded(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows, but of sources that shrank the old ones: a source that breaks takes nothing away. Sources are few, so their table is broadcast."""
    gone = F.broadcast(shrunk_sources(old, new).select(F.col("source_platform").alias("__s")))
    of = F.coalesce("source_platform", F.lit("")) == F.col("__s")
    return new.join(gone, of, "left_anti").unionByName(old.join(gone, of, "left_semi"))


def compare_builds(old: DataFrame, new: DataFrame) -> DataFrame:
    """(rk, y, state, old_rows, new_rows, lost): each race-year of two leaderboards as missing, added, changed or same.

    lost counts the results (name and whole seconds, with repeats) that only the old build has.
    """
    entry = lambda df, n: df.groupBy("rk", "y", "name", F.floor("t").alias("t")).agg(F.count("*").alias(n))
    a, b = entry(old, "o"), entry(new, "n").withColumnsRenamed({"rk": "rk2", "y": "y2", "name": "name2", "t": "t2"})
    same = F.col("rk").eqNullSafe(F.col("rk2")) & F.col("y").eqNullSafe(F.col("y2")) & F.col("name").eqNullSafe(F.col("name2")) & F.col("t").eqNullSafe(F.col("t2"))
    both = a.join(b, same, "full").select(F.coalesce("rk", "rk2").alias("rk"), F.coalesce("y", "y2").alias("y"), F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("n", F.lit(0)).alias("n"))
    per = both.groupBy("rk", "y").agg(F.sum("o").alias("old_rows"), F.sum("n").alias("new_rows"), F.sum(F.greatest(F.col("o") - F.col("n"), F.lit(0))).alias("lost"))
    state = F.when(F.col("new_rows") == 0, "missing").when(F.col("old_rows") == 0, "added").when((F.col("old_rows") == F.col("new_rows")) & (F.col("lost") == 0), "same").otherwise("changed")
    return per.withColumn("state", state)

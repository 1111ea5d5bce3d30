"""Who is who: group keys anchored on stable rider ids, public ids, and how far to trust them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podia.functions import measures as M
from podia.functions import text as X

SALT = "podia-athlete-v1"
#: Keys that stand for nobody in particular.
NOBODY = ("n:", "u:", "t:")
MIN_RESULTS = 2
# What stands in the team field for no team.
NO_TEAM = ["—", "-", "–", "個人", "無", "自由車", "無車隊"]


def entry_key(race: Column, year: Column, seconds: Column, masked: Column) -> Column:
    """The key under which a published result is found again; null if a part is missing."""
    whole = F.concat_ws("|", race, year.cast("string"), F.rint(seconds).cast("long").cast("string"), masked)
    return F.when(race.isNotNull() & year.isNotNull() & seconds.isNotNull() & ~X.blank(masked), whole)


def with_group_keys(rows: DataFrame, legacy: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """rows with `gk`: t:<rider id>, else u:<uci id>, else the one id that the name is ever seen with, else n:<name>.

    Anchors are aggregates by name, joined back: no list of names leaves the
    cluster; only rows with an id are shuffled for them. Rows whose source hid the name join the athlete that the legacy
    table (entry, athlete_id) has for their result: by that athlete's key if
    there is one (the first), else x:<id>; without a match they stand alone as s:<row>.
    seen: the rows that names and ids are learned from, if rows are only some of them.
    """
    seen = rows if seen is None else seen
    given = seen.filter(~X.blank(F.col("name_raw")) & (F.col("tsu_rider_id").isNotNull() | F.col("uci_id").isNotNull()))
    anchors = given.groupBy("name_raw").agg(
        F.min("tsu_rider_id").alias("tsu0"), F.max("tsu_rider_id").alias("tsu1"), F.min("uci_id").alias("uci0"), F.max("uci_id").alias("uci1")
    )
    anchors = anchors.select("name_raw", F.when(F.col("tsu0") == F.col("tsu1"), F.col("tsu0")).alias("tsu"), F.when(F.col("uci0") == F.col("uci1"), F.col("uci0")).alias("uci"))
    key = (
        F.when(~X.blank(F.col("tsu_rider_id")), F.concat(F.lit("t:"), "tsu_rider_id"))
        .when(~X.blank(F.col("uci_id")), F.concat(F.lit("u:"), "uci_id"))
        .when(F.col("tsu").isNotNull(), F.concat(F.lit("t:"), "tsu"))
        .when(F.col("uci").isNotNull(), F.concat(F.lit("u:"), "uci"))
        .otherwise(F.concat(F.lit("n:"), F.coalesce("name_raw", F.lit(""))))
    )
    keyed = rows.join(anchors, "name_raw", "left").withColumn("gk", key).drop("tsu", "uci")
    if legacy is None:
        return keyed.withColumn("gk", F.when(X.is_source_masked(F.col("name_raw")), F.concat(F.lit("s:"), F.col("row_ord").cast("string"))).otherwise(F.col("gk")))
    hidden = X.is_source_masked(F.col("name_raw"))
    held = keyed.filter(~hidden).groupBy(athlete_id(F.col("gk")).alias("athlete_id")).agg(F.min_by("gk", "row_ord").alias("held_key"))
    known = legacy.join(held, "athlete_id", "left").select("entry", F.coalesce("held_key", F.concat(F.lit("x:"), "athlete_id")).alias("old_key"))
    entry = entry_key(F.col("race_key"), F.col("year"), F.col("finish_seconds"), F.col("name_masked"))
    found = keyed.withColumn("entry", F.when(hidden, entry)).join(known, "entry", "left")
    return found.withColumn("gk", F.when(hidden, F.coalesce("old_key", F.concat(F.lit("s:"), F.col("row_ord").cast("string")))).otherwise(F.col("gk"))).drop("entry", "old_key")


def athlete_id(gk: Column) -> Column:
    return F.when(gk.startswith("x:"), F.substring(gk, 3, 100)).otherwise(X.salted_id(SALT, gk))


def resolved(keyed: DataFrame) -> DataFrame:
    return keyed.filter(~F.col("gk").isin(*NOBODY))


def sizes(keyed: DataFrame) -> DataFrame:
    """(gk, rows): how many results each identity has."""
    return keyed.groupBy("gk").agg(F.count("*").alias("rows"))


def field_sizes(rows: DataFrame, ranked_only: bool = False) -> DataFrame:
    """(race_key, year, field): the size of each race-year, of all rows or of those with a rank."""
    rows = rows.filter(F.col("rank_overall") > 0) if ranked_only else rows
    return rows.groupBy("race_key", "year").agg(F.count("*").alias("field"))


def with_field(rows: DataFrame, fields: DataFrame) -> DataFrame:
    """rows with their race-year's `field` and the percentage of it that they beat, `pct`; a null year is a year.

    fields has a row a race-year and is broadcast, so that rows aren't shuffled to it.
    """
    f = F.broadcast(fields.select(F.col("race_key").alias("__rk"), F.col("year").alias("__y"), "field"))
    met = rows.join(f, F.col("race_key").eqNullSafe(F.col("__rk")) & F.col("year").eqNullSafe(F.col("__y")), "left").drop("__rk", "__y")
    return met.withColumn("pct", M.in_field_percent(F.col("rank_overall"), F.col("field")))


def confidence(anchored: Column, teams: Column, name_length: Column, mixed: Column) -> Column:
    """high, med or low: anchored ids are sure; one name racing as both genders isn't; many teams hint at namesakes."""
    return (
        F.when(anchored, "high")
        .when(mixed, "low")
        .when(teams >= 5, "low")
        .when((teams >= 3) & (name_length <= 2), "low")
        .when(teams >= 3, "med")
        .otherwise("high")
    )


def most_common(keyed: DataFrame, column: str, keep: Column | None = None) -> DataFrame:
    """(gk, column): each identity's most frequent value, ties by the first row that has it."""
    rows = keyed if keep is None else keyed.filter(keep)
    counted = rows.groupBy("gk", column).agg(F.count("*").alias("n"), F.min("row_ord").alias("first"))
    return counted.groupBy("gk").agg(M.mode(column, F.col("first")).alias(column))


def more_often() -> Column:
    """The gender that most rows of a group have, null at a tie: an aggregate."""
    m, f = F.count_if(F.col("gender") == "M"), F.count_if(F.col("gender") == "F")
    return F.when(m > f, "M").when(f > m, "F")

"""Products by team and by series season."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podia.functions import text as X
from podia.operators import identity as I

SALT = "podia-team-v1"
# What stands in the team field for no team.
NO_TEAM = ["個人", "個人組", "無", "無車隊", "自由", "自由車", "-", "--", "—", "N/A", "NA"]


def team_rows(keyed: DataFrame, least_riders: int = 4, least_races: int = 2) -> DataFrame:
    """The rows of real teams: several riders, more than one race."""
    rows = I.resolved(keyed).withColumn("team", X.stripped(F.col("team"))).filter(~X.blank(F.col("team")) & ~F.col("team").isin(*NO_TEAM))
    size = rows.groupBy("team").agg(F.count_distinct("gk").alias("riders"), F.count_distinct(F.when(~X.blank(F.col("race_key")), F.col("race_key"))).alias("races"))
    real = size.filter((F.col("riders") >= least_riders) & (F.col("races") >= least_races)).select("team")
    return I.with_field(rows.join(real, "team", "left_semi"), I.field_sizes(keyed))


def index(rows: DataFrame) -> DataFrame:
    """One row a team of team_rows(): riders, results, races, wins, podiums, best rank, first and last year."""
    rank = F.when(F.col("rank_overall") > 0, F.col("rank_overall"))
    return rows.groupBy("team").agg(
        F.count_distinct("gk").alias("riders"), F.count("*").alias("rows"), F.count_distinct(F.when(~X.blank(F.col("race_key")), F.col("race_key"))).alias("races"),
        F.count_if(rank == 1).alias("wins"), F.count_if(rank <= 3).alias("podiums"), F.min(rank).alias("best"), F.min("year").alias("y0"), F.max("year").alias("y1"),
    ).select(X.salted_id(SALT, F.col("team")).alias("id"), F.col("team").alias("name"), "riders", "rows", "races", "wins", "podiums", "best", "y0", "y1")


def roster(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """(team, id, nm, n, best, y0, y1, link, place): the riders of each team, the most frequent first."""
    rank = F.when(F.col("rank_overall") > 0, F.col("rank_overall"))
    per = rows.groupBy("team", "gk").agg(F.min_by("name_masked", "row_ord").alias("nm"), F.count("*").alias("n"), F.min(rank).alias("best"), F.min("year").alias("y0"), F.max("year").alias("y1"))
    per = per.join(I.sizes(keyed), "gk").withColumn("id", I.athlete_id(F.col("gk")))
    order = Window.partitionBy("team").orderBy(F.desc("n"), F.coalesce("best", F.lit(9999)), "id")
    return per.select("team", "id", "nm", "n", "best", "y0", "y1", (F.col("rows") >= I.MIN_RESULTS).alias("link"), F.row_number().over(order).cast("long").alias("place"))


def by_year(rows: DataFrame) -> DataFrame:
    return rows.filter("year is not null").groupBy("team", F.col("year").alias("y")).agg(F.count_distinct("gk").alias("riders"), F.count_distinct("race_key").alias("races"))


def highlights(rows: DataFrame, top: int = 10) -> DataFrame:
    """(team, place, id, rk, y, rank, pct): each team's results that beat most of the field."""
    order = Window.partitionBy("team").orderBy(F.desc("pct"), "row_ord")
    best = rows.filter("pct is not null").withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= top)
    return best.select("team", "place", I.athlete_id(F.col("gk")).alias("id"), F.col("race_key").alias("rk"), F.col("year").alias("y"), F.col("rank_overall").alias("rank"), F.bround("pct").cast("long").alias("pct"))


def stations(keyed: DataFrame) -> DataFrame:
    """(s, y, rk, name, n): the races of each series season with their field; the name is that of the first row."""
    rows = keyed.filter(~X.blank(F.col("series")) & F.col("year").isNotNull() & ~X.blank(F.col("race_key")))
    return I.with_field(rows, I.field_sizes(keyed)).groupBy(F.col("series").alias("s"), F.col("year").alias("y"), F.col("race_key").alias("rk")).agg(F.min_by(X.filled(F.col("race_name_canonical"), F.col("race_name_raw")), "row_ord").alias("name"), F.max("field").alias("n"))


def standings(keyed: DataFrame, least_stations: int = 2, top: int = 50) -> DataFrame:
    """(s, y, place, id, nm, pts, n, best, link): season totals of each rider's best percentage at every station of a series."""
    rows = keyed.filter(~X.blank(F.col("series")) & F.col("year").isNotNull() & ~X.blank(F.col("race_key")))
    scored = I.with_field(I.resolved(rows), I.field_sizes(keyed)).filter("pct is not null")
    best = scored.groupBy("series", "year", "gk", "race_key").agg(F.max("pct").alias("p"), F.min(F.struct("row_ord", "name_masked")).alias("first"))
    total = best.groupBy("series", "year", "gk").agg(F.round(F.sum("p"), 6).alias("points"), F.count("*").alias("n"), F.max("p").alias("best"), F.min("first").alias("first")).filter(F.col("n") >= least_stations)
    order = Window.partitionBy("series", "year").orderBy(F.desc("points"), F.desc("n"), "id")
    ranked = total.withColumn("id", I.athlete_id(F.col("gk"))).withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= top)
    out = ranked.join(I.sizes(keyed), "gk")
    return out.select(F.col("series").alias("s"), F.col("year").alias("y"), "place", "id", F.col("first.name_masked").alias("nm"), F.bround("points").cast("long").alias("pts"), "n", F.bround("best").cast("long").alias("best"), (F.col("rows") >= I.MIN_RESULTS).alias("link"))

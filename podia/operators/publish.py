"""What leaves the house: the open dataset's columns, the catalogue, nested documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podia.functions import text as X

# The only columns of the open dataset, in order.
PUBLISHED = [
    "race_key", "year", "date", "region", "series", "race_name_canonical", "race_type", "race_class", "result_label", "category_raw",
    "gender", "age_band", "age_group", "rank_overall", "finish_seconds", "finish_time", "splits", "team", "name_masked", "source_platform",
]


def open_dataset(rows: DataFrame) -> DataFrame:
    """The published columns alone, missing ones null, lists as JSON; a name that shows no mask is left out."""
    kinds = dict(rows.dtypes)

    def column(name: str):
        if name not in kinds:
            return F.lit(None).cast("string")
        return F.to_json(name) if kinds[name].startswith(("array", "map", "struct")) else F.col(name)

    out = rows.select(*[column(c).alias(c) for c in PUBLISHED])
    return out.withColumn("name_masked", F.when(F.col("name_masked").contains(X.MASK), F.col("name_masked")))


def write_open_dataset(rows: DataFrame, path: str) -> None:
    """The open dataset as Parquet by year and as CSV."""
    out = open_dataset(rows)
    out.write.mode("overwrite").partitionBy("year").parquet(f"{path}/parquet")
    out.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


#: The products, their grain, and what each is, as the manifest lists them.
ENDPOINTS = [
    ("races", "race-year", "Index of race-years with completion."), ("leaderboard", "result", "Results of each race-year by place."), ("crossyear", "race-year and label", "Winner and quartiles by year."),
    ("athletes", "athlete", "Index of athletes."), ("history", "result", "Results of each athlete in order."), ("rivals", "pair of athletes", "Meetings and wins."),
    ("climbs", "athlete", "Best ascent rate on known climbs."), ("course_records", "climb and rank", "Fastest ascents."), ("teams", "team", "Index of teams."),
    ("series", "series and year", "Stations and standings."), ("race_dna", "race-year", "Six scores of 0 to 100."), ("difficulty", "race-year and label", "Medians against the race's usual one."),
    ("benchmarks", "cohort", "101 break points of times."), ("insights", "facts", "Age curve, breakouts, ratings, places and boards."), ("overview", "everything", "Totals by year, month, gender, age and class."),
    ("coverage", "gap", "Calendar races without results, and the season board."), ("dataset", "result", "The open dataset."),
]


def manifest(kpi: DataFrame, races: DataFrame, athletes: DataFrame, teams: DataFrame) -> DataFrame:
    """One row of totals, from the products themselves, and the list of products (`endpoints`: path, kind, description)."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    one = kpi.select("records", "races", "series", "sources", F.col("min_year").alias("year_min"), F.col("max_year").alias("year_max"), F.lit(1).alias("k"))
    for frame, name in ((races, "race_editions"), (athletes, "athletes"), (teams, "teams")):
        one = one.join(count(frame, name).withColumn("k", F.lit(1)), "k")
    listed = [F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind"), F.lit(what).alias("description")) for path, kind, what in ENDPOINTS]
    return one.drop("k").withColumn("endpoints", F.array(*listed))


def documents(flat: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """One row a key with its rows as a sorted array of structs: the nested form of a flat product (lists as long as a key's rows)."""
    rest = [c for c in flat.columns if c not in keys]
    items = F.sort_array(F.collect_list(F.struct(*order, *[c for c in rest if c not in order])))
    return flat.groupBy(*keys).agg(items.alias(name))

"""From sources to one table: what is dropped as copied, superseded or timeless, and what is masked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podia.functions import text as X
from podia.operators import identity as I


def without_zero_times(rows: DataFrame) -> DataFrame:
    """Rows with a time of zero or less go, unless they are marked DNF or DNS."""
    return rows.filter(F.coalesce(F.col("status").isin("DNF", "DNS"), F.lit(False)) | F.col("finish_seconds").isNull() | (F.col("finish_seconds") > 0))


def without_copies(rows: DataFrame) -> DataFrame:
    """The first row of each result that several sources have: same year, name and whole seconds.

    Where a source hides names, masked forms are compared: a hidden row is a
    copy of any earlier row of its masked form, and an open row is one of a
    hidden row that stays, which is then the first of its form. "Earlier" is by (source_ord, row_ord). Firsts are
    aggregates by key, which no hot key overloads; rows without name or time stay.
    """
    name, hidden = F.col("name_raw"), X.is_source_masked(F.col("name_raw"))
    seconds = F.floor("finish_seconds")
    checked = ~X.blank(name) & F.coalesce(F.col("finish_seconds") != 0, F.lit(False))
    at = F.struct("source_ord", "row_ord")
    keyed = rows.withColumns({"__m": X.mask_name(name), "__s": seconds, "__hidden": hidden, "__at": at})
    candidates = keyed.filter(checked)
    by_name = candidates.filter("not __hidden").groupBy("year", "name_raw", "__s").agg(F.min("__at").alias("first_named"))
    by_mask = candidates.groupBy("year", "__m", "__s").agg(F.min(F.struct("__at", "__hidden")).alias("first_masked"))

    def met(left: DataFrame, right: DataFrame, cols: list[str]) -> DataFrame:
        right = right.withColumnsRenamed({c: f"r_{c}" for c in cols})
        cond = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in cols]
        on = cond[0]
        for c in cond[1:]:
            on = on & c
        return left.join(right, on, "left").drop(*[f"r_{c}" for c in cols])

    seen = met(met(candidates, by_name, ["year", "name_raw", "__s"]), by_mask, ["year", "__m", "__s"])
    later = F.col("first_masked.__at") < F.col("__at")
    copy = F.when(F.col("__hidden"), later).otherwise((F.col("first_named") < F.col("__at")) | (F.col("first_masked.__hidden") & later))
    kept = seen.filter(~copy).select(rows.columns)
    return kept.unionByName(rows.filter(~checked))


def cross_listed(rows: DataFrame, least: int = 10, share: float = 0.95) -> DataFrame:
    """(source_ord, year, table_id) of result tables that are nearly all inside a larger table of another race of the same source and year.

    Tables meet only by the results that they share: the join is on (source,
    year, name, seconds), and what it gives is counted by pair of tables.
    """
    timed = rows.filter(~X.blank(F.col("name_raw")) & (F.col("finish_seconds") > 0) & (F.col("status").isNull() | (F.col("status") == "FIN")))
    entries = timed.select("source_ord", "year", "table_id", "race_key", "name_raw", F.floor("finish_seconds").alias("s")).distinct()
    tables = entries.groupBy("source_ord", "year", "table_id").agg(F.count_distinct("name_raw", "s").alias("n"), F.max("race_key").alias("race"))
    one = entries.select("source_ord", "year", "name_raw", "s", F.col("table_id").alias("a")).distinct()
    two = entries.select("source_ord", F.col("year").alias("y2"), "name_raw", "s", F.col("table_id").alias("b")).distinct()
    shared = one.join(two, ["source_ord", "name_raw", "s"]).filter(F.col("year").eqNullSafe(F.col("y2")) & (F.col("a") != F.col("b"))).groupBy("source_ord", "year", "a", "b").agg(F.count("*").alias("both"))
    a = tables.select("source_ord", F.col("year").alias("ya"), F.col("table_id").alias("a"), F.col("n").alias("na"), F.col("race").alias("ra"))
    b = tables.select("source_ord", F.col("year").alias("yb"), F.col("table_id").alias("b"), F.col("n").alias("nb"), F.col("race").alias("rb"))
    pairs = shared.join(a, ["source_ord", "a"]).filter(F.col("year").eqNullSafe(F.col("ya"))).join(b, ["source_ord", "b"]).filter(F.col("year").eqNullSafe(F.col("yb")))
    drop = pairs.filter((F.col("na") >= least) & (F.col("ra") != F.col("rb")) & (F.col("nb") > F.col("na")) & (F.col("both") >= share * F.col("na")))
    return drop.select("source_ord", "year", F.col("a").alias("table_id")).distinct()


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows that no row of `gone` names, by its columns; null equals null."""
    right = gone.withColumnsRenamed({c: f"g_{c}" for c in gone.columns})
    on = None
    for c in gone.columns:
        same = F.col(c).eqNullSafe(F.col(f"g_{c}"))
        on = same if on is None else on & same
    return rows.join(right, on, "left_anti")


def mask_teams(rows: DataFrame) -> DataFrame:
    """Teams that are a rider's own name are masked like one: whole CJK names of two to four characters, Latin ones of two to four words."""
    latin = r"^[A-Za-zÀ-ÿ'’.\-]+(?:\s+[A-Za-zÀ-ÿ'’.\-]+){1,3}$"
    form = lambda c: F.when(c.rlike(f"^{X.CJK}{{2,4}}$"), c).when(c.rlike(latin), F.lower(F.regexp_replace(c, r"\s+", " ")))
    names = rows.select(form(X.stripped(F.col("name_raw"))).alias("__name")).filter("__name is not null").distinct()
    met = rows.withColumn("__team", form(X.stripped(F.col("team")))).join(names, F.col("__team") == F.col("__name"), "left")
    return met.withColumn("team", F.when(F.col("__name").isNotNull(), X.mask_name(X.stripped(F.col("team")))).otherwise(F.col("team"))).drop("__team", "__name")


def mask_names_within(rows: DataFrame, least: int = 3, most: int = 4) -> DataFrame:
    """Riders' CJK names of three or four characters inside longer team texts are masked, the longer and earlier first.

    Every stretch of a distinct team text that may be a name is a row, met
    with the names by a join; so neither the names nor the teams are gathered.
    """
    names = rows.select(X.stripped(F.col("name_raw")).alias("name")).filter(F.col("name").rlike(f"^{X.CJK}{{{least},{most}}}$")).distinct()
    teams = rows.select("team").filter(F.col("team").rlike(f"{X.CJK}{{{least},}}")).distinct()
    starts = teams.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("team"))))
    parts = starts.withColumn("size", F.explode(F.array(*[F.lit(n) for n in range(least, most + 1)]))).withColumn("name", F.substring(F.col("team"), F.col("at"), F.col("size")))
    found = parts.join(names, "name").groupBy("team").agg(F.sort_array(F.collect_list(F.struct("at", (-F.col("size")).alias("less")))).alias("spans"))
    step = lambda s, x: F.when(x["at"] > s["end"], F.struct(F.concat(s["out"], F.substring(F.col("team"), s["end"] + 1, x["at"] - s["end"] - 1), X.mask_name(F.substring(F.col("team"), x["at"], -x["less"]))).alias("out"), (x["at"] - x["less"] - 1).alias("end"))).otherwise(s)
    masked = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).alias("end")), step, lambda s: F.concat(s["out"], F.substring(F.col("team"), s["end"] + 1, F.length("team"))))
    renamed = found.select(F.col("team").alias("__team"), masked.alias("__masked"))
    return rows.join(renamed, F.col("team") == F.col("__team"), "left").withColumn("team", F.coalesce("__masked", "team")).drop("__team", "__masked")


def summary(rows: DataFrame) -> DataFrame:
    """(facet, value, rows, finishers): totals by platform, year, gender, class, series and status, in one pass.

    The facets are grouping sets, which Spark expands before the partial aggregation.
    """
    cols = {"platform": "source_platform", "year": "year", "gender": "gender", "class": "race_class", "series": "series", "status": "status"}
    pairs = F.array(F.struct(F.lit("all").alias("facet"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("value")) for f, c in cols.items()])
    done = F.col("status").isNull() | (F.col("status") == "FIN")
    return rows.select(done.alias("done"), F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("rows"), F.count_if("done").alias("finishers"))


def races_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("race_key").agg(F.count("*").alias("rows"), F.min("year").alias("y0"), F.max("year").alias("y1"), F.count_distinct("year").alias("years"))


def merge(rows: DataFrame, superseded: DataFrame | None = None) -> DataFrame:
    """The whole merge of a union of sources: timeless rows, copies and superseded races go, teams are masked."""
    rows = without_copies(without_zero_times(rows))
    rows = rows if superseded is None else without(rows, superseded)
    return mask_teams(rows)


def public(rows: DataFrame) -> DataFrame:
    return rows.drop("name_raw")


def first_seen(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key by (source_ord, row_ord)."""
    order = Window.partitionBy(*keys).orderBy("source_ord", "row_ord")
    return rows.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def carryover(keyed: DataFrame, published: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(new_id, old_id): identities whose id changed keep the one that most of their results were published under, if it is free.

    published has (entry, athlete_id); entries of two athletes are ambiguous and
    left out. existing is the carry-over of the last build: its pairs stay as
    long as the new id occurs and the old one isn't in use, and their old ids are taken. An id is in use if some
    identity hashes to it; rows whose source hides names are pinned to published ids
    and use none, as they follow the id that is carried over. The first
    identity, by the place of its first row, gets an id that several want.
    """
    sure = published.groupBy("entry").agg(F.min("athlete_id").alias("old_id"), F.count_distinct("athlete_id").alias("k")).filter("k = 1").drop("k")
    entry = I.entry_key(F.col("race_key"), F.col("year"), F.col("finish_seconds"), F.col("name_masked"))
    rows = I.resolved(keyed).withColumn("new_id", I.athlete_id(F.col("gk"))).withColumn("entry", entry)
    used = rows.filter(~F.col("gk").startswith("x:")).select("new_id").distinct()
    if existing is None:
        existing = published.select(F.lit("").alias("new_id"), F.lit("").alias("old_id")).limit(0)
    stay = existing.select("new_id", "old_id").join(used, "new_id", "left_semi").join(used.withColumnRenamed("new_id", "old_id"), "old_id", "left_anti")
    fresh = rows.filter(~F.col("gk").rlike("^[xs]:")).join(published.select(F.col("athlete_id").alias("new_id")).distinct(), "new_id", "left_anti")
    order = F.struct(F.coalesce("source_ord", F.lit(0)), "row_ord")
    place = fresh.groupBy("new_id").agg(F.min(order).alias("first"))
    votes = fresh.join(sure, "entry").groupBy("new_id", "old_id").agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = votes.groupBy("new_id").agg(F.min_by("old_id", F.struct(-F.col("n"), "seen")).alias("old_id")).join(place, "new_id")
    free = best.join(used.withColumnRenamed("new_id", "old_id"), "old_id", "left_anti").join(stay.select("old_id"), "old_id", "left_anti")
    won = free.groupBy("old_id").agg(F.min_by("new_id", "first").alias("new_id"))
    return stay.join(won.select("new_id"), "new_id", "left_anti").select("new_id", "old_id").unionByName(won.select("new_id", "old_id"))

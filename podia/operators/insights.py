"""Findings over all results: age curve, breakouts, race ratings, places, record boards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podia.functions import measures as M
from podia.functions import text as X
from podia.operators import identity as I

#: Bins of a percent in which percentages are counted before quantiles are looked for.
PCT_BINS = 1000


def _scored(rows: DataFrame) -> DataFrame:
    return I.with_field(rows, I.field_sizes(rows, ranked_only=True))


def age_curve(rows: DataFrame, least: int = 50) -> DataFrame:
    """(band, g, n, p25, p50, p75): the percentage of the field beaten, by age band, over all and by gender.

    Equal percentages of a band are counted first; quantiles are then found in bins of a PCT_BINS-th of a percent.
    """
    known = _scored(rows).filter(F.col("pct").isNotNull() & F.col("age_band").isin(*X.AGE_MIDDLE))
    counted = known.groupBy(F.col("age_band").alias("band"), F.when(F.col("gender").isin("M", "F"), F.col("gender")).alias("gender"), "pct").agg(F.count("*").alias("c"))
    each = counted.select("band", F.explode(F.array_compact(F.array(F.lit("all"), "gender"))).alias("g"), "pct", "c")
    per = M.quantiles(each, ["band", "g"], "pct", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, PCT_BINS).filter(F.col("n") >= least)
    return per.select("band", "g", "n", *[F.round(p, 1).alias(p) for p in ("p25", "p50", "p75")])


def breakout(rows: DataFrame, least_a_year: int = 2, least_jump: float = 15.0, top: int = 40) -> DataFrame:
    """(id, from_y, to_y, from_pct, to_pct, jump): the largest rise of a yearly median from one racing year to the next.

    rows have no group keys yet: they get them when only their percentage, year and name are left, and of an
    identity's year a task sends its percentages together. A year of MIN_RESULTS ranked rows makes its identity trackable.
    """
    ranked = _scored(rows).filter("pct is not null and year <> 0").withColumn("row_ord", F.when(X.is_source_masked(F.col("name_raw")), F.col("row_ord")))
    keyed = I.resolved(I.with_group_keys(ranked.select("row_ord", "name_raw", "uci_id", "tsu_rider_id", "year", "pct"), seen=rows))
    if least_a_year < I.MIN_RESULTS:
        keyed = keyed.join(I.sizes(I.with_group_keys(rows)).filter(F.col("rows") >= I.MIN_RESULTS).select("gk"), "gk", "left_semi")
    yearly = keyed.groupBy("gk", "year").agg(M.median(F.col("pct")).alias("m"), F.count("*").alias("n")).filter(F.col("n") >= least_a_year)
    before = Window.partitionBy("gk").orderBy("year")
    steps = yearly.withColumn("from_y", F.lag("year").over(before)).withColumn("from_m", F.lag("m").over(before)).filter("from_y is not null")
    jump = F.col("m") - F.col("from_m")
    best = steps.groupBy("gk").agg(F.max_by(F.struct("from_y", F.col("year").alias("to_y"), F.round("from_m", 1).alias("from_pct"), F.round("m", 1).alias("to_pct"), F.round(jump, 1).alias("jump")), F.struct(F.round(jump, 9), -F.col("year"))).alias("b"))
    out = best.filter(F.col("b.jump") >= least_jump).select(I.athlete_id(F.col("gk")).alias("id"), "b.*")
    return out.orderBy(F.desc("jump"), "id").limit(top)


def geo(rows: DataFrame, rules=X.COUNTIES) -> DataFrame:
    """(region, races, rows): races and results by the county that the race's name or region gives."""
    place = X.county(F.col("race_name_canonical"), F.col("region"), rules)
    return rows.withColumn("place", place).filter("place is not null").groupBy(F.col("place").alias("region")).agg(F.count_distinct(F.coalesce("race_key", F.lit(""))).alias("races"), F.count("*").alias("rows"))


def ratings(rows: DataFrame, top: int = 60) -> DataFrame:
    """(race_key, name, score, med_field, editions, regular_pct, years, stars): races by size, age and the share of regulars.

    The name is that of the last row; editions and years leave year 0 out.
    """
    named = rows.filter(~X.blank(F.col("name_raw")))
    regular = named.groupBy("name_raw").agg(F.count_distinct("race_key").alias("races")).filter("races >= 3").select("name_raw", F.lit(1).alias("regular"))
    per = rows.filter(~X.blank(F.col("race_key"))).join(regular, "name_raw", "left").groupBy("race_key").agg(F.count("*").alias("finishers"), F.count("regular").alias("regulars"), F.max_by(X.filled(F.col("race_name_canonical"), F.col("race_key")), "row_ord").alias("name"), F.sort_array(F.collect_set(F.when(F.col("year") != 0, F.col("year")))).alias("years")).withColumn("editions", F.size("years").cast("long"))
    fields = I.field_sizes(rows, ranked_only=True).groupBy("race_key").agg(F.floor(M.median(F.col("field"))).alias("med_field")).filter("med_field >= 20")
    share = F.round(F.col("regulars") / F.col("finishers") * 100, 1)
    size = F.least(F.log10("med_field") / F.lit(math.log10(2500)), F.lit(1.0))
    score = F.bround((0.4 * size + 0.25 * F.least(F.col("editions") / 8, F.lit(1.0)) + 0.35 * F.least(F.col("regular_pct") / 40, F.lit(1.0))) * 100).cast("long")
    rated = per.join(fields, "race_key").withColumn("regular_pct", share).withColumn("score", score)
    order, all_ = Window.orderBy(F.desc("score"), "race_key"), Window.partitionBy()
    q = (F.row_number().over(order) - 1) / F.count("*").over(all_)
    stars = F.when(q < 0.1, 5).when(q < 0.3, 4).when(q < 0.6, 3).when(q < 0.85, 2).otherwise(1).cast("long")
    return rated.select("race_key", "name", "score", "med_field", "editions", "regular_pct", "years", stars.alias("stars")).orderBy(F.desc("score"), "race_key").limit(top)


def biggest_fields(rows: DataFrame, top: int = 8) -> DataFrame:
    """(rk, name, y, n): the race-years with most ranked rows; the name is that of the race's first row."""
    best = I.field_sizes(rows, ranked_only=True).filter("year <> 0").orderBy(F.desc("field"), "race_key", "year").limit(top)
    named = rows.join(F.broadcast(best.select("race_key").distinct()), "race_key", "left_semi").groupBy("race_key").agg(F.min_by(X.filled(F.col("race_name_canonical"), F.col("race_key")), "row_ord").alias("name"))
    return best.join(named, "race_key", "left").select(F.col("race_key").alias("rk"), "name", F.col("year").alias("y"), F.col("field").alias("n"))


def _streak(years: Column) -> Column:
    """The longest run of consecutive years in a sorted array of different ones."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("best"))

    def step(so_far: Column, year: Column) -> Column:
        run = F.when(so_far["last"] == year - 1, so_far["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(year.alias("last"), run.alias("run"), F.greatest(so_far["best"], run).alias("best"))

    return F.aggregate(years, start, step, lambda x: x["best"])


def _loyal(rode: Column) -> Column:
    """(race_key, years): the race with most different years in a sorted array of (race_key, year); of several the first by name."""
    start = F.struct(F.lit(None).cast("string").alias("race"), F.lit(None).cast("long").alias("year"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("race_key"), F.lit(0).cast("long").alias("years"))

    def step(so_far: Column, x: Column) -> Column:
        more = F.when(so_far["year"] == x["year"], so_far["n"]).otherwise(so_far["n"] + 1)
        n = F.when(so_far["race"] == x["race_key"], more).otherwise(F.lit(1).cast("long"))
        ahead = n > so_far["years"]
        return F.struct(x["race_key"].alias("race"), x["year"].alias("year"), n.alias("n"), F.when(ahead, x["race_key"]).otherwise(so_far["race_key"]).alias("race_key"), F.greatest(n, so_far["years"]).alias("years"))

    return F.aggregate(rode, start, step, lambda x: F.struct(x["race_key"].alias("race_key"), x["years"].alias("years")))


def careers(rows: DataFrame) -> DataFrame:
    """(id, nm, g, n, wins, nr, streak, lrk, lname, lyears) of athletes whose identity isn't doubtful; lrk is the race ridden in most years, lname its first row's name.

    rows have no group keys yet: they meet by name, once, and become one row for each name and its ids; these
    get keys and meet by identity. Rows whose source hid the name stand alone, those with neither name nor id are nobody's.
    """
    alone = F.when(X.is_source_masked(F.col("name_raw")), F.col("row_ord"))
    named = rows.filter(~(X.blank(F.col("name_raw")) & X.blank(F.col("tsu_rider_id")) & X.blank(F.col("uci_id"))))
    who = ["name_raw", "name_masked", "tsu_rider_id", "uci_id"]
    met = named.select(*who, alone.alias("row_ord"), F.col("row_ord").alias("place"), "team", "gender", "race_key", "year", (F.col("rank_overall") == 1).alias("won")).repartition("name_raw")
    groups = met.groupBy(*who, "row_ord").agg(
        F.count("*").alias("n"), F.min("place").alias("first"), F.count_if(F.col("won")).alias("wins"), F.count_if(F.col("gender") == "M").alias("men"), F.count_if(F.col("gender") == "F").alias("women"),
        F.collect_set(F.when(~X.blank(F.col("team")), F.col("team"))).alias("teams"), F.collect_set(F.struct("race_key", "year")).alias("rode"),
    )
    spelt = Window.partitionBy("gk", "name_masked")
    keyed = I.resolved(I.with_group_keys(groups, seen=rows)).repartition("gk").withColumns({"__n": F.sum("n").over(spelt), "__first": F.min("first").over(spelt)})
    per = keyed.groupBy("gk").agg(
        F.min_by("name_masked", F.struct(-F.col("__n"), "__first")).alias("nm"), F.min_by("name_raw", "first").alias("name_raw"),
        *[F.sum(c).alias(c) for c in ("n", "wins", "men", "women")], *[F.flatten(F.collect_list(c)).alias(c) for c in ("teams", "rode")],
    )
    length = F.length(F.regexp_replace(F.coalesce("name_raw", F.lit("")), r"(?U)\s", ""))
    conf = I.confidence(F.col("gk").rlike("^[tu]:"), F.size(F.array_distinct("teams")), length, (F.col("men") > 0) & (F.col("women") > 0))
    sure = per.filter(F.col("n") >= I.MIN_RESULTS).filter(conf != "low")
    dated = F.filter("rode", lambda x: x["year"] != 0)
    sure = sure.withColumn("l", _loyal(F.sort_array(F.filter(dated, lambda x: x["race_key"].isNotNull()))))
    different = F.size(F.array_distinct(F.transform("rode", lambda x: F.coalesce(x["race_key"], F.lit(""))))).cast("long")
    streak = _streak(F.sort_array(F.array_distinct(F.transform(dated, lambda x: x["year"]))))
    names = rows.filter("race_key is not null").groupBy("race_key").agg(F.min_by(X.filled(F.col("race_name_canonical"), F.col("race_key")), "row_ord").alias("lname"))
    g = F.when(F.col("men") > F.col("women"), "M").when(F.col("women") > F.col("men"), "F")
    out = sure.select(I.athlete_id(F.col("gk")).alias("id"), "nm", g.alias("g"), "n", "wins", different.alias("nr"), streak.alias("streak"), F.col("l.race_key").alias("lrk"), F.col("l.years").alias("lyears"))
    out = out.join(F.broadcast(names.withColumnRenamed("race_key", "lrk")), "lrk", "left")  # a row a race
    return out.select("id", "nm", "g", "n", "wins", "nr", "streak", "lrk", "lname", "lyears")


def boards(careers_: DataFrame, top: int = 8) -> DataFrame:
    """(board, place, id, nm, g, rk, name, v): the athletes with most starts, wins, races, the longest streak, and the most years at one race (rk, name).

    One pass: an athlete is a row for each board, and of a board's rows Spark
    keeps `top` in each task before they meet.
    """
    wanted = {"most_starts": ("n", 0), "most_wins": ("wins", 0), "most_races": ("nr", 0), "longest_streak": ("streak", 0), "most_loyal": ("lyears", 1)}
    entries = [F.when(F.col(c) > above, F.struct(F.lit(name).alias("board"), F.col(c).alias("v"))) for name, (c, above) in wanted.items()]
    rows = careers_.select("id", "nm", "g", "lrk", "lname", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*", "id", "nm", "g", "lrk", "lname")
    place = F.row_number().over(Window.partitionBy("board").orderBy(F.desc("v"), "id"))
    loyal = F.col("board") == "most_loyal"
    first = rows.withColumn("place", place).filter(F.col("place") <= top)
    return first.select("board", F.col("place").cast("long").alias("place"), "id", "nm", "g", F.when(loyal, F.col("lrk")).alias("rk"), F.when(loyal, F.col("lname")).alias("name"), "v")

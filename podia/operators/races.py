"""Products by race: index, leaderboards, cross-year views, difficulty, benchmarks, DNA, overviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podia.functions import measures as M
from podia.functions import text as X
from podia.operators import identity as I

OTHER = "其他"
DNA_AXES = ("sel", "size", "climb", "prest", "repeat", "women")


def finishers(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("status").isNull() | (F.col("status") == "FIN"))


def group_label() -> Column:
    return X.filled(F.col("result_label"), X.ALL_LABELS).alias("label")


def slim(rows: DataFrame) -> DataFrame:
    """One short row a finisher, for interactive filters; its distance is looked for in the race's name too if rows have that."""
    name = F.col("race_name_raw") if "race_name_raw" in rows.columns else F.lit(None).cast("string")
    km = X.distance_km(F.col("category_raw"), F.col("result_label"), name)
    t = F.col("finish_seconds")
    return finishers(rows).select(
        F.col("race_key").alias("rk"), F.col("year").alias("y"), X.month_of(F.col("date")).cast("long").alias("mon"), F.col("series").alias("s"), F.col("race_class").alias("rc"),
        F.col("category_raw").alias("cat"), F.col("gender").alias("g"), F.col("age_band").alias("ag"), F.floor(t).alias("t"), F.col("rank_overall").alias("rank"),
        km.cast("long").alias("dist"), X.speed_kmh(km, t).alias("spd"), F.col("source_platform").alias("plat"), F.col("region").alias("reg"),
    )


def index(rows: DataFrame) -> DataFrame:
    """One row a race-year: the race's latest name and series, finishers, first day, whether it has more years or teams, and how many completed it."""
    day = F.substring("date", 1, 10)
    st = F.col("status")
    per = rows.groupBy("race_key", "year").agg(
        F.count_if(st.isNull() | (st == "FIN")).alias("rows"), F.max(~X.blank(F.col("team"))).alias("has_team"),
        F.min(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), day)).alias("d"), F.count_if(~X.blank(st)).alias("total"), F.count_if(st == "FIN").alias("fin"),
        F.count_if(st.isin("DNF", "DQ", "SRT")).alias("not_finished"), F.count_if(st.isin("DNS", "NYS")).alias("not_started"), F.count_if(st == "NF").alias("unknown"),
    )
    series = F.col("series") if "series" in rows.columns else F.lit(None).cast("string")
    last = F.max_by(F.struct(F.col("race_name_canonical").alias("rn"), series.alias("s")), F.struct(*[c for c in ("source_ord", "row_ord") if c in rows.columns]))
    of_race = rows.groupBy(F.col("race_key").alias("k")).agg(last.alias("last"))
    years = per.groupBy("race_key").agg((F.count_distinct(F.when(F.col("year") != 0, F.col("year"))) > 1).alias("multi_year"))
    met = per.join(years.withColumnRenamed("race_key", "j"), F.col("race_key").eqNullSafe(F.col("j"))).join(of_race, F.col("race_key").eqNullSafe(F.col("k")))
    return met.select(
        F.col("race_key").alias("rk"), F.col("year").alias("y"), "last.rn", "last.s", "rows", "multi_year", "has_team", X.race_file(F.col("race_key"), F.col("year")).alias("file"), "d",
        "fin", "total", F.when(F.col("total") > 0, F.round(F.col("fin") / F.col("total"), 3)).alias("rate"), "not_finished", "not_started", "unknown",
    )


def leaderboard(rows: DataFrame) -> DataFrame:
    """One row a finisher, with the place by time in the race-year's comparable group (category and label)."""
    group = Window.partitionBy("race_key", "year", "category_raw", "result_label").orderBy("finish_seconds", "row_ord")
    place = F.when(F.col("finish_seconds").isNotNull(), F.row_number().over(group.partitionBy("race_key", "year", "category_raw", "result_label", F.col("finish_seconds").isNull())))
    return finishers(rows).select(
        F.col("race_key").alias("rk"), F.col("year").alias("y"), F.col("category_raw").alias("cat"), F.col("result_label").alias("label"), F.col("name_masked").alias("name"),
        "bib", F.col("gender").alias("g"), "team", F.col("rank_overall").alias("rank"), F.col("finish_seconds").alias("t"), place.cast("long").alias("place"), "row_ord",
    )


def comparable_groups(rows: DataFrame) -> DataFrame:
    """(rk, y, cat, label, name, n): a race-year's groups whose times compare, named by category, by label too where that is needed."""
    per = finishers(rows).groupBy("race_key", "year", "category_raw", "result_label").agg(F.count("*").alias("n"))
    labels = F.size(F.collect_set(F.when(~X.blank(F.col("result_label")), F.col("result_label"))).over(Window.partitionBy("race_key", "year", F.coalesce("category_raw", F.lit("")))))
    cat, label = F.col("category_raw"), F.col("result_label")
    name = F.when(~X.blank(cat), F.when((labels > 1) & ~X.blank(label), F.concat_ws(" · ", cat, label)).otherwise(cat)).otherwise(X.filled(label, "未分組"))
    return per.select(F.col("race_key").alias("rk"), F.col("year").alias("y"), cat.alias("cat"), label.alias("label"), name.alias("name"), "n")


def team_strength(rows: DataFrame, top: int = 10, cutoff: int = 10) -> DataFrame:
    """(rk, y, team, top, podium): the teams of each race-year with most riders in the first ranks."""
    ranked = finishers(rows).filter(~X.blank(F.col("team")) & F.col("rank_overall").isNotNull())
    per = ranked.groupBy("race_key", "year", "team").agg(F.count_if(F.col("rank_overall") <= cutoff).alias("top"), F.count_if(F.col("rank_overall") <= 3).alias("podium")).filter("top > 0")
    order = Window.partitionBy("race_key", "year").orderBy(F.desc("top"), F.desc("podium"), "team")
    return per.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select(F.col("race_key").alias("rk"), F.col("year").alias("y"), "team", "top", "podium")


def crossyear(rows: DataFrame) -> DataFrame:
    """(rk, label, y, winner, median, p25, p75, n) for groups that have two years at least."""
    t = F.floor("finish_seconds")
    timed = finishers(rows).filter("race_key is not null and year is not null and finish_seconds is not null")
    per = timed.groupBy("race_key", group_label(), "year").agg(
        F.min(t).alias("winner"), *[M.half_even(M.quantile(t, q)).cast("long").alias(n) for n, q in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))], F.count("*").alias("n")
    )
    years = F.count("*").over(Window.partitionBy("race_key", "label"))
    return per.withColumn("years", years).filter("years >= 2").select(F.col("race_key").alias("rk"), "label", F.col("year").alias("y"), "winner", "median", "p25", "p75", "n")


def difficulty(rows: DataFrame, least: int = 20) -> DataFrame:
    """(rk, label, y, baseline, median, coeff, n): each year's median time against the median of the group's yearly medians."""
    timed = rows.filter("race_key is not null and year <> 0 and finish_seconds > 0")
    per = timed.groupBy("race_key", group_label(), "year").agg(M.median(F.col("finish_seconds")).alias("m"), F.count("*").alias("n")).filter(F.col("n") >= least)
    base = per.groupBy("race_key", "label").agg(M.median(F.col("m")).alias("b"), F.count("*").alias("years")).filter("years >= 2 and b > 0")
    out = per.join(base, ["race_key", "label"])
    return out.select(
        F.col("race_key").alias("rk"), "label", F.col("year").alias("y"), M.half_even(F.col("b")).cast("long").alias("baseline"), M.half_even(F.col("m")).cast("long").alias("median"),
        F.round(F.col("m") / F.col("b"), 4).alias("coeff"), "n",
    )


def severity(diff: DataFrame) -> DataFrame:
    """(rk, y, label, n, finisher_delta, time_delta, verdict) of each race's largest group: fewer and slower than usual is severe."""
    total = diff.groupBy("rk", "label").agg(F.sum("n").alias("all"), M.median(F.col("n")).alias("usual"))
    main = total.groupBy("rk").agg(F.max_by(F.struct("label", "usual"), F.struct("all", F.col("label"))).alias("m")).select("rk", "m.label", "m.usual")
    up = lambda c: F.floor(c + 0.5).cast("long")
    rows = diff.join(main, ["rk", "label"]).withColumn("finisher_delta", up((F.col("n") / F.col("usual") - 1) * 100)).withColumn("time_delta", up((F.col("coeff") - 1) * 100))
    fewer, slower = F.col("finisher_delta") <= -20, F.col("time_delta") >= 5
    verdict = F.when(fewer & slower, "嚴苛").when(fewer | slower, "偏難").when((F.col("finisher_delta") >= 0) & (F.col("time_delta") <= -5), "偏易").otherwise("正常")
    return rows.select("rk", "y", "label", "n", "finisher_delta", "time_delta", verdict.alias("verdict"))


def calibrated(hist: DataFrame, diff: DataFrame) -> DataFrame:
    """(id, rk, y, raw, calibrated, coeff): each athlete's fastest time of a race-year, made comparable across years."""
    timed = hist.filter("t > 0 and y is not null").withColumn("label", X.filled(F.col("label"), X.ALL_LABELS))
    met = timed.join(diff.select("rk", "label", "y", "coeff"), ["rk", "label", "y"])
    best = met.groupBy("id", "rk", "y").agg(F.min_by(F.struct("t", "coeff"), F.struct("t", "seq")).alias("b"))
    return best.select("id", "rk", "y", F.col("b.t").alias("raw"), F.floor(F.col("b.t") / F.col("b.coeff") + 0.5).alias("calibrated"), F.col("b.coeff").alias("coeff"))


def benchmarks(rows: DataFrame, least: int = 20) -> DataFrame:
    """(rk, label, cohort, type, n, bp, years): finish times at each percentile of every cohort with enough finishers, and the group's years.

    A finisher is of several cohorts: all, the age band, the band and gender,
    the category. Finishers are counted by all that tells cohorts, and only these counts, summed up
    over a time's rows, are told apart by cohort: no task holds a row for each finisher
    and cohort. The times at the 101 percentiles are picked from the
    cohort's times by running counts, so that no cohort is gathered into a list.
    """
    timed = finishers(rows).filter("race_key is not null and finish_seconds is not null")
    band, g, cat = F.col("age_band"), F.col("gender"), F.col("category_raw")
    telling = ["age_band", "gender", "category_raw"]
    cells = timed.groupBy("race_key", group_label(), "year", *telling, F.floor("finish_seconds").alias("t")).agg(F.count("*").alias("c"))
    told = cells
    for i in range(len(telling) + 1):
        # How many have the time and the first i of what tells cohorts, in one row of these: four windows of one shuffle and sort.
        alike = Window.partitionBy("race_key", "label", "t", *telling[:i]).orderBy(*telling[i:], "year")
        every = F.sum("c").over(alike.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        told = told.withColumn(f"n{i}", F.when(F.row_number().over(alike) == 1, every))
    cohort = lambda key, n: F.when(F.col(n).isNotNull(), F.struct(key.alias("cohort"), F.col(n).alias("c")))
    cohorts = F.array_compact(
        F.array(
            cohort(F.lit("all"), "n0"),
            F.when(~X.blank(band), cohort(F.concat(F.lit("age:"), band), "n1")),
            F.when(~X.blank(band) & g.isin("M", "F"), cohort(F.concat(F.lit("age:"), band, F.lit("|g:"), g), "n2")),
            F.when(~X.blank(cat), cohort(F.concat(F.lit("cat:"), cat), "n3")),
        )
    )
    times = told.select("race_key", "label", "t", F.explode(cohorts).alias("x")).select("race_key", "label", "t", "x.*")
    keys = ["race_key", "label", "cohort"]
    of = Window.partitionBy(*keys).orderBy("t")
    run = times.withColumn("n", F.sum("c").over(of.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).withColumn("upto", F.sum("c").over(of.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.filter(F.col("n") >= least)
    place = lambda p: F.bround(p / 100 * (F.col("n") - 1))

    def first_percentile(at: Column) -> Column:
        """The least percentile whose place is `at` or beyond; 101 if none. Rounding leaves one of three neighbours."""
        guess = F.ceil((at - 0.5) * 100 / F.greatest(F.col("n") - 1, F.lit(1))).cast("int")
        near = F.when(place(guess - 1) >= at, guess - 1).when(place(guess) >= at, guess).otherwise(guess + 1)
        return F.when(at <= 0, 0).when(at >= F.col("n"), 101).otherwise(near)

    run = run.withColumn("from", first_percentile(F.col("upto") - F.col("c"))).withColumn("to", first_percentile(F.col("upto")) - 1).filter("from <= to")
    points = run.select(*keys, "n", "t", F.explode(F.sequence("from", "to")).alias("p")).groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("p", "t"))).alias("points"))
    out = points.withColumn("bp", F.transform("points", lambda x: x["t"]))
    a_year = cells.groupBy("race_key", "label", "year").agg(F.sum("c").alias("c"))
    kept = a_year.groupBy("race_key", "label").agg(F.sort_array(F.collect_list("year")).alias("years"), F.sum("c").alias("timed")).filter(F.col("timed") >= least)
    return out.join(kept, ["race_key", "label"]).select(F.col("race_key").alias("rk"), "label", "cohort", F.substring_index("cohort", ":", 1).alias("type"), "n", "bp", "years")


def benchmark_lookup(bench: DataFrame, race: str, seconds: int, label: str | None = None, age: str | None = None, gender: str | None = None) -> DataFrame:
    """The percentage of the most specific cohort of a race that a time beats: (rk, label, cohort, n, percentile_beat)."""
    own = bench.filter(F.col("rk") == race)
    wanted = [*([f"age:{age}|g:{gender}"] if age and gender else []), *([f"age:{age}"] if age else []), "all"]
    size = F.max(F.when(F.col("cohort") == "all", F.col("n"))).over(Window.partitionBy("label"))
    pick = own.withColumn("given", F.lit(1) if label is None else F.when(F.col("label") == label, 0).otherwise(1)).withColumn("size", size)
    order = F.array_position(F.array(*map(F.lit, wanted)), F.col("cohort"))
    chosen = pick.withColumn("order", order).filter("order > 0").orderBy("given", F.desc("size"), "label", "order").limit(1)
    slower = F.size(F.filter("bp", lambda t: t > seconds)) / F.size("bp")
    return chosen.select("rk", "label", "cohort", "n", F.bround(slower * 100).cast("long").alias("percentile_beat"))


def dna(keyed: DataFrame, least: int = 20) -> DataFrame:
    """(rk, y, n, sel, size, climb, prest, repeat, women): six traits of each race-year as percentiles over all race-years.

    Traits are aggregates by race-year; only their table, a row a race-year, is ranked as a whole.
    """
    rows = keyed.filter("race_key is not null and year is not null").withColumn("known", ~F.col("gk").isin(*I.NOBODY))
    riders = rows.filter("known").groupBy("gk", "race_key", "year").agg(F.lit(1).alias("one"))
    mine, here = Window.partitionBy("gk"), Window.partitionBy("gk", "race_key")
    riders = riders.withColumn("editions", F.count("*").over(mine)).withColumn("here", F.count("*").over(here))
    regular = riders.groupBy("race_key", "year").agg(F.count("*").alias("riders"), F.count_if(F.col("here") > 1).alias("repeaters"), F.count_if(F.col("editions") >= 3).alias("regulars"))

    km = X.distance_km(F.col("category_raw"), F.col("result_label"), F.col("race_name_canonical"))
    per = rows.withColumn("spd", X.speed_kmh(km, F.col("finish_seconds"))).groupBy("race_key", "year").agg(
        F.count("*").alias("n"), F.count("spd").alias("speeds"), M.median(F.col("spd")).alias("speed"),
        F.count_if(F.col("gender").isin("M", "F")).alias("gendered"), F.count_if(F.col("gender") == "F").alias("f"),
    ).filter(F.col("n") >= least)
    spread = rows.filter("finish_seconds > 0").groupBy("race_key", "year", group_label()).agg(F.count("*").alias("c"), (F.stddev_pop("finish_seconds") / F.avg("finish_seconds")).alias("cov")).filter("c >= 10")
    spread = spread.groupBy("race_key", "year").agg((F.sum(F.col("cov") * F.col("c")) / F.sum("c")).alias("sel"))
    raw = per.join(regular, ["race_key", "year"], "left").join(spread, ["race_key", "year"], "left").select(
        F.col("race_key").alias("rk"), F.col("year").alias("y"), "n", "sel", F.col("n").cast("double").alias("size"),
        F.when(F.col("speeds") >= F.greatest(F.lit(5.0), F.col("n") * 0.2), -F.col("speed")).alias("climb"),
        (F.col("regulars") / F.col("riders") * 100).alias("prest"), (F.col("repeaters") / F.col("riders") * 100).alias("repeat"),
        F.when(F.col("gendered") / F.col("n") >= 0.3, F.col("f") / F.col("gendered") * 100).alias("women"),
    )

    def percentile(axis: str) -> Column:
        of = Window.partitionBy(F.col(axis).isNull())
        place = F.row_number().over(of.orderBy(F.round(axis, 9), "rk", "y")) - 1
        n = F.count("*").over(of)
        return F.when(F.col(axis).isNull(), 50.0).when(n == 1, 50.0).otherwise(place / (n - 1) * 100)

    return raw.select("rk", "y", "n", *[F.bround(percentile(a)).cast("long").alias(a) for a in DNA_AXES])


def similar_races(prints: DataFrame, race: str, year: int, k: int = 5) -> DataFrame:
    """(rk, y, sim): the k other races whose nearest edition is most like the given one."""
    me = prints.filter((F.col("rk") == race) & (F.col("y") == year)).limit(1).select(*[F.col(a).alias(f"my_{a}") for a in DNA_AXES])
    dist = F.sqrt(sum(F.pow(F.col(a) - F.col(f"my_{a}"), 2) for a in DNA_AXES))
    others = prints.filter(F.col("rk") != race).join(F.broadcast(me)).withColumn("sim", F.round(100 * F.exp(-dist / 90)).cast("long"))
    best = others.groupBy("rk").agg(F.max_by(F.struct("y", "sim"), F.struct("sim", -F.col("y"))).alias("b"))
    return best.select("rk", "b.y", "b.sim").orderBy(F.desc("sim"), "rk").limit(k)


def spread(view: DataFrame, least: int = 10) -> DataFrame:
    """(rk, y, winner, median, ratio, n) of a slim view: how far the median is behind the winner."""
    timed = view.filter("t is not null").filter(~F.coalesce(F.col("rc").isin("認證", "電輔車"), F.lit(False)) & ~F.coalesce(F.col("s").rlike("認證|雙塔|北高|四極"), F.lit(False)))
    per = timed.groupBy("rk", "y").agg(F.min("t").alias("winner"), M.median(F.col("t")).alias("median"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return per.withColumn("ratio", F.when(F.col("winner") > 0, F.round(F.col("median") / F.col("winner"), 6)).otherwise(0.0))


def boxes(view: DataFrame, least: int = 8) -> DataFrame:
    """(ag, min, q1, median, q3, max, n): the spread of times by age band."""
    per = view.filter("ag is not null and t is not null").groupBy("ag").agg(
        F.min("t").alias("min"), *[M.quantile(F.col("t"), q).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))], F.max("t").alias("max"), F.count("*").alias("n")
    )
    return per.filter(F.col("n") >= least)


def histogram(view: DataFrame, seconds: int = 600) -> DataFrame:
    """(x0, x1, count): how many times fall in each bin, empty bins between the first and the last included."""
    binned = view.filter("t is not null").groupBy((F.floor(F.col("t") / seconds) * seconds).alias("x0")).agg(F.count("*").alias("count"))
    span = binned.agg(F.min("x0").alias("lo"), F.max("x0").alias("hi")).filter("lo is not null")
    every = span.select(F.explode(F.sequence("lo", "hi", F.lit(seconds).cast("long"))).alias("x0"))
    return every.join(binned, "x0", "left").select("x0", (F.col("x0") + seconds).alias("x1"), F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def distance_speed(view: DataFrame) -> DataFrame:
    """(dist, spd, rc): a point for each row of a slim view that has a distance and a speed."""
    return view.filter("dist is not null and spd is not null").select("dist", "spd", "rc")


def facets(view: DataFrame) -> DataFrame:
    """(facet, value): the distinct values that the view can be filtered by; years as text."""
    cols = {"year": "y", "series": "s", "class": "rc", "gender": "g", "age": "ag"}
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).cast("string").alias("value")) for f, c in cols.items()])
    return view.select(F.explode(pairs).alias("x")).select("x.facet", "x.value").filter(~X.blank(F.col("value"))).distinct()


def apply_filters(view: DataFrame, **wanted: list) -> DataFrame:
    """The rows of a slim view whose columns have one of the wanted values; an empty list wants all."""
    conditions = [F.col(c).isin(*values) for c, values in wanted.items() if values]
    return view.filter(reduce(Column.__and__, conditions)) if conditions else view


def explore_summary(view: DataFrame) -> DataFrame:
    """One row: finishers, races, first and last year, and the share of women if enough genders are known."""
    known, f = F.count_if(F.col("g").isin("M", "F")), F.count_if(F.col("g") == "F")
    return view.agg(F.count("*").alias("n"), F.count_distinct("rk").alias("races"), F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.when(known >= 30, F.floor(100 * f / known + 0.5)).alias("women_pct"))


def ridgeline(bench: DataFrame, names: DataFrame, n: int = 8) -> DataFrame:
    """(label, x, y, median, finishers): the largest race of each family, by median time, for the title picture."""
    all_ = bench.filter("cohort = 'all'").groupBy("rk").agg(F.max_by(F.struct("n", "bp"), F.struct("n", F.col("label"))).alias("b"))
    rows = all_.join(names, "rk").select("rk", X.clean_label(F.col("rn")).alias("label"), F.col("b.bp")[50].alias("median"), F.col("b.n").alias("finishers"))
    family = rows.groupBy(X.family_key(F.col("label"))).agg(F.max_by(F.struct("label", "median", "finishers"), F.struct("finishers", F.col("rk"))).alias("r")).select("r.*")
    top = family.orderBy(F.desc("finishers"), "label").limit(n)
    all_rows, order = Window.partitionBy(), Window.orderBy("median", "label")
    low, high = F.min("median").over(all_rows), F.max("median").over(all_rows)
    return top.select("label", (F.row_number().over(order) - 1).cast("long").alias("x"), F.round((F.col("median") - low) / F.greatest(high - low, F.lit(1)), 4).alias("y"), "median", "finishers")


# Overview of a slim view


def kpi(view: DataFrame) -> DataFrame:
    there = lambda c: F.count_distinct(F.when(~X.blank(F.col(c)), F.col(c)))
    return view.agg(F.count("*").alias("records"), there("rk").alias("races"), there("s").alias("series"), F.min("y").alias("min_year"), F.max("y").alias("max_year"), there("plat").alias("sources"))


def heat(view: DataFrame) -> DataFrame:
    """(mon, y, n): finishers by month and year."""
    return view.filter("mon is not null and y is not null").groupBy("mon", "y").agg(F.count("*").alias("n"))


def trend(view: DataFrame, top: int = 8) -> DataFrame:
    """(s, y, n): finishers by series and year, the largest series by name, the rest as one; every such series has every year."""
    s = X.filled(F.col("s"), OTHER)
    per = view.groupBy(s.alias("s"), "y").agg(F.count("*").alias("n"))
    largest = per.groupBy("s").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "s").limit(top).select(F.col("s").alias("kept"))
    named = per.join(F.broadcast(largest), F.col("s") == F.col("kept"), "left").withColumn("s", F.coalesce("kept", F.lit(OTHER)))
    return named.filter("y is not null").groupBy("s", "y").agg(F.sum("n").alias("n"))


def women(view: DataFrame, least: int = 50) -> DataFrame:
    """(series, f, total, pct): the share of women by series, where enough genders are known."""
    per = view.filter("g in ('M', 'F')").groupBy(X.filled(F.col("s"), OTHER).alias("series")).agg(F.count_if(F.col("g") == "F").alias("f"), F.count("*").alias("total"))
    return per.filter(F.col("total") >= least).withColumn("pct", M.half_even(100 * F.col("f") / F.col("total")).cast("long"))


def composition(view: DataFrame) -> DataFrame:
    """(rc, male, female, unknown): finishers by class and gender."""
    g = F.col("g")
    return view.groupBy(X.filled(F.col("rc"), "未分類").alias("rc")).agg(
        F.count_if(g == "M").alias("male"), F.count_if(g == "F").alias("female"), F.count_if(g.isNull() | ~g.isin("M", "F")).alias("unknown")
    )


def gender_trend(view: DataFrame) -> DataFrame:
    return view.filter("y is not null and g in ('M', 'F')").groupBy("y").agg(F.count_if(F.col("g") == "F").alias("f"), F.count("*").alias("known"))


def age_trend(view: DataFrame) -> DataFrame:
    """(y, ag, pct): each band's share of the year's finishers with a known band."""
    per = view.filter(F.col("y").isNotNull() & F.col("ag").isin(*X.AGE_MIDDLE)).groupBy("y", "ag").agg(F.count("*").alias("n"))
    return per.withColumn("pct", M.half_even(100 * F.col("n") / F.sum("n").over(Window.partitionBy("y"))).cast("long"))


def by_source(view: DataFrame) -> DataFrame:
    return view.filter(~X.blank(F.col("plat"))).groupBy("plat").agg(F.count("*").alias("n"))

"""Headlines: a race-year in numbers with a guarded comparison to its last edition, and what changed over the seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podia.functions import measures as M
from podia.functions import text as X
from podia.operators import races

NO_GROUP = "未標組別"


def _half_up(col: Column) -> Column:
    return F.floor(col + 0.5)


def changes(points: DataFrame, least: int = 30, most_ratio: float = 2.0, most_pct: float = 15.0) -> DataFrame:
    """(rk, y, change): of races.crossyear() points, each race-year's move against the edition before, by its largest fit group.

    A group fits if both fields have `least` riders, neither is over most_ratio
    times the other, and the median moved by most_pct percent at most. Ties go
    to the first label.
    """
    editions = Window.partitionBy("rk", "label").orderBy("y")
    both = points.withColumns({f"prev_{c}": F.lag(c).over(editions) for c in ("y", "median", "n")})
    pct = (F.col("median") - F.col("prev_median")) / F.col("prev_median") * 100
    ratio = F.col("n") / F.col("prev_n")
    fit = both.filter((F.col("n") >= least) & (F.col("prev_n") >= least) & ratio.between(1 / most_ratio, most_ratio) & (F.abs(pct) <= most_pct))
    change = F.struct("label", F.col("prev_y"), (F.col("median") - F.col("prev_median")).alias("seconds"), (_half_up(pct * 10) / 10).alias("pct"))
    return fit.groupBy("rk", "y").agg(F.min_by(change, F.struct(-F.col("n"), "label")).alias("change"))


def race_summaries(rows: DataFrame) -> DataFrame:
    """(rk, y, finishers, grp, grp_finishers, median, winner, rate_pct, chg_label, chg_prev_y, chg_seconds, chg_pct), one row a race-year.

    finishers have a time; median and winner are those of the largest group
    (category, else label), the first in order if several are. grp is null where
    all finishers are one group. Rows without race or year are left out.
    """
    known = rows.filter("race_key is not null and year is not null")
    timed = races.finishers(known).filter("finish_seconds is not null")
    t, group = F.col("finish_seconds"), F.coalesce("category_raw", "result_label", F.lit("")).alias("grp")
    groups = timed.groupBy(F.col("race_key").alias("rk"), F.col("year").alias("y"), group).agg(F.count("*").alias("n"), M.median(t).alias("median"), F.min(t).alias("winner"))
    first = F.min_by(F.struct("grp", "n", "median", "winner"), F.struct(-F.col("n"), "grp")).alias("g")
    top = groups.groupBy("rk", "y").agg(F.sum("n").alias("finishers"), F.count("*").alias("groups"), first)
    out = races.index(known).select("rk", "y", "rate").join(top, ["rk", "y"], "left").join(changes(races.crossyear(known)), ["rk", "y"], "left")
    return out.select(
        "rk", "y", F.coalesce("finishers", F.lit(0)).alias("finishers"), F.when(F.col("groups") > 1, F.when(F.col("g.grp") == "", NO_GROUP).otherwise(F.col("g.grp"))).alias("grp"),
        F.coalesce("g.n", F.lit(0)).alias("grp_finishers"), "g.median", "g.winner", _half_up(F.col("rate") * 100).alias("rate_pct"),
        F.col("change.label").alias("chg_label"), F.col("change.prev_y").alias("chg_prev_y"), F.col("change.seconds").alias("chg_seconds"), F.col("change.pct").alias("chg_pct"),
    )


def trends_summary(view: DataFrame, this_year: int, least: int = 30) -> DataFrame:
    """(what, band, from_y, to_y, from_pct, to_pct): the women's share, and the age bands that grew, shrank and lead most.

    Of races.slim(): the first finished season against the last one; for women
    only seasons with `least` riders of known gender count. Nothing is said
    where there is just one such season. Ties go to the younger band.
    """
    gender = races.gender_trend(view).filter((F.col("y") < this_year) & (F.col("known") >= least))
    share = _half_up(100 * F.col("f") / F.col("known"))
    women = gender.agg(F.count("*").alias("seasons"), F.min("y").alias("from_y"), F.max("y").alias("to_y"), F.min_by(share, "y").alias("from_pct"), F.max_by(share, "y").alias("to_pct"))
    women = women.filter("seasons > 1").select(F.lit("women").alias("what"), F.lit(None).cast("string").alias("band"), "from_y", "to_y", "from_pct", "to_pct")

    ages = races.age_trend(view).filter(F.col("y") < this_year)
    ends = ages.agg(F.min("y").alias("from_y"), F.max("y").alias("to_y")).filter("from_y < to_y")
    bands = ends.select("from_y", "to_y", F.posexplode(F.array(*map(F.lit, X.AGE_MIDDLE))).alias("at", "band"))
    at_end = lambda end: F.max(F.when(F.col("y") == F.col(end), F.col("pct")))
    shares = bands.join(ages, (F.col("ag") == F.col("band")) & F.col("y").isin(F.col("from_y"), F.col("to_y")), "left")
    shares = shares.groupBy("at", "band", "from_y", "to_y").agg(F.coalesce(at_end("from_y"), F.lit(0)).alias("from_pct"), F.coalesce(at_end("to_y"), F.lit(0)).alias("to_pct"))
    step, row = F.col("to_pct") - F.col("from_pct"), F.struct("band", "from_y", "to_y", "from_pct", "to_pct")
    best = {"age_up": -step, "age_down": step, "age_top": -F.col("to_pct")}
    one = shares.agg(F.array(*[F.struct(F.lit(what).alias("what"), F.min_by(row, F.struct(key, "at")).alias("r")) for what, key in best.items()]).alias("found"))
    told = one.select(F.explode("found").alias("x")).filter("x.r is not null").select("x.what", "x.r.*")
    return women.unionByName(told)

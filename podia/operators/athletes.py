"""Products by athlete: index, history, traits, fingerprints, climbs, course records, rivals, recaps and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podia.functions import measures as M
from podia.functions import text as X
from podia.operators import identity as I
from podia.operators.meetings import pairs

FEATURE_WEIGHTS = [1.0, 1.0, 0.8, 1.3, 0.5]
#: Columns that a history only shows.
HISTORY = {"race_name_canonical": "string", "category_raw": "string", "gender": "string", "team": "string", "finish_seconds": "double", "result_label": "string"}
AXES = ("climb", "flat", "tt", "overall", "age")


def trackable(keyed: DataFrame, least: int = I.MIN_RESULTS, by: tuple[str, ...] = ("gk",)) -> DataFrame:
    """The rows of identities with `least` results.

    Rows meet by identity once and are counted there; aggregates and windows by gk that follow need no shuffle.
    """
    rows = I.resolved(keyed).withColumn("__rows", F.count("*").over(Window.partitionBy(*by)))
    return rows.filter(F.col("__rows") >= least).drop("__rows")


def representative_team(keyed: DataFrame) -> DataFrame:
    """(gk, tm): the most recent real team, of equal years the last row's."""
    team = X.stripped(F.col("team"))
    real = keyed.withColumn("team", team).filter(~X.blank(F.col("team")) & ~F.col("team").isin(*I.NO_TEAM))
    return real.groupBy("gk").agg(F.max_by("team", F.struct(F.coalesce("year", F.lit(0)), "row_ord")).alias("tm"))


def index(keyed: DataFrame) -> DataFrame:
    """One row an athlete: how much they raced, when, how well, and how sure the identity is.

    One pass: rows meet by identity once; names are counted within it, and
    all columns are aggregates of the same rows.
    """
    different = lambda c: F.size(F.collect_set(c)).cast("long")  # noqa: E731 - of one athlete; count_distinct would shuffle all rows once more
    spelt = Window.partitionBy("gk", "name_masked")
    rows = trackable(keyed)
    rows = rows.withColumns({"__n": F.count("*").over(spelt), "__first": F.min("row_ord").over(spelt)})
    team = X.stripped(F.col("team"))
    real = ~X.blank(team) & ~team.isin(*I.NO_TEAM)
    name_length = F.length(F.regexp_replace(F.coalesce(F.min_by("name_raw", "row_ord"), F.lit("")), r"(?U)\s", ""))
    per = rows.groupBy("gk").agg(
        F.count("*").alias("n"),
        different(F.when(F.col("year") != 0, F.col("year"))).alias("ny"),
        different(F.coalesce("race_key", F.lit(""))).alias("nr"),
        F.min("year").alias("y0"),
        F.max("year").alias("y1"),
        F.min(F.when(F.col("rank_overall") > 0, F.col("rank_overall"))).alias("best"),
        different(F.when(~X.blank(F.col("team")), F.col("team"))).alias("teams"),
        different(F.when(F.col("gender").isin("M", "F"), F.col("gender"))).alias("genders"),
        name_length.alias("name_length"),
        F.min_by("name_masked", F.struct(-F.col("__n"), "__first")).alias("name_masked"),
        F.max_by(team, F.when(real, F.struct(F.coalesce("year", F.lit(0)), "row_ord"))).alias("tm"),
    )
    anchored = F.col("gk").rlike("^[tu]:")
    return per.select(
        I.athlete_id(F.col("gk")).alias("id"),
        F.col("name_masked").alias("nm"),
        "n", "ny", "nr", "y0", "y1", "best",
        I.confidence(anchored, F.col("teams"), F.col("name_length"), F.col("genders") > 1).alias("conf"),
        F.col("gk").startswith("u:").alias("uci"),
        F.col("gk").startswith("t:").alias("rid"),
        "tm",
    )


def history(keyed: DataFrame) -> DataFrame:
    """One row a result of a trackable athlete, with its place `seq` in the athlete's career; columns that keyed lacks are null.

    Rows are partitioned by id, so that what is made of a history by id needs no other shuffle.
    """
    told = keyed.select("*", *[F.lit(None).cast(t).alias(c) for c, t in HISTORY.items() if c not in keyed.columns])
    met = told.withColumn("id", I.athlete_id(F.col("gk"))).repartition("id")
    rows = I.with_field(trackable(met, by=("id", "gk")), I.field_sizes(keyed))
    order = Window.partitionBy("id", "gk").orderBy(F.coalesce("year", F.lit(0)), F.coalesce("date", F.lit("")), F.coalesce(F.when(F.col("rank_overall") > 0, F.col("rank_overall")), F.lit(9999)), "row_ord")
    return rows.select(
        "id", F.row_number().over(order).cast("long").alias("seq"), F.col("year").alias("y"), F.col("race_key").alias("rk"),
        F.col("race_name_canonical").alias("rn"), F.col("category_raw").alias("cat"), F.col("gender").alias("g"), "team",
        F.col("rank_overall").alias("rank"), F.col("finish_seconds").alias("t"), F.col("result_label").alias("label"), F.col("date").alias("d"), "field",
    )


def _with_discipline(keyed: DataFrame, rules) -> DataFrame:
    kind = X.discipline(F.col("race_name_raw"), F.col("category_raw"), rules)
    return I.with_field(trackable(keyed), I.field_sizes(keyed)).withColumn("discipline", kind)


def traits(keyed: DataFrame, rules=X.DISCIPLINES, least: int = 2) -> DataFrame:
    """(id, discipline, pct, n): each athlete's median percentage of the field beaten, by discipline."""
    per = _with_discipline(keyed, rules).filter("pct is not null").groupBy("gk", "discipline").agg(M.median(F.col("pct")).alias("pct"), F.count("*").alias("n"))
    return per.filter(F.col("n") >= least).select(I.athlete_id(F.col("gk")).alias("id"), "discipline", F.round("pct", 1).alias("pct"), "n")


def _common_age() -> Column:
    """The middle of the age band that most rows of a group have, ties by the first row that has it: an aggregate."""
    band = lambda b: F.col("age_band") == b
    each = [F.struct(F.count_if(band(b)).alias("n"), (-F.min(F.when(band(b), F.col("row_ord")))).alias("first"), F.lit(float(m)).alias("age")) for b, m in X.AGE_MIDDLE.items()]
    best = F.array_max(F.array(*each))
    return F.when(best["n"] > 0, best["age"])


def features(keyed: DataFrame, rules=X.DISCIPLINES, least: int = 2) -> DataFrame:
    """(id, g, climb, flat, tt, overall, age): each athlete's fingerprint, as z-scores within the gender.

    A missing discipline takes the overall score, a missing age the mean.
    """
    rows = _with_discipline(keyed, rules)
    ranked = F.col("pct").isNotNull()
    part = lambda cond: M.median(F.when(ranked & cond, F.col("pct")))
    d = F.col("discipline")
    per = rows.groupBy("gk").agg(
        part(F.lit(True)).alias("overall"), F.count_if(ranked).alias("n"),
        part(d == "climb").alias("climb"), part(d.isin("road", "crit")).alias("flat"), part(d == "tt").alias("tt"),
        I.more_often().alias("g"), _common_age().alias("age"),
    ).filter((F.col("n") >= least) & F.col("g").isNotNull())
    pool = per.groupBy("g").agg(*[f(a).alias(f"{n}_{a}") for a in AXES for f, n in ((F.avg, "mean"), (F.stddev_pop, "spread"))])

    def z(name: str) -> Column:
        score = F.when(F.col(f"spread_{name}") > 0, (F.col(name) - F.col(f"mean_{name}")) / F.col(f"spread_{name}")).otherwise(0.0)
        return F.when(F.col(name).isNotNull(), score)

    scored = per.join(F.broadcast(pool), "g").select("gk", "g", *[z(a).alias(a) for a in AXES])  # a row a gender
    filled = {a: F.round(F.coalesce(a, F.col("overall") if a != "age" else F.lit(0.0)), 2) for a in AXES}
    return scored.select(I.athlete_id(F.col("gk")).alias("id"), "g", *[c.alias(a) for a, c in filled.items()])


def doppelgangers(vectors: DataFrame, target: str, k: int = 6) -> DataFrame:
    """The k athletes of the target's gender whose fingerprints are nearest: (id, dist, sim from 0 to 100).

    The one target row is broadcast; the rest is one scan and a top-k.
    """
    me = vectors.filter(F.col("id") == target).limit(1).select("g", *[F.col(a).alias(f"my_{a}") for a in AXES])
    square = sum(F.lit(w) * F.pow(F.col(a) - F.col(f"my_{a}"), 2) for a, w in zip(AXES, FEATURE_WEIGHTS, strict=True))
    near = vectors.filter(F.col("id") != target).join(F.broadcast(me), "g").withColumn("dist", F.sqrt(square))
    return near.select("id", F.round("dist", 6).alias("dist"), F.round(100 * F.exp(-F.col("dist") / 2.5)).cast("long").alias("sim")).orderBy("dist", "id").limit(k)


def lean(climb: Column, flat: Column) -> Column:
    """Whether a fingerprint leans to climbs or flats."""
    return F.when(climb - flat > 0.5, "偏爬坡").when(climb - flat < -0.5, "偏平路").otherwise("全能")


def _ascents(keyed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Results on known climbs with a plausible ascent rate; profiles (race_key, elev_m, dist_km, grade, name, conf) is a curated table, small by nature."""
    profiles = profiles.withColumnsRenamed({"name": "climb_name", "conf": "climb_conf"})
    v = X.vam(F.col("elev_m"), F.col("finish_seconds"))
    rows = keyed.join(F.broadcast(profiles), "race_key").withColumn("vam", v).filter(F.col("vam").between(100, 3000))
    return rows.withColumn("wkg", X.watts_per_kilo(F.col("vam"), F.col("grade")))


def climb_vam(keyed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each athlete's best ascent rate over all known climbs: (id, nm, best_vam, best_wkg, climb, y, conf, g); climb and conf, how sure its figures are, come from profiles."""
    rows = trackable(keyed)
    best = _ascents(rows, profiles).groupBy("gk").agg(F.max_by(F.struct("vam", "wkg", F.col("climb_name").alias("climb"), "climb_conf", "year", "gender"), F.struct("vam", -F.col("row_ord"))).alias("b"))
    named = best.join(I.most_common(rows, "name_masked"), "gk", "left")
    return named.select(
        I.athlete_id(F.col("gk")).alias("id"), F.col("name_masked").alias("nm"), F.col("b.vam").cast("long").alias("best_vam"), F.col("b.wkg").alias("best_wkg"),
        F.col("b.climb").alias("climb"), F.col("b.year").alias("y"), F.col("b.climb_conf").alias("conf"), F.col("b.gender").alias("g"),
    )


def course_records(rows: DataFrame, profiles: DataFrame, top: int = 50) -> DataFrame:
    """The fastest ascents of each known climb, one for each athlete: (rk, rank, id, nm, t, vam, wkg, y, g, cat, link, n, name, dist_km, elev_m, grade).

    rows have no keys yet: only those on a climb get theirs row by row, the
    others are counted by name and ids first. An athlete's best is a partial
    aggregate, so that only as many rows as athletes are ranked; a climb's
    board keeps its first `top` before the sort.
    """
    climbs = rows.join(F.broadcast(profiles.select("race_key").distinct()), "race_key", "left_semi")
    ascents = _ascents(I.resolved(I.with_group_keys(climbs, seen=rows)), profiles)
    pick = F.min_by(F.struct("finish_seconds", "row_ord", "name_masked", "vam", "wkg", "year", "gender", X.filled(F.col("category_raw"), F.col("result_label")).alias("cat")), F.struct("finish_seconds", "row_ord"))
    best = ascents.groupBy("race_key", "gk").agg(pick.alias("b"))
    board = Window.partitionBy("race_key").orderBy("b.finish_seconds", "b.row_ord")
    ranked = best.withColumn("rank", F.row_number().over(board)).filter(F.col("rank") <= top)
    size = best.groupBy("race_key").agg(F.count("*").alias("n"))
    ranked = ranked.join(F.broadcast(size), "race_key")
    listed = F.broadcast(ranked.select("gk").distinct())  # `top` a climb
    alone = F.when(X.is_source_masked(F.col("name_raw")), F.col("row_ord")).alias("row_ord")  # rows with a hidden name have keys of their own
    counted = rows.groupBy("name_raw", "tsu_rider_id", "uci_id", alone).agg(F.count("*").alias("rows"))
    sizes = I.with_group_keys(counted, seen=rows).join(listed, "gk", "left_semi").groupBy("gk").agg(F.sum("rows").alias("rows"))
    out = ranked.join(F.broadcast(profiles), "race_key").join(F.broadcast(sizes), "gk", "left")
    return out.select(
        F.col("race_key").alias("rk"), F.col("rank").cast("long").alias("rank"), I.athlete_id(F.col("gk")).alias("id"), F.col("b.name_masked").alias("nm"),
        F.floor("b.finish_seconds").alias("t"), F.col("b.vam").cast("long").alias("vam"), F.col("b.wkg").alias("wkg"), F.col("b.year").alias("y"), F.col("b.gender").alias("g"),
        F.col("b.cat").alias("cat"), (F.col("rows") >= I.MIN_RESULTS).alias("link"), "n", "name", "dist_km", "elev_m", "grade",
    )


def gender_records(board: DataFrame, gender: str) -> DataFrame:
    """A board for one gender, ranked anew within it."""
    order = Window.partitionBy("rk").orderBy("rank")
    return board.filter(F.col("g") == gender).withColumn("rank", F.row_number().over(order).cast("long"))


def _active(keyed: DataFrame, least_results: int, who: Column) -> DataFrame:
    """(who, race, rank): the ranked rows of athletes who have enough of them; a race is a race-year."""
    ranked = I.resolved(keyed).filter(F.col("rank_overall") > 0)
    active = ranked.groupBy("gk").agg(F.count("*").alias("n")).filter(F.col("n") >= least_results).select("gk")
    return ranked.join(active, "gk", "left_semi").select(who.alias("who"), F.struct("race_key", "year").alias("race"), F.col("rank_overall").alias("rank"))


def ledger(keyed: DataFrame, least_results: int = 6, least_meets: int = 3) -> DataFrame:
    """(a, b, a_wins, meets) for pairs a < b of active athletes who met often enough in a race-year; equal ranks don't count."""
    return pairs(_active(keyed, least_results, F.col("gk")), least_meets)


def rivals(keyed: DataFrame, least_results: int = 6, least_meets: int = 3, top: int = 6) -> DataFrame:
    """(id, place, rival, w, l, meets): each athlete's most frequent opponents with wins and losses.

    Tasks give only rows that can be among an athlete's first, so that few are ranked here.
    """
    who = F.concat(I.athlete_id(F.col("gk")), F.lit(" "), "gk")  # in order of the id; ids of one length
    met = pairs(_active(keyed, least_results, who), least_meets, top)
    order = Window.partitionBy("a").orderBy(F.desc("meets"), F.desc("a_wins"), "b")
    ranked = met.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= top)
    id_ = lambda c: F.substring_index(c, " ", 1)
    return ranked.select(id_("a").alias("id"), "place", id_("b").alias("rival"), F.col("a_wins").alias("w"), (F.col("meets") - F.col("a_wins")).alias("l"), "meets")


def career(hist: DataFrame) -> DataFrame:
    """One row an athlete of a history: races, years, wins, podiums, best rank."""
    rank = F.when(F.col("rank") > 0, F.col("rank"))
    return hist.groupBy("id").agg(
        F.count("*").alias("races"), F.count_distinct("y").alias("years"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.count_if(rank == 1).alias("wins"), F.count_if(rank <= 3).alias("podiums"), F.min(rank).alias("best_rank"),
    )


def _whole_percent(rank: Column, field: Column) -> Column:
    return F.when((field >= 1) & (rank >= 1), F.floor((field - rank) / field * 100 + 0.5))


def progression(hist: DataFrame) -> DataFrame:
    """(id, y, pct, races, best_rank): each year's best percentage of a field beaten."""
    return hist.filter("y is not null").groupBy("id", "y").agg(
        F.max(_whole_percent(F.col("rank"), F.col("field"))).alias("pct"), F.count("*").alias("races"), F.min(F.when(F.col("rank") > 0, F.col("rank"))).alias("best_rank")
    )


def highlights(hist: DataFrame) -> DataFrame:
    """(id, best_rk, best_y, best_pct, latest_rk, latest_y, latest_pct): the best result (ties: the latest) and the latest ranked one."""
    ranked = hist.withColumn("p", _whole_percent(F.col("rank"), F.col("field"))).filter("p is not null")
    when = F.coalesce("d", F.concat(F.coalesce("y", F.lit(0)).cast("string"), F.lit("-00-00")))
    what = F.struct("rk", "y", "p")
    per = ranked.groupBy("id").agg(F.max_by(what, F.struct("p", when, -F.col("seq"))).alias("best"), F.max_by(what, F.struct(when, -F.col("seq"))).alias("latest"))
    return per.select("id", *[F.col(f"{w}.{c}").alias(f"{w}_{n}") for w in ("best", "latest") for c, n in (("rk", "rk"), ("y", "y"), ("p", "pct"))])


def season_recap(hist: DataFrame) -> DataFrame:
    """One row an athlete and year: races, median percentage, change on the year before, wins, podiums, busiest month.

    Months are counted in windows within an athlete's year and the year before is the row before, so that nothing is joined.
    """
    p = _whole_percent(F.col("rank"), F.col("field"))
    rows = hist.filter("y is not null").withColumn("p", p).withColumn("month", X.month_of(F.col("d")))
    monthly = Window.partitionBy("id", "y", "month")
    rows = rows.withColumns({"n": F.count("*").over(monthly), "first": F.min("seq").over(monthly)})
    per = rows.groupBy("id", "y").agg(
        F.count("*").alias("races"), F.floor(M.median(F.col("p")) + 0.5).alias("median_pct"), F.max("p").alias("best_pct"),
        F.count_if(F.col("rank") == 1).alias("wins"), F.count_if((F.col("rank") <= 3) & (F.col("rank") > 0)).alias("podiums"),
        F.min_by("month", F.when(F.col("month").isNotNull(), F.struct(-F.col("n"), "first"))).cast("long").alias("busiest_month"),
    )
    years = Window.partitionBy("id").orderBy("y")
    last = F.when(F.lag("y").over(years) == F.col("y") - 1, F.lag("median_pct").over(years))
    return per.withColumn("delta", F.col("median_pct") - last)


def compare(hist: DataFrame, a: str, b: str) -> DataFrame:
    """The race-years that both athletes rode, each with their better row: (rk, y, a_rank, b_rank, winner)."""
    own = hist.filter(F.col("id").isin(a, b) & F.col("y").isNotNull())
    best = own.groupBy("id", "rk", "y").agg(F.min(F.when(F.col("rank") > 0, F.col("rank"))).alias("rank"))
    both = best.groupBy("rk", "y").agg(
        F.max(F.when(F.col("id") == a, F.col("rank"))).alias("a_rank"), F.max(F.when(F.col("id") == b, F.col("rank"))).alias("b_rank"), F.count_distinct("id").alias("who")
    )
    winner = F.when(F.col("a_rank") < F.col("b_rank"), "a").when(F.col("b_rank") < F.col("a_rank"), "b").otherwise("tie")
    return both.filter("who = 2").select("rk", "y", "a_rank", "b_rank", winner.alias("winner"))


def search(athletes: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Athletes whose visible name has the query's characters, or whose id begins with it; the most raced first."""
    form = "".join(query.replace(X.MASK, "").split()).lower()
    by_id = len(form) >= 4 and all(c in "0123456789abcdef" for c in form)
    cond = X.search_form(F.col("nm")).contains(form) | (F.col("id").startswith(form) & F.lit(by_id))
    pool = athletes.filter(cond) if query.strip() else athletes
    return pool.orderBy(F.desc("n"), F.desc("ny"), F.coalesce("best", F.lit(9999)), "id").limit(limit)

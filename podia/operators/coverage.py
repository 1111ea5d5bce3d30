"""What is missing: calendar races without results, keys that may be one race, and the season board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from podia.functions import text as X

# Words that tell editions apart, not events; sub-event marks; marks of events that must stay apart.
FILLER = [
    "中華民國", "自行車", "自由車", "單車", "腳踏車", "公路車", "挑戰賽", "挑戰", "錦標賽", "邀請賽", "大賽", "系列賽", "系列活動", "系列",
    "比賽", "賽事", "活動", "成績總表", "成績紀錄", "成績", "總表", "大會師", "暨", "之", "盃", "杯", "屆",
]
SUB_EVENT = r"(?i)Day\s?\d+|Stage\s?\d+|S\d+|Round\s?\d+|第?\d+站|[冬春夏秋]季|季|[一二三四五六七八九十\d]+月|場次|[上下]午|[東西南北中]部段|.段|Heroes|KOM|挑戰組|競賽組|市民組|巿民組|分齡組"
APART = r"(?i)Day\s?\d|[冬春夏秋]季|[東西南北中]部段|場次|六月|九月"
# How a gap's status shows on the season board.
BOARD = {"NOT_INGESTED": "wait", "HELD_UNCHECKED": "wait", "BLOCKED": "miss", "NOT_HELD": "soon"}


def safe_core(name: Column) -> Column:
    """A race's name without edition, Latin tail, filler and separators."""
    s = F.coalesce(name, F.lit(""))
    for pattern in (r"20[0-2]\d", r"^1\d\d年", r"第?\d+[屆回]", "[A-Za-z]+", "|".join(sorted(FILLER, key=len, reverse=True)), r"(?U)[\s．.、&·,／/\-‑—_()（）「」『』【】\[\]:：!！]"):
        s = F.regexp_replace(s, pattern, "")
    return F.replace(s, F.lit("巿"), F.lit("市"))


def loose_core(name: Column) -> Column:
    return F.regexp_replace(safe_core(F.regexp_replace(F.coalesce(name, F.lit("")), SUB_EVENT, "")), r"\d+", "")


def merge_candidates(rows: DataFrame) -> DataFrame:
    """(loose, verdict, safe_cores, members, total_rows): race keys that look like one race, for review.

    SAFE if the names differ in nothing but editions, REJECT if they differ and
    a mark says that they are apart, else REVIEW. members are (rk, name, rows, years), those with
    most rows first; safe_cores what is left of their names. A cluster holds the keys of one
    event, which are few.
    """
    years = F.sort_array(F.collect_set(F.when(F.col("year") != 0, F.col("year"))))
    keys = rows.filter(~X.blank(F.col("race_key"))).groupBy("race_key").agg(F.count("*").alias("rows"), F.min_by(X.filled(F.col("race_name_canonical"), F.col("race_key")), "row_ord").alias("name"), years.alias("years"))
    cores = keys.select("race_key", "rows", "name", "years", safe_core(F.col("name")).alias("safe"), loose_core(F.col("name")).alias("loose"), F.col("name").rlike(APART).alias("apart")).filter("loose <> ''")
    member = F.struct((-F.col("rows")).alias("less"), F.col("race_key").alias("rk"), "name", "rows", "years")
    per = cores.groupBy("loose").agg(F.sort_array(F.collect_set("safe")).alias("safe_cores"), F.max("apart").alias("apart"), F.sum("rows").alias("total_rows"), F.sort_array(F.collect_list(member)).alias("all")).filter(F.size("all") >= 2)
    verdict = F.when((F.size("safe_cores") > 1) & F.col("apart"), "REJECT").when(F.size("safe_cores") == 1, "SAFE").otherwise("REVIEW")
    return per.select("loose", verdict.alias("verdict"), "safe_cores", F.transform("all", lambda x: x.dropFields("less")).alias("members"), "total_rows")


# Parts of a calendar's names that tell distance, season, edition or stage, and digits of years.
NOISE = r"(?U)\d+(?:\.\d+)?\s*K\w*|春季|夏季|秋季|冬季|第[\w一二三四五六七八九十]{1,3}屆|第[\w一二三四五六七八九十]{1,3}站|Stage\s*\d+|年度系列|報名連結|&\w+;|挑戰組|經典組"
YEAR_DIGITS = r"[\s023456]"


def core(name: Column) -> Column:
    """The characters by which a calendar race and a known race are compared."""
    bare = F.regexp_replace(F.coalesce(name, F.lit("")), NOISE, "")
    return F.regexp_replace(X.filled(X.race_key(bare), bare), YEAR_DIGITS, "")


def overlap(a: Column, b: Column) -> Column:
    """The share of the smaller set of characters that both texts have; 1 if one contains the other."""
    chars = lambda c: F.array_distinct(F.split(c, ""))
    shared = F.size(F.array_intersect(chars(a), chars(b))) / F.least(F.size(chars(a)), F.size(chars(b)))
    return F.when((a == "") | (b == ""), 0.0).when(a.contains(b) | b.contains(a), 1.0).otherwise(shared)


def overlapping(a: DataFrame, b: DataFrame, least: float, on: list[str] | None = None) -> DataFrame:
    """(c, k, s): the pairs of a's names c and b's names k, of equal `on`, whose overlap s is at least `least`.

    Of two names the one with fewer different characters must share ceil(least *
    its characters) of them, so one of its rarest ones, as many as may be
    missing and one more, stands in the other. Names meet by these characters
    only: what most names hold is seldom among a name's rarest, and then only in names
    that have nothing else. A name within another shares all, so its rarest
    character finds it. The table of how often characters occur has a row a
    character and is broadcast: an alphabet, whatever the names.
    """
    on = on or []

    def letters(df: DataFrame, name: str) -> DataFrame:
        names = df.select(*on, F.col(name).alias("name")).filter("name <> ''").distinct()
        chars = F.filter(F.array_distinct(F.split("name", "")), lambda x: x != "")
        return names.select(*on, "name", F.size(chars).alias("size"), F.explode(chars).alias("x"))

    left, right = letters(a, "c"), letters(b, "k")
    often = F.broadcast(left.select("x").unionByName(right.select("x")).groupBy("x").agg(F.count("*").alias("often")))

    def rarest(df: DataFrame) -> DataFrame:
        sorted_ = df.join(often, "x").groupBy(*on, "name", "size").agg(F.sort_array(F.collect_list(F.struct("often", "x"))).alias("chars"))
        spare = F.col("size") - F.ceil(least * F.col("size") - 1e-9) + 1
        return sorted_.select(*on, "name", "size", F.explode(F.slice("chars", 1, spare.cast("int"))).alias("char")).select(*on, "name", "size", "char.x")

    def meet(small: DataFrame, large: DataFrame, strictly: bool) -> DataFrame:
        few, many = small.withColumnsRenamed({"name": "s", "size": "n"}), large.withColumnsRenamed({"name": "l", "size": "m"})
        return few.join(many, [*on, "x"]).filter("n < m" if strictly else "n <= m").select(*on, "s", "l")

    pairs = meet(rarest(left), right, False).withColumnsRenamed({"s": "c", "l": "k"}).unionByName(meet(rarest(right), left, True).withColumnsRenamed({"s": "k", "l": "c"}))
    return pairs.distinct().withColumn("s", overlap(F.col("c"), F.col("k"))).filter(F.col("s") >= least)


def gaps(calendar: DataFrame, rows: DataFrame, today: str, least: float = 0.6) -> DataFrame:
    """(race, date, best, years_known, status): calendar races that the results lack.

    A race is known if some race's name overlaps with it in `least` of its
    characters, and has the years of those names that overlap most; a known race that was held but has no results of
    its date's year is NOT_INGESTED. Of calendar races with the same characters the first by date stands
    for all. years_known counts the years.
    """
    cal = calendar.select(F.struct("date", "race").alias("first"), core(F.col("race")).alias("c")).filter("c <> ''").groupBy("c").agg(F.min("first").alias("first")).select("c", "first.*")
    known = rows.filter(~X.blank(F.col("race_name_canonical"))).groupBy(core(F.col("race_name_canonical")).alias("k")).agg(F.collect_set("year").alias("years")).filter("k <> ''")
    scored = overlapping(cal, known, least).join(known, "k")
    best = scored.groupBy("c").agg(F.max("s").alias("best"))
    near = scored.join(best, "c").filter("s = best").groupBy("c", "best").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("years")))).alias("years_known"))
    met = cal.join(near, "c", "left")
    held = (F.col("date") < today) & ~F.array_contains("years_known", F.substring("date", 1, 4).cast("long"))
    status = F.when(F.col("best").isNull(), "UNKNOWN").when(held, "NOT_INGESTED")
    return met.withColumn("status", status).filter("status is not null").select("race", "date", F.round("best", 6).alias("best"), F.size("years_known").cast("long").alias("years_known"), "status")


def triage(name: Column, verdicts: list[tuple[str, str, str]]) -> Column:
    """(status, note) of the first hand-kept verdict (part of a name, status, note) that the name holds; null if none does."""
    met = [F.when(name.contains(part), F.struct(F.lit(status).alias("status"), F.lit(note).alias("note"))) for part, status, note in verdicts]
    return F.coalesce(*met, F.lit(None).cast("struct<status:string,note:string>"))


def triaged(gaps_: DataFrame, verdicts: list[tuple[str, str, str]]) -> DataFrame:
    """gaps() with a note, where verdicts beat computed statuses; what is no gap by its verdict goes."""
    said = gaps_.withColumn("verdict", triage(F.col("race"), verdicts))
    kept = F.col("verdict.status").isNull() | ~((F.col("verdict.status") == "COLLECTED") | ((F.col("status") == "NOT_INGESTED") & (F.col("verdict.status") == "NO_RANKING")))
    return said.filter(kept).select(*[c for c in gaps_.columns if c != "status"], F.coalesce("verdict.status", "status").alias("status"), F.col("verdict.note").alias("note"))


def known_races(known: DataFrame, rows: DataFrame, seen: DataFrame, this_year: int) -> DataFrame:
    """known (race, year, status, ...) with `done`: the hand-kept list of races held against the results.

    A race of a year is done if that year has results of a race whose name
    holds it or is held by it, unless it is EXCLUDED. Races of this year whose
    core is in seen (c) are left to the calendar, unless they are done. Names meet by the year
    and the rarest character of the shorter one, each name once.
    """
    own = core(F.col("race"))
    have = rows.filter("year is not null").select(F.col("year").alias("had"), core(F.col("race_name_canonical")).alias("k")).filter("k <> ''").distinct()
    asked = known.filter("year is not null and status <> 'EXCLUDED'").select("year", own.alias("c")).distinct()
    pairs = overlapping(asked, have.withColumnRenamed("had", "year"), 1.0, ["year"]).filter(F.col("c").contains(F.col("k")) | F.col("k").contains(F.col("c")))
    done = pairs.select(F.col("year").alias("y"), F.col("c").alias("d"), F.lit(True).alias("met")).distinct()
    held = known.withColumn("core", own).join(done, (F.col("year") == F.col("y")) & (F.col("core") == F.col("d")) & (F.col("status") != "EXCLUDED"), "left").withColumn("done", F.coalesce("met", F.lit(False)))
    told = held.join(seen.select(F.col("c").alias("s"), F.lit(True).alias("listed")).distinct(), F.col("core") == F.col("s"), "left")
    left = F.coalesce(F.col("listed") & (F.col("year") == this_year), F.lit(False)) & ~F.col("done")
    return told.filter(~left).select(*known.columns, "done")


def carry_forward(before: DataFrame, failed: list[str], verdicts: list[tuple[str, str, str]]) -> DataFrame:
    """The gaps of the last run for calendars that failed now, marked stale; their statuses are those of the verdicts alone."""
    old = before.filter(F.col("calendar").isin(*failed)).withColumn("verdict", triage(F.col("race"), verdicts))
    kept = old.filter(F.col("verdict.status").isNull() | (F.col("verdict.status") != "COLLECTED"))
    others = [c for c in before.columns if c not in ("status", "note", "stale")]
    return kept.select(*others, F.col("verdict.status").alias("status"), F.col("verdict.note").alias("note"), F.lit(True).alias("stale"))


def season_board(races: DataFrame, gaps_: DataFrame, year: int, today: str) -> DataFrame:
    """(name, date, status, rows): a year's races with results, and those that are awaited, missed or still to come."""
    board = F.create_map(*[F.lit(x) for pair in BOARD.items() for x in pair])
    day = r"^\d{4}-\d{2}-\d{2}$"
    have = races.filter(F.col("y") == year).select(F.col("rn").alias("name"), F.when(F.col("d").rlike(day), F.col("d")).alias("date"), F.lit("ok").alias("status"), "rows")
    status = F.try_element_at(board, F.col("status"))
    want = gaps_.filter(F.col("date").rlike(day) & (F.substring("date", 1, 4) == str(year))).withColumn("s", status).filter("s is not null")
    late = F.when((F.col("s") == "soon") & (F.col("date") < today), "wait").when((F.col("s") == "wait") & (F.col("date") >= today), "soon").otherwise(F.col("s"))
    return have.unionByName(want.select(F.col("race").alias("name"), "date", late.alias("status"), F.lit(None).cast("long").alias("rows")))

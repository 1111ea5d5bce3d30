"""Result books: rows of riders read from lines of text whose layout changes from book to book and page to page."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podia.functions.text import let
from podia.operators.normalise import make_records

# The words and forms by which pages and lines are told, as the published books have them.
HEADER_LINES, TITLE_LINES, MARK_LINES = 14, 5, 6
HEADER = ["名次|Rank|排名", "姓名|Name"]
RANK_FIRST = "^(名次|排名|Rank)"
TEAM_HEADER = "團隊排名|Team *欄"
TEAM_EVENT = "團隊|團計|團體"
SKIPPED_PAGE = "總成績|成績總表|出發名單|出賽名單|團體成績|團隊積分|團隊計時|團計|積分賽排名|Team *欄1|成績總和|計時賽成績|Intermediate|出發序|[(（]選拔[)）]"
EARLIER_TIMES = ["出發時間", "抵達時間", "終點時間", "開始", "出發檢查", "檢查一", "檢查二"]
TITLE = "^.*?(錦標賽|選拔賽|排名賽|錦賽)"
CATEGORY = [
    r"[男女]子(?:U23|[^\d/（(：:公]){0,8}?組", r"[男女]生\d+歲", "(?:小|國|高)[一二三四五六中]?[男女]生組", "國小[一二三四五六]?[男女](?:子組)?",
    r"[男女]子\d+歲組", "國小[男女]生組", "[男女]子(?:U23|菁英|青年|少年)",
]
CATEGORY_FIELD = r"組別(\S{2,6}?)(?:日期|$)"
EVENT = r"\d+(?:\.\d+)?(?:公里|km|K)[^\d：:公告]{0,8}?(?:計時賽?|公路賽|繞圈賽|公路計時)"
STAGE, STAGE_KM = r"Stage(\d+)", r"距離(\d+(?:\.\d+)?)km"
NAME = "[一-鿿]{2,4}"
STATUSES = ["DNF", "DNS", "OTL", "DSQ", "DQ", "LAP"]
CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:\.\d{1,3})?(?![.\d]*\d{5})(?!\.)"
STAGE_TIME = r"(?:(\d+)h *)?(\d{1,2})m *(\d{1,2}(?:\.\d+)?)s"
LICENCE = r"^((?:\d{3} ?){3}\d{2}|\d{9,11}|R\d{6}|TPE\d{8}|[-x0])(?= |$|[^\d]) *(.*)$"
LATIN_NAME = r"^[A-Z][A-Za-z\-']+(?: +[A-Z][a-z\-']+)+ *(\d{9,11})? *(.*)$"
NOT_TEAM = [
    r"^[男女]子\S{0,6}組 +", " +(個人計時賽|個人公路賽|公路賽|計時賽)$", r"^ +| +$", r"^[A-Z]{2,} +\d{1,2}:\d{2}\.\S* *", r"^\d{1,2}:\d{2}\.\d\.? *",
    r"\bR\d{7}\b|\d{9,11}", CLOCK, r"\b(?:" + "|".join(STATUSES) + r")\b",
]

#: What ends a team's text; and any of the texts that are taken out of it: without one it stays as it is.
_LAST_NUMBER, _LAST_PLACE, _EDGES = r" (\d{9,11})$", r" +\d{1,2}$", "^[ -]+|[ -]+$"
_ANY_NOT_TEAM = "|".join(f"(?:{p})" for p in [_LAST_NUMBER, *NOT_TEAM, "  ", _LAST_PLACE, _EDGES])
#: A run of white space that isn't one blank.
_UNEVEN = r"[\t\n\x0B\f\r\x{00a0}\x{3000}]|  "

_STATUS = "(?i:" + "|".join(STATUSES) + ")"
_ROW = rf"^(?:(\d+|{_STATUS}) )?([A-Za-z]?\d{{1,4}}) ({NAME})(?: (.*))?$"
_FIELDS = "category, event, gender, rank, bib, name, uci_id, team, finish_time, finish_seconds, status"


def _or_null(text: Column) -> Column:
    return F.when(text != "", text)


def _first_of(text: Column, patterns: list[str], group: int = 0) -> Column:
    """What the first pattern that is found at all finds; null if none is."""
    return F.coalesce(*[_or_null(F.regexp_extract(text, p, group)) for p in patterns])


def _pages(lines: DataFrame) -> DataFrame:
    """(at, state): what holds on each page, from its own first lines or carried on from earlier pages.

    A page with a header starts a table; a page to be skipped, or the header of
    a table of teams, ends it. Category, event and gender come from the last
    page that names a category.
    """
    # No filter on place: below the shuffle it would make another one, and the lines anew, beside that of all lines.
    first = F.when(F.col("place") <= HEADER_LINES, F.struct("place", "text"))
    top = lines.groupBy("at").agg(F.array_sort(F.collect_list(first)).alias("top"))
    texts = F.transform("top", lambda x: x["text"])
    pages = top.select("at", F.array_join(F.slice(texts, 1, MARK_LINES), "\n").alias("marks"), F.regexp_replace(F.array_join(F.slice(texts, 1, TITLE_LINES), ""), " ", "").alias("title"), F.get(F.filter(texts, lambda x: reduce(lambda a, b: a & b, [x.rlike(p) for p in HEADER])), 0).alias("header"))
    untitled = F.regexp_replace("title", TITLE, "")
    pages = pages.select("at", "header", F.col("marks").rlike(SKIPPED_PAGE).alias("skipped"), F.coalesce(_or_null(untitled), "title").alias("title"))
    stage, km = (_first_of(F.col("title"), [p], 1) for p in (STAGE, STAGE_KM))
    event = F.coalesce(
        F.concat(F.lit("Stage "), stage, F.coalesce(F.concat(F.lit(" "), km, F.lit("km")), F.lit(""))),
        _first_of(F.col("title"), [EVENT]),
        F.when(F.col("title").contains("計時"), "個人計時賽").when(F.col("title").contains("公路"), "個人公路賽"),
    )
    category = F.coalesce(_first_of(F.col("title"), CATEGORY), _first_of(F.col("title"), [CATEGORY_FIELD], 1))
    before = F.when(F.col("header").contains("成績"), F.split("header", "成績")[0]).otherwise("")
    times = reduce(lambda a, b: a + b, [before.contains(c).cast("int") for c in EARLIER_TIMES])
    known = ~F.col("skipped")
    table = F.struct((~F.col("header").rlike(TEAM_HEADER)).alias("open"), times.alias("before"), F.col("header").rlike(RANK_FIRST).alias("rank_first"))
    none = F.struct(F.lit(False).alias("open"), F.lit(0).alias("before"), F.lit(True).alias("rank_first"))
    pages = pages.withColumn("category", F.when(known, category)).withColumn("event", F.when(known & F.col("category").isNotNull(), event)).withColumn("table", F.when(~known, none).when(F.col("header").isNotNull(), table))
    so_far = Window.partitionBy("at.book").orderBy("at.page")
    carried = [F.last(c, ignorenulls=True).over(so_far).alias(c) for c in ("table", "category", "event")]
    return pages.select("at", "skipped", *carried).withColumn("of_teams", F.col("event").rlike(TEAM_EVENT))


def _rejoined(lines: DataFrame) -> DataFrame:
    """Lines in which a number on its own is put behind the rank that starts the next line, and `;` between digits is a colon.

    `at` is the line's book and page as one key, in which nulls are equal: windows, groups and joins by it share one shuffle.
    """
    page = Window.partitionBy("at").orderBy("line")
    given = F.coalesce("text", F.lit(""))
    even = F.trim(F.when(given.rlike(_UNEVEN), F.regexp_replace(given, r"[\s\x{00a0}\x{3000}]+", " ")).otherwise(given))
    tidy = F.when(given.contains(";"), F.regexp_replace(even, r"(\d);(\d)", "$1:$2")).otherwise(even)
    lines = lines.select(F.struct("book", "page").alias("at"), "line", tidy.alias("text"))
    lines = lines.withColumns({"place": F.row_number().over(page), "next": F.lead("text").over(page), "back": F.lag("text").over(page)})
    ranked = rf"^(\d{{1,3}}) ({NAME} .*)$"
    alone = lambda c: (F.length(c) <= 5) & F.col(c).rlike(r"^\d{1,4}$")  # noqa: E731 - a line's end may follow the digits
    joins = F.coalesce(alone("text") & F.col("next").rlike(ranked), F.lit(False))
    used = F.coalesce(alone("back") & F.col("text").rlike(ranked), F.lit(False))
    both = F.concat(F.regexp_extract("next", ranked, 1), F.lit(" "), "text", F.lit(" "), F.regexp_extract("next", ranked, 2))
    return lines.withColumn("used", used).withColumn("row", F.when(joins, both).otherwise(F.col("text")))


def _clock(text: Column) -> Column:
    """Seconds of h:mm:ss or mm:ss, with decimals."""
    part = F.split(text, ":")
    n = [F.try_element_at(part, F.lit(i)).cast("double") for i in (1, 2, 3)]
    return F.when(F.size(part) == 3, n[0] * 3600 + n[1] * 60 + n[2]).otherwise(n[0] * 60 + n[1])


def _as_time(seconds: Column, text: Column) -> Column:
    """hh:mm:ss with the decimals that text has."""
    whole = F.floor(seconds).cast("int")
    decimals = F.when(text.contains("."), F.regexp_extract(text, r"\.(\d+)$", 1)).otherwise("")
    two = lambda n: F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))
    clock = F.concat_ws(":", two(F.floor(whole / 3600)), two(F.floor(whole % 3600 / 60)), two(whole % 60))
    return F.concat(clock, F.when(decimals != "", F.concat(F.lit("."), decimals)).otherwise(""))


def _team(left: Column) -> Column:
    """A team's text without what stands around it."""
    team = reduce(lambda t, p: F.regexp_replace(t, p, " " if p in NOT_TEAM[5:] else ""), NOT_TEAM, F.regexp_replace(left, _LAST_NUMBER, ""))
    team = F.regexp_replace(F.trim(F.regexp_replace(team, " +", " ")), _LAST_PLACE, "")
    return F.regexp_replace(team, _EDGES, "")


def _read(rows: DataFrame) -> DataFrame:
    """rows (row, table) with what their text says of a rider, from both ends: the name's place from the left, times from the right."""
    parts = F.split(F.regexp_replace("row", _ROW, "$1\u0001$2\u0001$3\u0001$4"), "\u0001")
    rows = rows.withColumn("parts", F.when(F.col("row").rlike(_ROW), parts))
    rows = rows.withColumns({"lead": _or_null(F.col("parts")[0]), "bib": F.col("parts")[1], "name": F.col("parts")[2], "rest": F.col("parts")[3]})
    upper = F.upper("rest")
    told = F.filter(F.split(upper, " "), lambda x: x.isin(STATUSES))
    told = F.when(reduce(or_, [upper.contains(x) for x in STATUSES]), F.try_element_at(told, F.lit(-1)))
    status = F.coalesce(told, F.when(F.upper("lead").isin(STATUSES), F.upper("lead")))
    rows = rows.withColumns({"status": status, "times": F.regexp_extract_all("rest", F.lit(CLOCK), F.lit(0)), "between": F.split("rest", CLOCK), "staged": F.col("rest").contains("m") & F.col("rest").contains("s") & F.col("rest").rlike(STAGE_TIME)})
    before = F.col("table.before")
    clock = F.get("times", before)
    hours, minutes, seconds = (_or_null(F.regexp_extract("rest", STAGE_TIME, i)) for i in (1, 2, 3))
    stage = F.concat(F.coalesce(hours, F.lit("0")), F.lit(":"), minutes, F.lit(":"), seconds)
    rows = rows.withColumn("clock", F.when(F.col("staged"), stage).otherwise(clock)).withColumn("seconds", F.round(_clock(F.col("clock")), 3))
    timed = F.col("status").isNull() & (F.col("seconds") > 0)
    behind = F.get(F.split(F.trim(F.get("between", before + 1)), " "), 0)
    lead = F.when(F.col("lead").rlike(r"^\d+$"), F.col("lead"))
    trailing = F.when(F.col("status").isNull() & ~F.col("staged") & (F.size("times") > before) & behind.rlike(r"^\d+$"), behind)
    cut = F.when(F.col("staged") & (F.size("times") == 0), F.split("rest", STAGE_TIME, 2)[0]).when(F.col("staged") | (F.size("times") > before), F.get("between", F.lit(0))).otherwise(F.col("rest"))
    rows = rows.withColumns({"finish_seconds": F.when(timed, F.col("seconds")), "finish_time": F.when(timed, _as_time(F.col("seconds"), F.col("clock"))), "rank": F.coalesce(lead, trailing).cast("long"), "middle": F.trim(cut)})
    licensed, latin = F.col("middle").rlike(LICENCE), F.col("middle").rlike(LATIN_NAME)
    number = F.when(licensed, F.regexp_replace(F.regexp_extract("middle", LICENCE, 1), " ", "")).when(latin, F.regexp_extract("middle", LATIN_NAME, 1))
    left = F.when(licensed, F.regexp_extract("middle", LICENCE, 2)).when(latin, F.regexp_extract("middle", LATIN_NAME, 2)).otherwise(F.col("middle"))
    rows = rows.withColumns({"number": F.when(number.rlike(r"^\d{9,11}$"), number), "left": left})
    ending = F.when(F.col("left").contains(" "), _first_of(F.col("left"), [_LAST_NUMBER], 1))
    rows = rows.withColumn("uci_id", F.coalesce("number", ending))
    return rows.withColumn("team", _or_null(F.when(F.col("left").rlike(_ANY_NOT_TEAM), let(F.col("left"), _team)).otherwise(F.col("left"))))


def read_lines(lines: DataFrame, fields: str = _FIELDS) -> DataFrame:
    """Every line of lines (book, page, line, text) with what was read of it: category, event, gender, rank, bib,
    name, uci_id, team, finish_time, finish_seconds, status (or the named ones of these); and `refused`, why it is no row of a rider, or null.

    Books are text lines of printed result lists. A page's first lines may name
    category and event and hold a header; both carry over to following pages.
    The header says how many clock times stand before the result. A rider's row has a rank or a status and a
    number, or a number alone, then a name of two to four characters, and from there team, licence and
    times. A number alone on its line belongs to the next one, and is `joined` then.

    Pages of a book meet in a window, lines of a page in another, for which lines
    are shuffled once; nothing else hangs on an order. A null text is an empty line; a null book or page is a
    book or page like any other; repeated lines are read each. An empty table gives an
    empty result; other columns are ignored.
    """
    lines = _rejoined(lines)
    met = lines.join(_pages(lines), "at", "left")
    none = F.struct(F.lit(False).alias("open"), F.lit(0).alias("before"), F.lit(True).alias("rank_first"))
    met = _read(met.withColumn("table", F.coalesce("table", none)))
    no_result = F.col("finish_time").isNull() & F.col("status").isNull()
    few = F.col("lead").isNull() & (F.col("rest") == "")
    refused = (
        F.when(F.col("skipped"), "page skipped")
        .when(~F.col("table.open"), "no table")
        .when(F.col("of_teams"), "team event")
        .when(F.col("used"), "joined")
        .when(F.col("parts").isNull() | few, "no rider")
        .when(F.col("lead").isNull() & F.col("table.rank_first") & F.col("status").isNull(), "no rank")
        .when(no_result, "no result")
    )
    gender = F.when(F.col("category").contains("女"), "F").when(F.col("category").contains("男"), "M")
    read = met.withColumn("gender", gender).withColumn("refused", refused)
    taken = [F.when(F.col("refused").isNull(), F.col(c)).alias(c) for c in fields.split(", ") if c]
    # As one generated row: a filter on `refused` would else go below, and read each line some hundred times.
    one = F.array(F.struct("at.book", "at.page", "line", "text", *taken, "refused"))
    return read.select(F.inline(one))


def book_rows(lines: DataFrame) -> DataFrame:
    """The riders' rows of books; of a rider's rows in one category and event of a book the first stays."""
    rows = read_lines(lines).filter("refused is null").drop("refused", "text")
    key = ["book", "category", "event", "bib", "name"]
    others = [c for c in rows.columns if c not in key]
    first = rows.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct("page", "line")).alias("first"))
    return first.select(*key, "first.*")


def refused_lines(lines: DataFrame) -> DataFrame:
    """(book, page, line, text, refused): what read_lines couldn't take as a row, with the reason, for review."""
    return read_lines(lines, "").filter("refused is not null and refused <> 'joined'").select("book", "page", "line", "text", "refused")


def book_records(lines: DataFrame) -> DataFrame:
    """book_rows() as records: the book is the race's name, the event its label."""
    rows = book_rows(lines)
    return make_records(rows.select(F.col("book").cast("string").alias("race_name_raw"), F.col("category").alias("category_raw"), F.col("event").alias("result_label"), "gender", F.col("rank").alias("rank_overall"), "bib", F.col("name").alias("name_raw"), "uci_id", "team", "finish_time", "finish_seconds", "status", F.lit("text").alias("source_format")))

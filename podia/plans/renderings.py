"""The warehouse tables' rows as the texts and pages that sources publish, to be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS, FAMILY_NAMES = "0123456789", "王李張陳林黃吳劉蔡楊"
SECTIONS = [("F", "女子菁英組"), ("M", "男子青年組"), (None, "男子大師組")]
#: Headers by layout: rank first; start and arrival before the result; numbers on lines of their own; number first.
HEADERS = ["名次 比賽號碼 姓名 參賽證號 隊名 成績", "名次 比賽號碼 姓名 隊名 出發時間 終點時間 成績 時速", "名次 比賽號碼 姓名 隊名 成績", "號碼 姓名 隊名 成績 名次"]
PAGE_ROWS, SECTION_PAGES = 30, 1_000_000


def entrants(rows: DataFrame) -> DataFrame:
    """Result rows as entrants of books: a book is a race-year, a section a gender, n the place on its list."""
    section = F.when(F.col("gender") == "F", 0).when(F.col("gender") == "M", 1).otherwise(2)
    rows = rows.select(F.concat_ws(" ", "race_key", F.col("year").cast("string")).alias("book"), F.col("year").cast("int").alias("year"), section.alias("section"), "finish_seconds", "status", "row_ord")
    n = F.row_number().over(Window.partitionBy("book", "section").orderBy(F.asc_nulls_last("finish_seconds"), "row_ord"))
    name = F.translate(F.lpad((F.col("row_ord") % 10000).cast("string"), 4, "0"), DIGITS, FAMILY_NAMES)
    team = F.when(F.col("row_ord") % 11 == 0, "-").otherwise(F.concat(F.lit("車隊"), (F.col("row_ord") % 60).cast("string")))
    licence = F.concat(F.lit("1000"), F.lpad((F.col("row_ord") % 1_000_000).cast("string"), 6, "0"))
    return rows.withColumn("n", n).select("book", "year", "section", "n", (F.col("n") % 10000).cast("string").alias("bib"), name.alias("name"), team.alias("team"), licence.alias("licence"), F.col("finish_seconds").cast("int").alias("seconds"), "status")


def result_books(rows: DataFrame) -> DataFrame:
    """(book, page, line, text): results as printed lists; the layout changes with the year, and every section ends with a summary page."""
    e = entrants(rows).withColumn("layout", F.col("year") % 4)
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    clock = F.concat_ws(":", F.floor(F.col("seconds") / 3600).cast("string"), two(F.floor(F.col("seconds") % 3600 / 60)), two(F.col("seconds") % 60))
    n, bib = F.col("n").cast("string"), F.col("bib")
    said = F.when(F.col("seconds").isNull(), F.array(F.concat_ws(" ", "status", bib, "name", "team")))
    said = said.when(F.col("layout") == 1, F.array(F.concat_ws(" ", n, bib, "name", "team", F.lit("08:00:00 20:00:00"), clock, F.lit("39.95"))))
    said = said.when((F.col("layout") == 2) & (F.col("n") < 1000), F.array(bib, F.concat_ws(" ", n, "name", "team", clock)))
    said = said.when(F.col("layout") == 3, F.array(F.concat_ws(" ", bib, "name", "team", clock, n)))
    said = said.otherwise(F.array(F.concat_ws(" ", n, bib, "name", "licence", "team", clock)))
    said = F.when(F.col("seconds").isNull() & (F.col("layout") == 3), F.array(F.concat_ws(" ", bib, "name", "team", "status"))).otherwise(said)
    def on(page: Column, lines: Column, first: Column | int) -> Column:
        return F.transform(lines, lambda text, i: F.struct(page.cast("int").alias("page"), (first + i).cast("int").alias("line"), text.alias("text")))

    start = F.col("section") * SECTION_PAGES
    category = F.element_at(F.array(*[F.lit(c) for _, c in SECTIONS]), F.col("section") + 1)
    header = F.element_at(F.array(*map(F.lit, HEADERS)), F.col("layout") + 1)
    title = F.concat(F.lit("全國"), "book", F.lit("公路錦標賽"))
    top = F.array(title, F.concat(category, F.lit(" "), (F.col("section") * 10 + 50).cast("string"), F.lit("公里個人公路賽")), F.lit("公告： R1"), header)
    summary = F.array(title, F.lit("總成績表"), F.lit("1 2 王小明 陳大文 04:05:13"))
    own = on(start + F.floor((F.col("n") - 1) / PAGE_ROWS), said, 10 + 2 * ((F.col("n") - 1) % PAGE_ROWS))
    printed = F.when(F.col("n") == 1, F.concat(on(start, top, 0), own, on(start + SECTION_PAGES - 1, summary, 0))).otherwise(own)
    return e.select("book", F.inline(printed))


def item_tables(pages: DataFrame) -> DataFrame:
    """(page_id, html): the listed links of each page as a table with headings over two rows, a cell beside all rows and a table within it."""
    item = F.lit('<li><a href="([^"]*)">([^<]*)</a></li>')
    links, texts = F.regexp_extract_all("html", item, F.lit(1)), F.regexp_extract_all("html", item, F.lit(2))
    rows = F.transform(F.arrays_zip(links.alias("link"), texts.alias("text")), lambda x: F.concat(F.lit("<td>"), x["text"], F.lit("</td><td>"), x["link"]))
    beside = F.concat(F.lit("<td rowspan="), F.size(rows).cast("string"), F.lit(">"), F.col("page_id").cast("string"), F.lit(" <table><tr><td>inner</table> end"))
    body = F.array_join(rows, "</td></tr><tr>")
    return pages.filter(F.size(rows) > 0).select("page_id", F.concat(F.lit("<table><tr><th rowspan=2>Page<th colspan=2>Item</tr><tr><th>Text<th>Link</tr><tr>"), beside, body, F.lit("</tr></table>")).alias("html"))


def calendars(orders: DataFrame) -> DataFrame:
    """(page, year, html): orders as races on calendar pages, a page per customer and season (July to June), in one of three layouts."""
    day = F.to_date("o_orderdate")
    season = F.year(F.add_months(day, -6))
    o = orders.select(F.col("o_custkey").alias("cust"), season.alias("season"), day.alias("day"), F.col("o_orderkey").alias("k"))
    date = F.concat_ws(".", F.month("day").cast("string"), F.dayofmonth("day").cast("string"))
    name = F.concat(F.lit("Order "), F.col("k").cast("string"), F.lit(" 挑戰賽"))
    kind = F.col("cust") % 3
    line = F.when(kind == 0, F.concat(F.lit("<li>"), date, F.lit("｜"), name, F.lit("：100K／報名連結</li>")))
    line = line.when(kind == 1, F.concat(F.lit("<p>"), date, F.lit("&#65372;"), name, F.lit("／報名連結<br/>")))
    cells = [F.lit("<tr><td>"), F.translate(date, ".", "/"), F.lit("</td><td>")]
    line = line.otherwise(F.concat(*cells, name, F.lit("</td></tr>"), *cells, F.lit("城市路跑賽</td></tr>")))
    pages = o.groupBy("cust", "season").agg(F.array_sort(F.collect_list(F.struct("day", "k", line.alias("line")))).alias("lines"))
    return pages.select(F.concat_ws("-", "cust", "season").alias("page"), F.year(F.col("lines")[0]["day"]).alias("year"), F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("html"))

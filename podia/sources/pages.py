"""Results and calendars on HTML pages: tables as grids of cells, lists as tables of one column, and dated races."""

from __future__ import annotations

import html
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from podia.operators.normalise import RECORD, make_records

#: The greatest spans that count, as browsers have it.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
ROWS = "array<struct<table:int,line:int,header:boolean,heads:array<string>,cells:array<string>,links:array<string>>>"


class _Cell:
    def __init__(self, header: bool) -> None:
        self.header, self.parts, self.link = header, [], None

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class _Table:
    """One table that is open: its rows so far, and the cells that reach down into rows to come."""

    def __init__(self, number: int, tag: str) -> None:
        self.number, self.tag = number, tag
        self.rows: list[list[_Cell | None]] = []
        self.reach: dict[int, tuple[int, _Cell]] = {}
        self.cell: _Cell | None = None
        self.in_row = False

    def start_row(self) -> None:
        self.end_row()
        self.rows.append([])
        self.in_row = True
        self._fill()

    def _fill(self) -> None:
        """Columns at the row's end that a cell above reaches."""
        row = self.rows[-1]
        while len(row) in self.reach:
            row.append(self.reach[len(row)][1])

    def start_cell(self, header: bool, columns: int, rows: int) -> None:
        if not self.in_row:
            self.start_row()
        self.cell = _Cell(header)
        row = self.rows[-1]
        for _ in range(columns):
            if rows > 1:
                self.reach[len(row)] = (rows, self.cell)
            row.append(self.cell)
        self._fill()

    def end_row(self) -> None:
        self.cell = None
        if self.in_row:
            row = self.rows[-1]
            for column in sorted(c for c in self.reach if c >= len(row)):
                row += [None] * (column - len(row))
                row.append(self.reach[column][1])
            self.reach = {c: (n - 1, cell) for c, (n, cell) in self.reach.items() if n > 1}
        self.in_row = False


class _Grids(HTMLParser):
    """The tables and lists of a page in the order in which they start; what is in an inner one isn't in the outer one."""

    def __init__(self) -> None:
        super().__init__()
        self.done: list[_Table] = []
        self.open: list[_Table] = []
        self.hidden = 0

    def _span(self, attrs: list, name: str, most: int) -> int:
        said = dict(attrs).get(name) or ""
        n = int(said) if said.strip().isascii() and said.strip().isdigit() else 1
        return min(n, most) or (most if name == "rowspan" else 1)

    def _close(self, tags: tuple[str, ...]) -> None:
        """Close the innermost open table of these tags, with all that is open in it."""
        if any(t.tag in tags for t in self.open):
            while self.open:
                table = self.open.pop()
                table.end_row()
                if table.tag in tags:
                    return

    def handle_starttag(self, tag, attrs):
        top = self.open[-1] if self.open else None
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in ("table", "ul", "ol"):
            self.open.append(_Table(len(self.done), tag))
            self.done.append(self.open[-1])
        elif top is None:
            return
        elif tag == "li" and top.tag != "table":
            top.start_row()
            top.start_cell(False, 1, 1)
        elif tag == "tr" and top.tag == "table":
            top.start_row()
        elif tag in ("td", "th") and top.tag == "table":
            top.start_cell(tag == "th", self._span(attrs, "colspan", MOST_COLUMNS), self._span(attrs, "rowspan", MOST_ROWS))
        elif tag == "br":
            self.handle_data(" ")
        elif tag == "a" and top.cell and top.cell.link is None:
            top.cell.link = dict(attrs).get("href")

    def handle_endtag(self, tag):
        top = self.open[-1] if self.open else None
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("table", "ul", "ol"):
            self._close((tag,))
        elif top and tag in ("tr", "li"):
            top.end_row()
        elif top and tag in ("td", "th"):
            top.cell = None

    def handle_data(self, data):
        if self.open and self.open[-1].cell and not self.hidden:
            self.open[-1].cell.parts.append(data)


def grid_rows(page: str | None) -> list[tuple]:
    """(table, line, header, heads, cells, links) of every row that has cells.

    A cell that spans columns or rows stands at all of its places. heads are
    the cells of the last row of headings above, links the first address in each cell.
    """
    parser = _Grids()
    parser.feed(page or "")
    parser.close()
    out = []
    for table in parser.done:
        if table in parser.open:
            table.end_row()
        heads: list[str] = []
        for line, row in enumerate(r for r in table.rows if r):
            cells = [c.text() if c else "" for c in row]
            header = all(c is None or c.header for c in row)
            out.append((table.number, line, header, heads, cells, [c.link if c else None for c in row]))
            heads = cells if header else heads
    return out


def html_tables(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """One row for each row of each table or list of each page: the page's other columns, then table, line, header, heads, cells, links.

    See grid_rows. Tables are numbered in the order in which they start, inner ones too. A page that is null,
    empty or without tables gives no rows; tags left open end with the page.
    """

    @F.pandas_udf(ROWS)
    def rows_of(texts: pd.Series) -> pd.Series:
        names = ("table", "line", "header", "heads", "cells", "links")
        return texts.map(lambda t: [dict(zip(names, r, strict=True)) for r in grid_rows(t)])

    others = [c for c in pages.columns if c != html_col]
    rows = pages.select(*others, F.explode(rows_of(F.col(html_col))).alias("__row"))
    return rows.select(*others, "__row.*")


def html_results(pages: DataFrame, columns: dict[str, int | str], html_col: str = "html") -> DataFrame:
    """Records from table rows, each field from a place, or from the first column whose heading matches a pattern.

    Rows of headings go, and rows that lack one of the columns. What is no
    number where a number belongs (a dash for a rank) is null.
    """
    kinds = {f.name: f.dataType for f in RECORD}

    def cell(where: int | str) -> Column:
        place = F.lit(where) if isinstance(where, int) else F.array_position(F.transform("heads", lambda h: h.rlike(where)), True).cast("int") - 1
        return F.when(place >= 0, F.get("cells", place))

    rows = html_tables(pages, html_col).filter("not header").filter(reduce(lambda a, b: a & b, [cell(x).isNotNull() for x in columns.values()]))
    own = [c for c in pages.columns if c != html_col and c not in columns]
    return make_records(rows.select(*own, *[F.nullif(cell(x), F.lit("")).try_cast(kinds[name]).alias(name) for name, x in columns.items()]))


# How calendar pages write a day and a race, and what in a table is no race.
DAY = r"^(\d{1,2})[/.．／](\d{1,2})"
BAR, CUT, LINK_WORDS = "[｜|]", "[：:／/]", r"&\w+;|報名連結"
OTHER_SPORTS = r"(?i)鐵人|三項|馬拉松|路跑|超馬|超級馬拉松|游泳|越野跑|健行|健走|IRON|Triathlon|swimrun|duathlon|TRI\b"
OWN_TOURS = r"(?i)^(?-i:ensage)|保母車|接駁|順騎|約騎|賞櫻|神掌|trip|東南旅遊|佐渡|新潟|SADO|海外"
RACE_WORDS = "賽|挑戰|盃|車|KOM|繞圈|武嶺|環|登山|騎|P字|塔|gravel|Gravel"
ARTICLES = r"https?://|www\.|重點|風險|注意事項|攻略|懶人包|提醒"
LEAST_NAME, MOST_NAME = 4, 48


def _decoded(text: Column) -> Column:
    """text with its character references decoded."""

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return decode(text)


def _plain(text: Column, between: str) -> Column:
    """Text without tags, its character references decoded, its white space single."""
    return F.trim(F.regexp_replace(_decoded(F.regexp_replace(text, "<[^>]+>", between)), r"[\s\x{00a0}\x{3000}]+", " "))


def calendar_races(pages: DataFrame, year: Column | None = None, html_col: str = "html") -> DataFrame:
    """The races of calendar pages: the page's other columns, then layout, line, race and date.

    Three layouts are known: list items and text lines, both `M.D｜name：…`,
    and table rows of a day and a name. A page has the one of which it shows most
    lines, in this order if several do. In tables, what is no bicycle race goes.

    Calendars run in the order of dates, so the year (of the page's first race)
    turns wherever the month is less than on the dated line before; how often it has
    turned is a running sum over the page's lines. Without a year, or where there is no such
    day, the date is null and the race stays. Names shorter than four characters
    go. A null page gives no rows.
    """
    own = [c for c in pages.columns if c != html_col]
    year = F.lit(None).cast("int") if year is None else year.cast("int")
    page = pages.select(F.struct(*own).alias("own"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), year.alias("year")).withColumn("page", F.monotonically_increasing_id())
    blocks = {
        "list": F.regexp_extract_all("html", F.lit("(?s)<li[ >].*?</li>"), F.lit(0)),
        "lines": F.split(F.regexp_replace(F.regexp_replace("html", r"(?i)<br\s*/?>|</?(li|tr|td)[ >]", "\n$0"), "<[^>]+>", "\n"), "\n"),
        "table": F.regexp_extract_all("html", F.lit("(?s)<tr[ >].*?</tr>"), F.lit(0)),
    }
    every = [page.select("page", "own", "year", F.lit(i).alias("rank"), F.lit(name).alias("layout"), F.posexplode(x).alias("line", "raw")) for i, (name, x) in enumerate(blocks.items())]
    lines = every[0].unionByName(every[1]).unionByName(every[2]).filter(F.col("raw").rlike(r"\d"))
    lines = lines.withColumn("text", _plain(F.col("raw"), " "))
    lines = lines.withColumn("text", F.when(F.col("layout") == "table", F.regexp_replace("text", r"^(\d{1,2}/\d{1,2}) *", "$1 ")).otherwise(F.col("text"))).filter(F.col("text").rlike(DAY))
    barred = F.trim(F.regexp_replace(F.get(F.split(F.get(F.split("text", BAR, 2), 1), CUT, 2), 0), LINK_WORDS, ""))
    tabled = F.regexp_extract("text", r"^\d{1,2}/\d{1,2} (.+)", 1)
    cycling = ~tabled.rlike(OTHER_SPORTS) & ~tabled.rlike(OWN_TOURS) & tabled.rlike(RACE_WORDS) & ~tabled.rlike(ARTICLES)
    cleaned = F.substring(F.trim(F.regexp_replace(tabled, r"(?U)【[^】]*】|&\w+;|^\W+", "")), 1, MOST_NAME)
    is_line = F.col("text").rlike(r"^\d{1,2}[.／/]\d{1,2} *" + BAR)
    name = F.when(F.col("layout") == "table", F.when(cycling, cleaned)).when(F.col("layout") == "list", barred).when(is_line, barred)
    lines = lines.withColumn("race", F.when(F.length(name) >= LEAST_NAME, name))

    on_page = Window.partitionBy("page", "rank")
    lines = lines.withColumn("shown", F.count("race").over(on_page))
    best = F.max(F.struct("shown", (-F.col("rank")).alias("r"))).over(Window.partitionBy("page"))
    lines = lines.withColumn("best", best).filter((F.col("best.r") == -F.col("rank")) & (F.col("shown") > 0))
    day = [F.regexp_extract("text", DAY, i).cast("int") for i in (1, 2)]
    dated = lines.withColumns({"month": day[0], "day": day[1]})
    in_order = Window.partitionBy("page").orderBy("line")
    turn = F.coalesce((F.col("month") < F.lag("month").over(in_order)).cast("int"), F.lit(0))
    dated = dated.withColumn("turn", turn).withColumn("turns", F.sum("turn").over(in_order))
    date = F.try_to_date(F.format_string("%04d-%02d-%02d", F.col("year") + F.col("turns"), "month", "day"))
    date = F.when(F.col("year").isNotNull(), date.cast("string"))
    return dated.filter("race is not null").select("own.*", "layout", "line", "race", date.alias("date"))

"""Layouts of printed result lists; names are placeholders."""

import pytest

from podia.sources import books

TITLE = "113年全國自由車公路錦標賽暨菁英排名賽"


def lines(spark, *pages, book="b"):
    rows = [(book, p, i, t, "x") for p, page in enumerate(pages) for i, t in enumerate(page)]
    return spark.createDataFrame(rows, "book string, page int, line int, text string, category string").repartition(3)


def read(spark, *pages):
    return sorted(books.book_rows(lines(spark, *pages)).collect(), key=lambda r: (r.page, r.line))


TWO_CLOCKS = [
    TITLE, "女子青年組 11.2公里個人計時賽", "公告： R1", "名次 比賽號碼 姓名 參賽證號 隊名 出發時間 終點時間 加秒 成績 時速 備註",
    "1 304 王小明 10139673112 新社高中 00:02:00 00:18:49.375 00 16:49.375 39.95 km/hr", "DNF 316 李小華 10146227985 屏東自由車隊 -",
]


def test_result_behind_start_and_finish(spark):
    first, second = read(spark, TWO_CLOCKS)
    assert (first.rank, first.bib, first.name, first.uci_id, first.team) == (1, "304", "王小明", "10139673112", "新社高中")
    assert (first.finish_time, first.finish_seconds, first.status) == ("00:16:49.375", 1009.375, None)
    assert (first.category, first.event, first.gender) == ("女子青年組", "11.2公里個人計時賽", "F")
    assert (second.status, second.finish_seconds, second.rank, second.team) == ("DNF", None, None, "屏東自由車隊")


def test_summaries_sums_and_selections_are_refused(spark):
    summary = [TITLE, "總成績表", "姓名 名次 第1名 第2名", "1 2 王小明 陳大文 04:05:13"]
    combined = [TITLE, "男子菁英個人計時及公路賽成績總和", "公告： R6", "序號 比賽號碼 姓名 參賽證號 隊名 計時賽成績 公路賽成績 成績總和", "1 029 王小明 10005601429 某車隊 00:54:09.193 04:09:07 05:03:16.193"]
    again = [TITLE, "男子菁英組(選拔) 30公里個人計時賽", "公告:1~2", "名次 選手號碼選手姓名 英文姓 英文名 UCIID 單位 成績", "1 053 王小明 WANG Xiao Ming 10005601429 個人 42:23.125"]
    table = lines(spark, summary, combined, again)
    assert books.book_rows(table).count() == 0
    assert {r.refused for r in books.refused_lines(table).collect()} == {"page skipped"}


def test_number_on_its_own_line_and_semicolon(spark):
    page = ["112年全國自由車公路國手選拔賽", "女子菁英組 92公里個人公路賽", "公告： 6", "名次 比賽號碼 姓名 參賽證號 隊名 成績", "210", "1 王小美 R112047 某車隊 02:50;22.54", "9", "nobody"]
    (r,) = read(spark, page)
    assert (r.rank, r.bib, r.finish_time, r.team, r.uci_id) == (1, "210", "02:50:22.54", "某車隊", None)


def test_glued_overlay_is_no_time(spark):
    page = ["108年全國自由車公路錦標賽暨菁英選拔賽", "男子菁英組 118.9公里個人公路賽", "公告:11", "名次 選手號碼選手姓名 英文姓 英文名 UCIID 單位 成績 檢核時間 加秒 時速", "40 111 王小明 WANG 15:46.310083232953 個人 2:55:30.490 1:33:02.423 0 40.648"]
    (r,) = read(spark, page)
    assert (r.finish_time, r.team) == ("02:55:30.490", "個人")


def test_stages_and_laps_without_a_rank(spark):
    stage = ["113 全國中等學校錦標賽", "Stage 2 賽程 1 距離 3.1 km 開賽時間 8:36:09", "組別 國小四男 日期 6月10日", "Rank No. Name TEAM Finish Time Gap 單站積分 上期積分 累計積分", "1 306 王小明 某國小 8:42:05.85 05m 56.69s + 00m 0.00s 19 19 38"]
    laps = ["107年全國自由車少年公路錦標賽", "男子15歲組36.8公里公路賽", "排名 號碼＼BIB姓名＼Name 團隊＼Team 成績 Lap 1 Lap 2 時速 備註", "0001 0059 王小明 某車隊 001:04:34.81 000:19:54.94 000:15:40.56 34.19", "0016 陳大文 某國中 000:09:07.47"]
    first, second = read(spark, stage, laps)
    assert (first.finish_seconds, first.finish_time, first.event, first.gender, first.category) == (356.69, "00:05:56.69", "Stage 2 3.1km", "M", "國小四男")
    assert (second.category, second.bib, second.finish_time) == ("男子15歲組", "0059", "01:04:34.81")
    assert [r.refused for r in books.refused_lines(lines(spark, laps)).collect() if r.text.startswith("0016")] == ["no rank"]


def test_header_and_category_carry_over_until_a_skipped_page(spark):
    more = ["2 305 陳大文 10139673113 新社高中 00:02:30 00:20:00.000 00 17:30.000 39.0 km/hr"]
    skipped = ["x", "出賽名單", "7 1 林一一 隊 1:00:00"]
    after = ["3 306 林小美 10139673114 新社高中 00:03:00 00:21:00.000 00 18:00.000 38.0 km/hr"]
    rows = read(spark, TWO_CLOCKS, more, skipped, after)
    assert [(r.page, r.bib, r.finish_seconds, r.category) for r in rows] == [(0, "304", 1009.375, "女子青年組"), (0, "316", None, "女子青年組"), (1, "305", 1050.0, "女子青年組")]
    assert [r.refused for r in books.refused_lines(lines(spark, TWO_CLOCKS, more, skipped, after)).filter("page = 3").collect()] == ["no table"]


def test_number_first_with_the_rank_behind_the_time(spark):
    page = ["105年全國自由車公路錦標賽", "男子菁英組 90公里個人公路賽", "公告", "號碼 姓名 組別 單位 成績 名次", "12 王小明 男子菁英組 某車隊 個人公路賽 2:01:02.5 3", "14 王小華 男子菁英組 某車隊 DNF", "15 王小中 某車隊 0:00:00"]
    first, second = read(spark, page)
    assert (first.rank, first.team, first.finish_seconds) == (3, "某車隊", 7262.5)
    assert (second.rank, second.status, second.finish_time) == (None, "DNF", None)


def test_repeated_rows_nulls_and_records(spark):
    table = lines(spark, TWO_CLOCKS, TWO_CLOCKS).unionByName(lines(spark, [None, ""], book=None))
    assert books.book_rows(table).count() == 2
    assert books.read_lines(table).count() == 14
    assert books.read_lines(lines(spark).limit(0)).count() == 0
    records = {r.bib: r for r in books.book_records(table).collect()}
    assert (records["304"].name_masked, records["304"].finish_seconds, records["304"].result_label) == ("王○明", 1009.375, "11.2公里個人計時賽")


@pytest.mark.parametrize("text", ["1 304", "王小明 304 1 00:10:00", "1 x9y 王小明 00:10:00", "1 304 王小明明明 00:10:00", "1 304 王小明", "a 3 王小明 00:10:00"])
def test_lines_that_are_no_rows(spark, text):
    assert read(spark, [*TWO_CLOCKS[:3], "名次 號碼 姓名 成績", text]) == []


def test_lines_are_read_once_whatever_is_filtered(spark):
    lines = spark.createDataFrame([("b", 1, 1, "x")], "book string, page int, line int, text string")
    for rows in (books.book_rows(lines), books.refused_lines(lines)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp") + plan.count("RLIKE") < 150


def test_lines_are_shuffled_once_and_null_books_and_pages_are_like_others(spark):
    """Lines are shuffled by book and page for their windows only: pages and the join back to them take the same shuffle."""
    more = ["2 305 陳大文 10139673113 新社高中 00:02:30 00:20:00.000 00 17:30.000 39.0 km/hr", None, "x"]
    rows = [(book, page, i, text) for book, pages in (("b", (1, 2)), (None, (1, 2)), (None, (None, 1)), ("c", (None, 3))) for page, texts in zip(pages, (TWO_CLOCKS, more)) for i, text in enumerate(texts)]
    table = spark.createDataFrame(rows, "book string, page int, line int, text string")
    read = books.read_lines(table)
    got = sorted((str(r.book), str(r.page), r.bib, r.category, r.finish_seconds) for r in read.collect() if r.refused is None)
    first, second, third = ("304", "女子青年組", 1009.375), ("316", "女子青年組", None), ("305", "女子青年組", 1050.0)
    # Book None has page 1 twice, once as a first and once as a second page: its lines are those of one page.
    assert [x for x in got if x[0] == "b"] == [("b", "1", *first), ("b", "1", *second), ("b", "2", *third)]
    assert [x for x in got if x[0] == "c"] == [("c", "3", *third), ("c", "None", *first), ("c", "None", *second)]
    assert [x for x in got if x[0] == "None"] == [("None", "1", *first), ("None", "1", *third), ("None", "1", *second), ("None", "2", *third), ("None", "None", *first), ("None", "None", *second)]
    assert read.count() == len(rows)
    plan = read._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "isFinalPlan=true" in plan and plan.count("ReusedExchange") == 1

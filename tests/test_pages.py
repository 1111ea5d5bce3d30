import datetime

import pytest
from pyspark.sql import functions as F

from podia.sources import pages

EVENT = (
    '<h1>男子A組</h1><table class="tbl"><thead><tr><th>#</th><th>BIB</th><th>姓名</th><th>分組</th><th>隊伍</th><th style="text-align:right">完賽時間</th><th>圈數</th><th>狀態</th></tr></thead><tbody>'
    '<tr class="row-link"><td class="rank"><span class="pos pos-1">01</span></td><td>2</td><td>陳大文<!-- --> </td><td>M<!-- --> / M30</td><td>.UTSUNOMIYA &amp; 宇都宮</td><td>00:47:38</td><td>35</td><td><span class="pill fin"><span></span>FIN</span></td></tr>'
    '<tr class="row-link"><td><span>—</span></td><td>21</td><td>洪甲詠</td><td>M / U23</td><td>TEAM</td><td>—</td><td>25</td><td>DNF</td></tr></tbody></table>'
)


def cells(page):
    return [(t, line, c) for t, line, _, _, c, _ in pages.grid_rows(page)]


def test_cells_stand_at_all_places_they_span():
    page = "<table><tr><th rowspan=2>A</th><th colspan=2>B<tr><th>c<th>d</th></tr><tr><td rowspan='2'>1</td><td>2</td><td rowspan=3>3</td></tr><tr><td>4</td></tr><tr><td>5</td><td>6</td></tr></table>"
    assert cells(page) == [(0, 0, ["A", "B", "B"]), (0, 1, ["A", "c", "d"]), (0, 2, ["1", "2", "3"]), (0, 3, ["1", "4", "3"]), (0, 4, ["5", "6", "3"])]
    assert [h for _, _, h, _, _, _ in pages.grid_rows(page)] == [True, True, False, False, False]
    assert pages.grid_rows(page)[4][3] == ["A", "c", "d"]
    gap = "<table><tr><td>a<td>b<td rowspan=2>c</tr><tr><td>x</tr></table>"
    assert cells(gap) == [(0, 0, ["a", "b", "c"]), (0, 1, ["x", "", "c"])]
    wild = "<table><tr><td rowspan=0 colspan=0>a<td colspan=x>b</tr><tr><td>c</tr><tr><td>d</table>"
    assert cells(wild) == [(0, 0, ["a", "b"]), (0, 1, ["a", "c"]), (0, 2, ["a", "d"])]


def test_inner_tables_and_lists_are_tables_of_their_own():
    page = "<table><tr><td>before <table><tr><td>in</td></tr></table> after<ul><li>one<li>two <b>bold</b></ul></td><td>next</td></tr></table><ol><li><a href='/x'>x</a> y</li></ol>"
    assert cells(page) == [(0, 0, ["before after", "next"]), (1, 0, ["in"]), (2, 0, ["one"]), (2, 1, ["two bold"]), (3, 0, ["x y"])]
    assert pages.grid_rows(page)[-1][5] == ["/x"]
    assert cells("<ul><li>a<ul><li>b</li></ul> c</li></ul>") == [(0, 0, ["a c"]), (1, 0, ["b"])]


def test_broken_pages():
    assert cells(None) == cells("") == cells("<p>no table</p><li>loose") == []
    assert cells("<table><tr><td>a&amp;b<td>c") == [(0, 0, ["a&b", "c"])]
    assert cells("<table><td>no row</td></table></table></ul>") == [(0, 0, ["no row"])]
    assert cells("<table><tr><td>x<script>var t='<td>';</script></td></tr></table>") == [(0, 0, ["x"])]
    assert cells("<table><ul><li>a</table><table><tr><td>b</table>") == [(1, 0, ["a"]), (2, 0, ["b"])]
    assert len(cells("<table>" + "<tr><td>1</td></tr>" * 20_000)) == 20_000


def test_results_by_heading_and_by_place(spark):
    df = spark.createDataFrame([(1, EVENT), (2, None), (3, "<p>none</p>")], "page_id int, html string")
    assert pages.html_tables(df).count() == 3
    by_head = {"rank_overall": "^#$", "bib": "BIB", "name_raw": "姓名|Name", "category_raw": "分組", "team": "隊伍", "finish_time": "時間", "status": "狀態"}
    got = sorted(pages.html_results(df, by_head).collect(), key=lambda r: r.bib)
    assert [(r.bib, r.name_masked, r.category_raw, r.team, r.finish_seconds, r.status) for r in got] == [("2", "陳○文", "M / M30", ".UTSUNOMIYA & 宇都宮", 2858.0, "FIN"), ("21", "洪○詠", "M / U23", "TEAM", None, "DNF")]
    assert pages.html_results(df, {"name_raw": 2, "finish_time": 5}).filter("finish_seconds is not null").count() == 1
    assert pages.html_results(df, {"name_raw": 12}).count() == pages.html_results(df, {"name_raw": "nothing"}).count() == 0


def races(spark, page, year=None):
    df = spark.createDataFrame([(7, page, year)], "page_id int, html string, y int")
    return [(r.race, r.date) for r in pages.calendar_races(df, F.col("y")).orderBy("line").collect()]


def day(*parts):
    return str(datetime.date(*parts))


def test_listed_races_and_the_turn_of_the_year(spark):
    page = "".join(f"<li>{x}</li>" for x in [
        "10.3｜L&rsquo;&Eacute;tape環法自行車挑戰賽：103K／報名連結", "12.20｜石門羅馬百K自行車挑戰賽：72K／報名連結", "1.1-1.2｜2027瘋系列超級騎士挑戰賽：300K／報名連結", "2.30｜沒有這一天的賽事", "3.1 without a bar", "3.2｜短", "公告",
    ])
    assert races(spark, page, 2026) == [("L’Étape環法自行車挑戰賽", day(2026, 10, 3)), ("石門羅馬百K自行車挑戰賽", day(2026, 12, 20)), ("2027瘋系列超級騎士挑戰賽", day(2027, 1, 1)), ("沒有這一天的賽事", None)]


def test_lines_with_references_and_without_a_year(spark):
    page = "<p>3.5&#65372;武嶺登山賽：100K<br/>12.31 ｜跨年挑戰賽／報名連結<br>1.10｜新年挑戰賽：x<BR>4.1 not a race</p>"
    assert races(spark, page) == [("武嶺登山賽", None), ("跨年挑戰賽", None), ("新年挑戰賽", None)]
    assert races(spark, page, 2025) == [("武嶺登山賽", day(2025, 3, 5)), ("跨年挑戰賽", day(2025, 12, 31)), ("新年挑戰賽", day(2026, 1, 10))]


def test_tabled_races_without_other_sports_links_and_articles(spark):
    rows = ["4/12</td><td>TWB台灣自行車協會 https://www.twbike.org/register", "4/12</td><td>輪霸西濱 五大重點 降低雨天騎乘風險", "4/12</td><td>【早鳥】TBA中華民國自行車協會 輪霸西濱挑戰", "5/1</td><td>台東三項鐵人賽", "5/2</td><td>ensage 環花東", "5/3</td><td>音樂祭", "5/4</td><td>環花東 Japan TRIP"]
    assert races(spark, "<table>" + "".join(f"<tr><td>{r}</td></tr>" for r in rows) + "</table>", 2026) == [("TBA中華民國自行車協會 輪霸西濱挑戰", day(2026, 4, 12))]


@pytest.mark.parametrize("page", [None, "", "<p>nothing</p>", "<li>10.3 nothing</li>"])
def test_pages_without_races(spark, page):
    assert races(spark, page, 2026) == []

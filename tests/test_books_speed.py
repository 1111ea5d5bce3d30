import random
import re

from pyspark.sql import functions as F

from podia.sources import books


def test_clean_teams_skip_the_patterns_and_others_lose_the_same(spark):
    """What no pattern is found in stays as it is: with and without the check all texts give the same."""
    r = random.Random(2)
    bits = ["車隊12", " ", "  ", "-", "男子菁英組 ", " 公路賽", "AB 12:30.4 ", "R1234567", "100012345678", " 100012345", "1:02:03.5", "DNF", "a", "7", " 12", "TT 1:2", "\u0085", "x - y"]
    texts = ["", "車隊5", "a b", *["".join(r.choice(bits) for _ in range(r.randrange(1, 5))) for _ in range(400)]]
    rows = spark.createDataFrame([(t,) for t in texts], "left string").select("left", books._team(F.col("left")).alias("team"), F.col("left").rlike(books._ANY_NOT_TEAM).alias("any")).collect()
    assert all(x.team == x.left for x in rows if not x["any"]) and {x["any"] for x in rows} == {True, False}
    assert any(x.team != x.left for x in rows if x["any"])


def test_times_are_written_as_before(spark):
    times = [(x, t) for x in (0.4, 9.0, 61.0, 3599.0, 3600.5, 360000.0, 4000000.0, None) for t in ("1:2", "1:02.5", "a.b", None)]
    rows = spark.createDataFrame(times, "x double, t string")
    whole = F.floor("x").cast("int")
    clock = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    decimals = F.regexp_extract("t", r"\.(\d+)$", 1)
    before = F.concat(clock, F.when(decimals != "", F.concat(F.lit("."), decimals)).otherwise(""))
    assert all(x.a == x.b for x in rows.filter("x is not null and t is not null").select(books._as_time(F.col("x"), F.col("t")).alias("a"), before.alias("b")).collect())


def test_a_line_is_searched_for_clocks_twice_and_written_without_formatters(spark):
    lines = spark.createDataFrame([("b", 1, 1, "t")], "book string, page int, line int, text string")
    plan = books.book_rows(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in plan and plan.count("regexp_extract_all(rest#") == 1
    assert not re.search(r"split\(rest#\d+, " + re.escape(books.CLOCK) + ", 2", plan)
    assert books.TEAM_EVENT in plan.split("Join")[-1]


def test_white_space_and_lone_numbers_are_told_as_before(spark):
    texts = ["a  b", "a\tb", " a ", "a b", "　a b", "1;2", "x;1;2", None, "12", "1234", "12345", "123\u0085", "1 王小明 隊 1:02:03", "a\r\nb"]
    given = spark.createDataFrame([("b", 1, i, t) for i, t in enumerate(texts)], "book string, page int, line int, text string")
    got = {x.line: x.text for x in books._rejoined(given).collect()}
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\s\x{00a0}\x{3000}]+", " ")), r"(\d);(\d)", "$1:$2")
    assert got == {x.line: x.tidy for x in given.select("line", plain.alias("tidy")).collect()}
    joined = {x.line for x in books._rejoined(given).filter("row <> text").collect()}
    assert joined == {x.line for x in given.collect() if x.line == 11}

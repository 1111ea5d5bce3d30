import pytest
from pyspark.sql import functions as F

from podia.functions import measures as M
from podia.functions import text as X


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.select(fn(F.col("v")).alias("o"), "i").orderBy("i").collect()]


CASES = [
    (X.mask_name, ["李明", "王小明", "歐陽菲菲", "李", " 王 小 明 ", "Ann Lee", "Lee, Ann-Marie", "<b>", "123", "", None], ["李○", "王○明", "歐○○菲", "李", "王○明", "A○ L○", "L○ A○", "", "", "", None]),
    (X.extract_year, ["2024武嶺", "x1999", "2031", "", None], [2024, None, None, None, None]),
    (X.race_key, ["2024 彰化 經典（百K）", "1114-15 花東", "巿民.組", "", None], ["彰化經典百K", "花東", "市民組", "", None]),
    (X.time_to_seconds, ["1:02:03", "t 01:00:00.5", "59:59", "", None], [3723.0, 3600.5, None, None, None]),
    (X.finish_input, ["1:02:03", "59:59", "90", "1:x", "-1", "", None], [3723, 3599, 90, None, None, None, None]),
    (X.division_gender, ["M24-35", "W40", "女子組", "男子", "U15", "MASTER", None], ["M", "F", "F", "M", None, "M", None]),
    (X.division_age, ["M24-35", "W40", "u15", "MASTER", "菁英", None], ["24-35", "40", "U15", "MASTER", None, None]),
    (X.gender_from_category, ["RM35", "W 20", "男女混合", "男子組", "女子", "F", "A", "Ｍ45", None], ["M", "F", None, "M", "F", None, None, "M", None]),
    (X.age_from_category, ["RM35", "W20", "一般", None], ["35", "20", None, None]),
    (X.age_band, ["13", "18", "19-23", "35", "49", "59", "60", "U15", "master", "4-1", "x", "", None], ["U19", "U19", "19-29", "30-39", "40-49", "50-59", "60+", "U19", "MASTER", None, None, None, None]),
    (lambda c: X.race_class(c, F.lit("M35")), ["挑戰組", "國中", "ttt", "菁英", "經典", "市民", "完賽", "", None], ["挑戰", "青少年", "團體計時", "競賽", "市民經典", "市民", "認證", "分齡", "分齡"]),
    (lambda c: X.discipline(c, F.lit("計時")), ["KOM之路", "kom", "Criterium 繞圈", "環花東", None], ["climb", "climb", "crit", "tt", "tt"]),
    (lambda c: X.county(c, F.lit("臺東縣")), ["武嶺盃", "花東", "無名", None], ["南投", "花蓮", "臺東", "臺東"]),
    (lambda c: X.distance_km(c, F.lit("60公里")), ["自我挑戰107K", "3K", "999 KM", None], [107, 60, 60, 60]),
    (X.month_of, ["2024-05-01", "2024", None], [5, None, None]),
    (X.clean_label, ["04.28 北高360 2024", "2024年 武嶺", "—環花東 2023/2024", "2024", None], ["北高360", "武嶺", "環花東", "2024", ""]),
    (X.family_key, ["北高360", "A級", "x"], ["北高", "A級", "x"]),
    (X.search_form, ["林○ 宇", "A○ B", None], ["林宇", "ab", ""]),
    (lambda c: X.split_division(c)[0], ["M24-35宜蘭", "女子組隊", "宜蘭", None], ["M24-35", "女子組", None, None]),
    (lambda c: X.split_division(c)[1], ["M24-35宜蘭", "W40", "宜蘭", None], ["宜蘭", None, "宜蘭", None]),
]


@pytest.mark.parametrize(("fn", "inputs", "want"), CASES)
def test_scalar(spark, fn, inputs, want):
    assert values(spark, fn, inputs) == want


def test_speed_and_climb(spark):
    row = spark.range(1).select(
        X.speed_kmh(F.lit(40), F.lit(3600.0)), X.speed_kmh(F.lit(200), F.lit(3600.0)), X.vam(F.lit(3000), F.lit(7200.0)), X.watts_per_kilo(F.lit(1500.0), F.lit(5.0)), X.vam(F.lit(3000), F.lit(0.0))
    ).first()
    assert list(row) == [40.0, None, 1500.0, 6.0, None]


def test_measures(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "v double")
    assert df.select(M.median(F.col("v")), M.quantile(F.col("v"), 0.25)).first() == (2.5, 1.75)
    row = spark.range(1).select(M.in_field_percent(F.lit(1), F.lit(4)), M.in_field_percent(F.lit(5), F.lit(4)), M.in_field_percent(F.lit(0), F.lit(4)))
    assert list(row.first()) == [75.0, None, None]

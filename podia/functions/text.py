"""Scalar functions on names, categories, races and times: built-in column expressions only.

Patterns, labels and word lists below are fixed values of the result format:
they must be just these for results to agree with published ones.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "○"
CJK = "[一-鿿]"
ALL_LABELS = "全部"

# Race disciplines, first match wins; the first looks at the name alone.
DISCIPLINES = [
    ("climb", "武嶺|KOM|登山王|塔塔加|大禹嶺|爬坡"),
    ("crit", "繞圈|criterium|crit"),
    ("tt", "計時|個人計時|ITT|時間賽"),
]
# Series by words of a race's name, first match wins.
SERIES = [
    ("台灣登山大滿貫(雪巴)", "登山大滿貫|大滿貫"),
    ("96聯賽", "96聯賽|96CyclingRace|96Heroes|96 "),
    ("瘋系列環台賽", "瘋系列"),
    ("TIS崇越盃系列", "崇越盃|TIS|石羅佛|石門環湖|羅馬公路|佛陀KOM"),
    ("臺灣KOM太平洋經典賽", "KOM太平洋經典|太平洋經典賽"),
    ("臺灣KOM登山王之路", "登山王之路"),
    ("臺灣KOM登山王挑戰", "登山王挑戰|Taiwan KOM Challenge"),
    ("臺灣自行車聯賽(TCL)", "太平山王|陽明山王|臺灣自行車聯賽|台灣自行車聯賽"),
    ("環花東國際自行車賽", "環花東|花東縱谷|East Taiwan"),
    ("花蓮太平洋盃", "花蓮太平洋盃|太平洋盃"),
    ("環大臺北自行車挑戰", "環大臺北|環大台北"),
    ("L'Étape 環法日月潭", "L['’]?Étape|L['’]?Etape|環法"),
    ("銅礦88經典挑戰賽", "銅礦88|銅礦"),
    ("LAVA 落日飛車350", "落日飛車|350自行車挑戰|LAVanLife|LAVA"),
    ("自由車錦標賽/選拔", "自由車錦標賽|市長盃自由車|國手選拔|青年盃|全國公路"),
    ("捷安特自行車嘉年華", "自行車嘉年華|GIANT CUP|LIVDAY"),
    ("TBA 長途認證", "北高360|雙塔520|四極|TBA.*認證|認證"),
    ("戀戀197", "戀戀197"),
    ("仙山單車挑戰賽", "仙山|一輪盃"),
    ("世界自行車日", "鵬灣|世界自行車日"),
    ("屏東四重溪自行車挑戰賽", "四重溪"),
    ("GravelFundo 礫石越野系列", r"Gravel\s?Fundo"),
    ("TCU 台中城市繞圈賽", "台中城市繞圈"),
]
CERTIFIED = "TBA 長途認證"
# Age bands by their upper age.
AGE_BANDS = [(18, "U19"), (29, "19-29"), (39, "30-39"), (49, "40-49"), (59, "50-59")]
AGE_MIDDLE = {"U19": 17, "19-29": 24, "30-39": 34, "40-49": 44, "50-59": 54, "60+": 64}
# Counties by words of a race's name, first match wins.
COUNTIES = [
    ("臺北", "臺北|台北|天母|陽明山|大屯山|北海岸|擎天崗"),
    ("新北", "新北|淡海|平溪|雙溪"),
    ("桃園", "桃園|中壢|龍潭"),
    ("新竹", "新竹|竹站"),
    ("苗栗", "苗栗|仙山"),
    ("臺中", "臺中|台中|大雪山"),
    ("彰化", "彰化|八卦山"),
    ("南投", "南投|武嶺|日月潭|中寮|埔里|魚池"),
    ("雲林", "雲林|石壁|古坑"),
    ("嘉義", "嘉義|阿里山|塔塔加"),
    ("臺南", "臺南|台南"),
    ("高雄", "高雄"),
    ("屏東", "屏東|四重溪"),
    ("宜蘭", "宜蘭|太平山|牛鬥"),
    ("花蓮", "花蓮|太平洋|登山王|太魯閣|花東"),
    ("臺東", "臺東|台東"),
    ("澎湖", "澎湖"),
    ("金門", "金門|金沙"),
]


def blank(col: Column) -> Column:
    """Null and the empty text alike."""
    return col.isNull() | (col == "")


def filled(col: Column, other: str | Column) -> Column:
    """The text, or `other` where it is null or empty."""
    return F.when(blank(col), F.lit(other) if isinstance(other, str) else other).otherwise(col)


def stripped(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def first_of(rules: list[tuple[str, Column]], otherwise: Column | None = None) -> Column:
    """The label of the first condition that holds."""
    out = reduce(lambda acc, r: acc.when(r[1], r[0]) if acc is not None else F.when(r[1], r[0]), rules, None)
    return out.otherwise(otherwise) if otherwise is not None else out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def whole(digits: Column) -> Column:
    """The number that a text of digits writes; null for the empty text (a failed cast is far dearer than a null)."""
    return F.nullif(digits, F.lit("")).try_cast("int")


def mask_name(name: Column) -> Column:
    """A name with its middle hidden: CJK keeps the first and last character (two: the first); of other scripts
    each word keeps its first letter. Text with < or >, or without letters, becomes empty; null and empty stay."""

    def cjk(tight: Column) -> Column:
        n = F.length(tight)
        middle = F.when(n <= 2, F.lit(MASK)).otherwise(F.repeat(F.lit(MASK), n - 2))
        return F.when(n <= 1, tight).otherwise(F.concat(F.substring(tight, 1, 1), middle, F.when(n > 2, F.substring(tight, -1, 1)).otherwise(F.lit(""))))

    def masked(bare: Column) -> Column:
        initials = F.transform(F.split(bare, r"(?U)\s+"), lambda w: F.regexp_extract(w, r"\p{L}", 0))
        latin = F.concat_ws(" ", F.transform(F.filter(initials, lambda c: c != ""), lambda c: F.concat(c, F.lit(MASK))))
        tight = let(F.regexp_replace(bare, r"(?U)\s", ""), cjk)
        return F.when(bare.rlike(CJK), tight).when(bare.rlike("[<>]"), F.lit("")).otherwise(latin)

    return F.when(blank(name), name).otherwise(let(stripped(name), masked))


def is_source_masked(name: Column) -> Column:
    return F.coalesce(name.rlike("[*＊]"), F.lit(False))


def extract_year(text: Column) -> Column:
    return whole(F.regexp_extract(F.coalesce(text, F.lit("")), r"20[0-2]\d", 0))


def canonical_race_name(raw: Column) -> Column:
    """Spaces collapsed, a results heading and a leading year dropped, separators unified."""
    s = stripped(F.regexp_replace(raw, r"(?U)\s+", " "))
    s = F.regexp_replace(s, r"^成績紀錄[-—](?U)\s*", "")
    s = F.regexp_replace(s, "^20[0-2]\\d(?U)[\\s​]*", "")
    s = F.regexp_replace(F.regexp_replace(s, "[．、]", "."), "&amp;", "&")
    return F.when(blank(raw), raw).otherwise(stripped(s))


def race_key(raw: Column) -> Column:
    """The key under which names of one race meet: no leading date range, spaces or separators."""
    s = F.regexp_replace(canonical_race_name(raw), r"^\d{1,4}[-‑]\d{1,2}(?U)\s*", "")
    s = F.regexp_replace(s, r"(?U)[\s．.、&·,／/\-‑—_()（）]", "")
    return F.when(blank(raw), raw).otherwise(F.replace(s, F.lit("巿"), F.lit("市")))


def time_to_seconds(text: Column) -> Column:
    """Seconds of the first h:mm:ss[.ff] in a text."""
    part = lambda i: F.regexp_extract(text, r"(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,2}))?", i)
    seconds = whole(part(1)) * 3600 + whole(part(2)) * 60 + whole(part(3))
    fraction = F.when(part(4) != "", F.concat(F.lit("0."), part(4)).try_cast("double")).otherwise(0.0)
    return F.when(part(0) != "", seconds + fraction)


def finish_input(text: Column) -> Column:
    """Seconds of h:m:s, m:s or plain seconds as a user types them; null for anything else."""
    t = stripped(F.coalesce(text, F.lit("")))
    bits = F.split(t, ":")
    at = lambda i: F.element_at(bits, i).try_cast("int")
    return (
        F.when(t.rlike(r"^\d+:\d+:\d+$"), at(1) * 3600 + at(2) * 60 + at(3))
        .when(t.rlike(r"^\d+:\d+$"), at(1) * 60 + at(2))
        .when(t.rlike(r"^\d+$"), at(1))
    )


def split_division(segment: Column) -> tuple[Column, Column]:
    """The division token that a text begins with, and the team that follows it."""
    token = (
        r"^\s*(MASTER|男子組|女子組|男子|女子|電動輔助自行車組?|電輔車組?|電輔組?|菁英組?|挑戰組?|競賽組?|市民組?|巿民組?"
        r"|國中組?|高中組?|青年組?|社會組?|公開組?|[MWFmwf]\d{1,2}-\d{1,2}|[MWFmwf]\d{1,2}|[Uu]\d{1,2})"
    )
    division = F.regexp_extract(segment, token, 1)
    team = stripped(F.regexp_replace(segment, token, ""))
    return F.when(division != "", division), F.when(team != "", team)


def division_gender(division: Column) -> Column:
    d = stripped(division)
    return F.when(d.rlike("^[WwFf]") | d.contains("女"), "F").when(d.rlike("^[MmＭ]") | d.contains("男"), "M")


def division_age(division: Column) -> Column:
    d = stripped(division)
    span = lambda i: F.regexp_extract(d, r"(\d{1,2})\s*-\s*(\d{1,2})", i)
    single = F.regexp_extract(d, r"^[MWFmwf](\d{1,2})$", 1)
    return F.when(span(0) != "", F.concat(span(1), F.lit("-"), span(2))).when(d.rlike(r"^[Uu]\d{1,2}$"), F.upper(d)).when(d == "MASTER", d).when(single != "", single)


def gender_from_category(category: Column) -> Column:
    """M or F of a category code or word; null if it names none or both."""
    man, woman = category.contains("男"), category.contains("女")
    by_code = let(F.regexp_extract(category, r"[Rr]?([MWＭＷ])\s?\d", 1), lambda code: F.when(code.isin("M", "Ｍ"), "M").when(code != "", "F"))
    return F.when(category.contains("混") | (man & woman), None).when(woman, "F").when(man, "M").otherwise(by_code)


def age_from_category(category: Column) -> Column:
    return F.nullif(F.regexp_extract(category, r"[Rr]?[MWＭＷ]\s?(\d{1,2})", 1), F.lit(""))


def age_band(age_group: Column) -> Column:
    """The decade band of an age group by its first number; null below 13."""

    def by_age(n: Column) -> Column:
        return F.when(n >= 13, first_of([(label, n <= top) for top, label in AGE_BANDS], F.lit("60+")))

    def band(s: Column) -> Column:
        n = whole(F.regexp_extract(s, r"\d+", 0))
        return F.when(s == "MASTER", "MASTER").when(s.startswith("U"), "U19").otherwise(let(n, by_age))

    return let(age_group, lambda a: F.when(~blank(a), let(F.upper(stripped(a)), band)))


def race_class(label: Column, category: Column) -> Column:
    """The bucket that awards are given in, by words of the label and the category, first match wins."""
    lab, cat = F.coalesce(label, F.lit("")), F.coalesce(category, F.lit(""))
    return first_of(
        [
            ("電輔車", cat.rlike("電輔|電動輔助|電助")),
            ("挑戰", lab.contains("挑戰") | cat.isin("挑戰組", "挑戰") | cat.contains("挑戰組")),
            ("青少年", lab.rlike("國中|高中") | cat.rlike(r"^[Uu]\d")),
            ("團體計時", lab.rlike("團隊|團體|(?i)TTT")),
            ("競賽", lab.rlike("競賽|菁英|精英")),
            ("市民經典", lab.contains("經典") | cat.contains("經典組")),
            ("市民", lab.rlike("市民|巿民|一般") | cat.contains("一般")),
            ("認證", lab.rlike("認證|完賽")),
            ("分齡", cat.rlike(r"^[Rr]?[MWＭＷ]\d") | (cat == "MASTER") | lab.contains("分齡")),
            ("女子", cat.contains("女子")),
        ],
        F.lit("未分類"),
    )


def by_pattern(text: Column, rules: list[tuple[str, str]], otherwise: Column | None = None) -> Column:
    """The label of the first (label, pattern) that is found in the text, letters of either case."""
    t = F.coalesce(text, F.lit(""))
    return first_of([(label, t.rlike(f"(?i){pattern}")) for label, pattern in rules], otherwise)


def discipline(name: Column, category: Column, rules: list[tuple[str, str]] = DISCIPLINES) -> Column:
    """climb by the name alone, else by name and category, else road."""
    (first, pattern), *rest = rules
    both = F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(category, F.lit("")))
    return F.when(F.coalesce(name, F.lit("")).rlike(f"(?i){pattern}"), first).otherwise(by_pattern(both, rest, F.lit("road")))


def county(name: Column, region: Column, rules: list[tuple[str, str]] = COUNTIES) -> Column:
    """The county that a race's name points to, else its region's name without its kind."""
    place = F.regexp_replace(stripped(F.coalesce(by_pattern(name, rules), region)), "[縣市]$", "")
    return F.when(place != "", place)


def distance_km(*fields: Column) -> Column:
    """The first plausible distance (5 to 700 km) named in the fields."""
    km = [whole(F.regexp_extract(f, r"(\d{2,3})\s*(?:公里|[KkＫ]\s*[Mm]?|公?里)", 1)) for f in fields]
    return F.coalesce(*(let(k, lambda x: F.when(x.between(5, 700), x)) for k in km))


def speed_kmh(km: Column, seconds: Column) -> Column:
    v = let(km / (seconds / 3600), lambda v: F.when(v <= 80, F.round(v, 1)))
    return F.when((seconds > 0) & (km > 0), v)


def month_of(date: Column) -> Column:
    return whole(F.regexp_extract(date, r"^\d{4}-(\d{2})", 1))


def race_file(key: Column, year: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(key, "[^0-9A-Za-z一-鿿]+", "-"), "^-+|-+$", "")
    return F.concat(safe, F.lit("__"), F.coalesce(year.cast("string"), F.lit("None")))


def vam(elevation_m: Column, seconds: Column) -> Column:
    """Metres climbed an hour, to the even neighbour at halves; null without elevation or time."""
    return F.when((elevation_m > 0) & (seconds > 0), F.rint(elevation_m / (seconds / 3600)))


def watts_per_kilo(vam_value: Column, grade: Column) -> Column:
    return F.when(grade != 0, F.round(vam_value / (100 * (2 + grade / 10)), 1))


def salted_id(salt: str, key: Column) -> Column:
    """A short id that can't be read back: the first ten hex digits of a salted SHA-1."""
    return F.substring(F.sha1(F.concat(F.lit(f"{salt}|"), key)), 1, 10)


def search_form(text: Column) -> Column:
    """What a search compares: no mask signs, no spaces, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?U)[{MASK}\s]", ""))


def clean_label(name: Column) -> Column:
    """A race's name without leading marks and date pieces and without trailing years."""
    s = stripped(F.coalesce(name, F.lit("")))
    for pattern in ("^[^0-9A-Za-z一-鿿]+", r"^\d{1,2}\.\d{1,2}\s*", r"^((19|20)\d{2})?\s*年\s*", r"\s*(19|20)\d{2}(\s*[/／–-]\s*(19|20)\d{2})?\s*$"):
        s = F.regexp_replace(s, pattern, "")
    s = stripped(s)
    return F.when(s == "", F.coalesce(name, F.lit(""))).otherwise(s)


def family_key(label: Column) -> Column:
    """The first two CJK characters of a label, or the label if it has fewer."""
    cjk = F.regexp_replace(label, "[^一-鿿]", "")
    return F.when(F.length(cjk) >= 2, F.substring(cjk, 1, 2)).otherwise(label)

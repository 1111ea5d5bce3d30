import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from podia.operators import athletes, coverage, identity, meetings, merge, privacy, publish, quality, races, summaries
from podia.operators.normalise import RECORD, enrich, make_records, union_sources


def records(spark, rows):
    """Rows of (dict) fields in the record schema, numbered in order."""
    fields = [f.name for f in RECORD]
    full = [{"row_ord": i, "source_ord": 0} | r for i, r in enumerate(rows)]
    return enrich(make_records(spark.createDataFrame([tuple(r.get(f) for f in fields) for r in full], RECORD)))


def row(name, rank=None, race="A", year=2024, **kw):
    return {"name_raw": name, "rank_overall": rank, "race_key": race, "race_name_canonical": race, "year": year} | kw


def keys(df):
    return {r.row_ord: r.gk for r in df.collect()}


def test_records_are_completed(spark):
    got = records(spark, [{"race_name_raw": "2023 彰化 經典百K", "name_raw": "王小明", "finish_time": "1:00:00", "category_raw": "W35"}]).first()
    assert (got.race_key, got.year, got.name_masked, got.finish_seconds, got.gender, got.age_band, got.race_class) == ("彰化經典百K", 2023, "王○明", 3600.0, "F", "30-39", "分齡")
    certified = records(spark, [{"race_name_raw": "2023雙塔520", "result_label": "市民"}]).first()
    assert (certified.series, certified.race_class) == ("TBA 長途認證", "認證")
    both = union_sources([spark.createDataFrame([("王",)], "name_raw string"), spark.createDataFrame([(3,)], "year int")])
    assert sorted((r.source_ord, r.name_raw, r.year) for r in both.collect()) == [(0, "王", None), (1, None, 3)]


def test_canonical_keys(spark):
    df = enrich(records(spark, [row("x", race="old"), row("y", race="other")]), {"old": "new"})
    assert sorted(r.race_key for r in df.collect()) == ["new", "other"]


def test_group_keys(spark):
    df = records(spark, [row("甲", uci_id="1"), row("甲"), row("乙", tsu_rider_id="7"), row("乙", uci_id="2"), row("乙"), row("丙", uci_id="3"), row("丙", uci_id="4"), row("丙"), row(None), row("黃*翔")])
    assert keys(identity.with_group_keys(df)) == {0: "u:1", 1: "u:1", 2: "t:7", 3: "u:2", 4: "t:7", 5: "u:3", 6: "u:4", 7: "n:丙", 8: "n:", 9: "s:9"}


def test_legacy_identities(spark):
    df = records(spark, [row("黃大翔", finish_seconds=100.0), row("黃*翔", finish_seconds=90.4, year=2025), row("黃*翔", finish_seconds=80.0), row("黃*翔", finish_seconds=70.0)])
    known = keys(identity.with_group_keys(df))[0]
    held = df.limit(1).select(identity.athlete_id(F.lit(known))).first()[0]
    legacy = spark.createDataFrame([("A|2025|90|黃○翔", held), ("A|2024|80|黃○翔", "feed")], "entry string, athlete_id string")
    assert keys(identity.with_group_keys(df, legacy)) == {0: "n:黃大翔", 1: "n:黃大翔", 2: "x:feed", 3: "s:3"}


def test_confidence_and_index(spark):
    rows = [row("甲", i + 1, year=2020 + i, team=f"T{i}", gender="M") for i in range(5)] + [row("乙乙乙", 1, gender="M"), row("乙乙乙", 2, year=2023, gender="F")] + [row("丙丙丙", 3, uci_id="9"), row("丙丙丙", 4), row("單", 1)]
    got = {r.nm: r for r in athletes.index(identity.with_group_keys(records(spark, rows))).collect()}
    assert {k: r.conf for k, r in got.items()} == {"甲": "low", "乙○乙": "low", "丙○丙": "high"}
    assert (got["甲"].n, got["甲"].ny, got["甲"].best, got["甲"].tm, got["丙○丙"].uci) == (5, 5, 1, "T4", True)


def test_ledger_and_rivals(spark):
    rows = [row(n, r + 1, race=f"R{i}") for i in range(6) for r, n in enumerate(("aa aa", "bb bb", "cc cc") if i % 3 else ("bb bb", "aa aa", "cc cc"))]
    keyed = identity.with_group_keys(records(spark, rows))
    led = {(r.a, r.b): (r.a_wins, r.meets) for r in athletes.ledger(keyed).collect()}
    assert led == {("n:aa aa", "n:bb bb"): (4, 6), ("n:aa aa", "n:cc cc"): (6, 6), ("n:bb bb", "n:cc cc"): (6, 6)}
    assert athletes.rivals(keyed).count() == 6


@pytest.mark.parametrize(("blocks", "at_once"), [(1, 10**6), (7, 10**6), (3, 5)])
def test_meetings_are_counted_like_a_join(spark, monkeypatch, blocks, at_once):
    """Whatever the number of tasks and stretches; a rider may have several rows in a race, and ranks may tie."""
    monkeypatch.setattr(meetings, "TASK_ROWS", 2 * 400 / blocks)
    monkeypatch.setattr(meetings, "AT_ONCE", at_once)
    rng = random.Random(5)
    rows = [(f"w{rng.randint(0, 30)}", rng.choice(["A", "A", "A", "B", "C", None]), rng.randint(1, 9)) for _ in range(400)]
    table = spark.createDataFrame(rows, "who string, race string, rank int")
    want = Counter()
    for (a, r, x), (b, s, y) in itertools.product(rows, rows):
        if r == s and a < b and x != y:
            want[a, b] += 1
            want[a, b, "won"] += x < y
    full = {(a, b, want[a, b, "won"], n) for (a, b, *won), n in want.items() if not won and n >= 4}
    assert {tuple(r) for r in meetings.pairs(table, 4).collect()} == full
    both = sorted([*full, *((b, a, n - w, n) for a, b, w, n in full)], key=lambda x: (x[0], -x[3], -x[2], x[1]))
    first = {x for i, x in enumerate(both) if sum(y[0] == x[0] for y in both[:i]) < 2}
    got = {tuple(r) for r in meetings.pairs(table, 4, top=2).collect()}
    assert first <= got <= set(both)


def test_features_and_doppelgangers(spark):
    rows = [row(f"p{p} x", p + 1, race=f"R{i}", race_name_raw="KOM" if i % 2 else "road", gender="M", age_group="35") for p in range(5) for i in range(4)]
    v = athletes.features(identity.with_group_keys(records(spark, rows))).persist()
    assert v.count() == 5 and v.filter("age <> 0").count() == 0
    near = athletes.doppelgangers(v, v.orderBy("overall").first()["id"], 2).collect()
    assert len(near) == 2 and near[0].dist <= near[1].dist


def test_copies_across_sources(spark):
    rows = [row("王小明", finish_seconds=100.2), row("王小明", finish_seconds=100.9, source_ord=1), row("王*明", finish_seconds=100.0, source_ord=2), row("李*華", finish_seconds=50.0, source_ord=1), row("李大華", finish_seconds=50.0, source_ord=2), row("王大明", finish_seconds=100.0, source_ord=3), row(None, finish_seconds=1.0), row("無時", finish_seconds=None), row("零", finish_seconds=0.0), row("零", finish_seconds=0.0, status="DNF")]
    df = merge.without_zero_times(records(spark, rows))
    assert sorted(r.row_ord for r in merge.without_copies(df).collect()) == [0, 3, 5, 6, 7, 9]


def test_cross_listed(spark):
    big = [row(f"n{i}", finish_seconds=100.0 + i, race="Big") | {"source_url": "u1"} for i in range(20)]
    copy = [row(f"n{i}", finish_seconds=100.0 + i, race="Copy") | {"source_url": "u2"} for i in range(12)]
    own = [row(f"m{i}", finish_seconds=100.0 + i, race="Own") | {"source_url": "u3"} for i in range(12)]
    df = records(spark, big + copy + own).withColumn("table_id", F.col("source_url"))
    assert [r.table_id for r in merge.cross_listed(df).collect()] == ["u2"]
    assert merge.without(df, merge.cross_listed(df)).count() == 32


def test_team_names_of_persons(spark):
    rows = [row("王大明"), row("Jane Doe", team="王大明"), row("x", team="jane  DOE"), row("y", team="狂抽猛送王大明隊"), row("z", team="Tim")]
    whole = {r.row_ord: r.team for r in merge.mask_teams(records(spark, rows)).collect()}
    assert whole == {0: None, 1: "王○明", 2: "j○ D○", 3: "狂抽猛送王大明隊", 4: "Tim"}
    within = {r.row_ord: r.team for r in merge.mask_names_within(records(spark, rows)).collect()}
    assert within[3] == "狂抽猛送王○明隊" and within[4] == "Tim"


def test_carryover(spark):
    df = records(spark, [row("甲甲甲", finish_seconds=10.0, uci_id="5"), row("甲甲甲", finish_seconds=20.0, year=2023), row("乙乙乙", finish_seconds=30.0)])
    published = spark.createDataFrame([("A|2024|10|甲○甲", "old1"), ("A|2023|20|甲○甲", "old1"), ("A|2024|30|乙○乙", "o2"), ("A|2024|30|乙○乙", "o3")], "entry string, athlete_id string")
    assert [r.old_id for r in merge.carryover(identity.with_group_keys(df), published).collect()] == ["old1"]


def test_carryover_keeps_ids_of_riders_with_hidden_rows_and_of_earlier_builds(spark):
    df = records(spark, [row("甲甲甲", finish_seconds=10.0, uci_id="5"), row("甲*", finish_seconds=20.0, year=2023), row("乙乙乙", finish_seconds=30.0, uci_id="6"), row("丙丙丙", finish_seconds=40.0)])
    published = spark.createDataFrame([("A|2024|10|甲○甲", "old1"), ("A|2023|20|甲○", "old1"), ("A|2024|30|乙○乙", "old2")], "entry string, athlete_id string")
    keyed = identity.with_group_keys(df, published.filter("athlete_id = 'old1'"))
    assert "x:old1" in {r.gk for r in keyed.collect()}
    ids = {r.name_raw: r.id for r in keyed.withColumn("id", identity.athlete_id(F.col("gk"))).collect()}
    assert {(r.new_id, r.old_id) for r in merge.carryover(keyed, published).collect()} == {(ids["甲甲甲"], "old1"), (ids["乙乙乙"], "old2")}
    before = spark.createDataFrame([(ids["丙丙丙"], "older"), (ids["乙乙乙"], "old1"), ("gone", "o9"), (ids["甲甲甲"], ids["乙乙乙"])], "new_id string, old_id string")
    assert {(r.new_id, r.old_id) for r in merge.carryover(keyed, published, before).collect()} == {(ids["丙丙丙"], "older"), (ids["乙乙乙"], "old2")}


def names(spark, *found):
    return spark.createDataFrame([(n,) for n in found], "name string")


def found_names(spark, text, known, is_json=None, allowed=None):
    df = spark.createDataFrame([(1, text, is_json)], "id int, text string, js boolean")
    return {r.key: r.hits for r in privacy.exposed_names(df, known, json_col=None if is_json is None else "js", allowed=allowed).collect()}


def test_names_in_texts(spark):
    known = names(spark, "王小明", "王明", "歐陽大明", "John  Smith", "mary jane o'neil Braß", "Single", None, "", "陳大文隊伍")
    assert found_names(spark, "隊長王小明說，王明沒來；歐陽大明也是", known) == {"王小明": 1, "歐陽大明": 1}
    assert found_names(spark, "by JOHN smith and john smith\nJohn\nSmith", known) == {"john smith": 2}
    assert found_names(spark, "Mary Jane O'Neil BRASS single", known) == {"mary jane o'neil brass": 1}
    assert found_names(spark, None, known) == found_names(spark, "x", names(spark)) == {}


def test_names_in_json_and_allowed_ones(spark):
    known = names(spark, "王小明", "John Smith")
    text = '{"a": [{"王小明": "no name"}, "see: John Smith", "John Smith", "\\u738b\\u5c0f\\u660e/x", "說王小明好"]}'
    assert found_names(spark, text, known, True) == {"王小明": 2, "john smith": 1}
    assert found_names(spark, text, known, False) == {"王小明": 2, "john smith": 2}
    sha = spark.sql("select upper(sha2('王小明', 256)) as sha")
    assert found_names(spark, text, known, True, sha) == {"john smith": 1}


def test_samples_are_the_first_rows_of_an_issue(spark):
    rows = [row("a", finish_seconds=None if i % 2 else 1000.0, finish_time=None if i % 2 else "x") for i in range(40)] + [row(None, name_masked=None)]
    df = records(spark, rows).repartition(7)
    got = {}
    for r in quality.samples(df, 3).orderBy("place").collect():
        got.setdefault(r.issue, []).append(r.row_ord)
    assert got["missing_time"] == [1, 3, 5] and len(got["missing_name"]) == 1
    assert quality.samples(df.limit(0)).count() == 0


def test_quality(spark):
    rows = [row("a", 1, finish_seconds=1000.0, finish_time="x", race_name_raw="2020 A"), row("b", 2, finish_seconds=900.0), row("c", 3, finish_seconds=10.0, finish_time="0:00:10"), row("a", 1, finish_seconds=1000.0, finish_time="x")]
    df = records(spark, rows)
    assert {r.issue: r.rows for r in quality.report(df).collect()} == {"missing_time": 1, "missing_name": 0, "missing_race": 0, "time_unparsed": 0, "time_out_of_range": 1, "year_mismatch": 1}
    assert quality.inversions(df).first().inversions == 2
    assert quality.duplicates(df).first().repeats == 1


def test_a_source_that_shrinks_keeps_its_old_rows(spark):
    build = lambda counts: records(spark, [row(f"{s}{i}", source_platform=s) for s, n in counts.items() for i in range(n)])
    old, new = build({"a": 3, "b": 2, "c": 1, None: 2}), build({"a": 2, "b": 4, "d": 1, None: 2})
    assert sorted(tuple(r) for r in quality.shrunk_sources(old, new).collect()) == [("a", 3, 2), ("c", 1, 0)]
    assert Counter(r.source_platform for r in quality.guarded(old, new).collect()) == {"a": 3, "b": 4, "c": 1, "d": 1, None: 2}


def test_difficulty_needs_two_full_years(spark):
    rows = [row(f"r{i}", finish_seconds=1000.0 + 100 * (y == 2023), year=y) for y in (2022, 2023) for i in range(20)] + [row("z", finish_seconds=1.0, year=2021)]
    got = {r.y: (r.baseline, r.median, r.coeff, r.n) for r in races.difficulty(records(spark, rows)).collect()}
    assert got == {2022: (1050, 1000, 0.9524, 20), 2023: (1050, 1100, 1.0476, 20)}
    assert {r.y: r.verdict for r in races.severity(races.difficulty(records(spark, rows))).collect()} == {2022: "偏易", 2023: "偏難"}


def test_benchmark_points(spark):
    times = [1000 + 7 * i for i in range(25)] + [1000] * 5
    rows = [row(f"r{i}", finish_seconds=float(t), age_group="35", gender="M") for i, t in enumerate(times)]
    bench = races.benchmarks(records(spark, rows)).persist()
    ordered = sorted(times)
    want = [ordered[int(round(p / 100 * 29))] for p in range(101)]
    got = {r.cohort: r.bp for r in bench.collect()}
    assert got == {"all": want, "age:30-39": want, "age:30-39|g:M": want}
    hit = races.benchmark_lookup(bench, "A", 1000, age="30-39", gender="F").first()
    assert (hit.cohort, hit.percentile_beat) == ("age:30-39", round(100 * sum(t > 1000 for t in want) / 101))


def test_dna_percentiles(spark):
    rows = [row(f"r{i} x", i + 1, race=k, finish_seconds=1000.0 + i * s, gender="F" if i % 4 == 0 else "M") for k, s, n in (("A", 1, 20), ("B", 5, 30), ("C", 9, 40)) for i in range(n)]
    got = {r.rk: (r.n, r.sel, r.size, r.climb, r.prest) for r in races.dna(identity.with_group_keys(records(spark, rows))).collect()}
    assert got == {"A": (20, 0, 0, 50, 100), "B": (30, 50, 50, 50, 50), "C": (40, 100, 100, 50, 0)}


def test_open_dataset_shows_no_name(spark):
    df = records(spark, [row("王小明", splits=["1", "2"]), row("x", name_masked="Real Name")])
    out = publish.open_dataset(df)
    assert out.columns == publish.PUBLISHED
    assert [(r.name_masked, r.splits) for r in out.orderBy("splits").collect()] == [(None, None), ("王○明", '["1","2"]')]


def test_merge_candidates(spark):
    names = ["第3屆 彰化經典百K", "第4屆 彰化經典百K", "環台賽東部段", "環台賽西部段", "甲地挑戰組公路", "甲地公路賽道挑戰組", "獨一"]
    df = records(spark, [row("n", race=f"k{i}", race_name_canonical=n) for i, n in enumerate(names)])
    got = {r.verdict: r for r in coverage.merge_candidates(df).collect()}
    assert [(m.rk, m.name, m.rows, m.years) for m in got["SAFE"].members] == [("k0", "第3屆 彰化經典百K", 1, [2024]), ("k1", "第4屆 彰化經典百K", 1, [2024])]
    assert len(got["SAFE"].safe_cores) == 1 and len(got["REJECT"].members) == len(got["REJECT"].safe_cores) == 2 and got["REJECT"].total_rows == 2


def test_gaps_and_board(spark):
    df = records(spark, [row("n", race_name_canonical="彰化經典", year=2023), row("n", race_name_canonical="花東縱谷", year=2024)])
    cal = spark.createDataFrame([("彰化經典百K", "2024-05-01"), ("花東縱谷", "2024-06-01"), ("完全陌生賽", "2024-07-01")], "race string, date string")
    got = {r.race: r.status for r in coverage.gaps(cal, df, "2024-12-01").collect()}
    assert got == {"彰化經典百K": "NOT_INGESTED", "完全陌生賽": "UNKNOWN"}
    gaps = spark.createDataFrame([("x", "2024-03-01", "NOT_HELD"), ("y", "2025-01-01", "NOT_HELD"), ("z", "2024-12-30", "NOT_INGESTED"), ("w", "2024-02-01", "NO_RANKING")], "race string, date string, status string")
    board = {r.name: r.status for r in coverage.season_board(races.index(df), gaps, 2024, "2024-12-01").collect()}
    assert board == {"花東縱谷": "ok", "x": "wait", "z": "soon"}


def test_overlapping_names_are_all_found(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("天地玄黃宇宙洪荒日月盈昃") for _ in range(rng.randint(1, 7))) + rng.choice(["賽", "公路賽", ""]) for _ in range(160)] + ["賽", "賽", "", "天賽"]
    a, b = names[:80], names[80:]

    def score(c, k):
        return 0 if not c or not k else 1.0 if c in k or k in c else len(set(c) & set(k)) / min(len(set(c)), len(set(k)))

    left, right = spark.createDataFrame([(x, i % 2) for i, x in enumerate(a)], "c string, year int"), spark.createDataFrame([(x, i % 2) for i, x in enumerate(b)], "k string, year int")
    for least in (0.6, 1.0, 0.25):
        want = {(c, k) for c in a for k in b if score(c, k) >= least}
        got = coverage.overlapping(left, right, least).collect()
        assert {(r.c, r.k) for r in got} == want and len(got) == len(want)
    want = {(i % 2, c, k) for i, c in enumerate(a) for j, k in enumerate(b) if i % 2 == j % 2 and score(c, k) >= 0.6}
    assert {(r.year, r.c, r.k) for r in coverage.overlapping(left, right, 0.6, ["year"]).collect()} == want
    assert coverage.overlapping(left.limit(0), right, 0.6).count() == 0


def test_names_are_compared_without_editions(spark):
    df = spark.createDataFrame([("第12屆 武嶺登山賽 100K挑戰組",), ("2026 武嶺登山賽",), (None,)], "n string")
    assert [r.c for r in df.select(coverage.core(F.col("n")).alias("c")).collect()] == ["武嶺登山賽", "武嶺登山賽", ""]


VERDICTS = [("環島", "NOT_HELD", "off"), ("團騎", "NO_RANKING", "a ride"), ("已收", "COLLECTED", ""), ("古道", "BLOCKED", "closed site")]


def test_triage_and_board(spark):
    gaps = [("環島賽", "2024-12-20", "UNKNOWN"), ("海線團騎", "2024-03-01", "NOT_INGESTED"), ("山線團騎", "2024-04-01", "UNKNOWN"), ("已收賽", "2024-05-01", "UNKNOWN"), ("古道賽", "2024-06-01", "NOT_INGESTED"), ("新賽", "2024-07-01", "UNKNOWN")]
    told = coverage.triaged(spark.createDataFrame(gaps, "race string, date string, status string"), VERDICTS)
    assert {r.race: (r.status, r.note) for r in told.collect()} == {"環島賽": ("NOT_HELD", "off"), "山線團騎": ("NO_RANKING", "a ride"), "古道賽": ("BLOCKED", "closed site"), "新賽": ("UNKNOWN", None)}
    board = coverage.season_board(races.index(records(spark, [row("n", date="2024-02-01")])), told, 2024, "2024-12-01")
    assert {r.name: r.status for r in board.collect()} == {"A": "ok", "環島賽": "soon", "古道賽": "miss"}
    assert [r.status for r in told.select(coverage.triage(F.lit(None).cast("string"), VERDICTS).alias("v")).select("v.*").collect()] == [None] * 4


def test_known_races_are_done_left_or_open(spark):
    rows = records(spark, [row("n", race_name_canonical="俱樂部聯賽第二站", year=2023), row("n", race_name_canonical=None, year=2023)])
    known = [("俱樂部聯賽", 2023, "BLOCKED"), ("俱樂部聯賽", 2022, "BLOCKED"), ("俱樂部聯賽第二站決賽", 2023, "EXCLUDED"), ("海岸賽", 2024, "BLOCKED"), ("海岸賽", 2021, "BLOCKED"), ("無年", None, "BLOCKED")]
    known = spark.createDataFrame(known, "race string, year long, status string")
    seen = spark.createDataFrame([("海岸賽",)], "c string")
    got = {(r.race, r.year): r.done for r in coverage.known_races(known, rows, seen, 2024).collect()}
    assert got == {("俱樂部聯賽", 2023): True, ("俱樂部聯賽", 2022): False, ("俱樂部聯賽第二站決賽", 2023): False, ("海岸賽", 2021): False, ("無年", None): False}
    assert coverage.known_races(known.limit(0), rows, seen, 2024).count() == 0


def test_gaps_of_failed_calendars_stay(spark):
    before = [("環島賽", "a", "UNKNOWN", "old"), ("已收賽", "a", "UNKNOWN", "old"), ("新賽", "a", "UNKNOWN", "old"), ("別賽", "b", "UNKNOWN", "old")]
    kept = coverage.carry_forward(spark.createDataFrame(before, "race string, calendar string, status string, note string"), ["a"], VERDICTS)
    assert {r.race: (r.status, r.note, r.stale) for r in kept.collect()} == {"環島賽": ("NOT_HELD", "off", True), "新賽": (None, None, True)}


def test_race_summary(spark):
    field = lambda year, label, n, t, **kw: [row(f"{label}{i}", year=year, result_label=label, finish_seconds=t + i, **kw) for i in range(n)]
    rows = field(2022, "long", 31, 1000.0) + field(2024, "long", 40, 1100.0) + field(2024, "short", 35, 500.0) + [row("x", year=2024, status="DNF"), row("y", year=2024, status="FIN"), row("z", year=2023, status="DNS")]
    got = {r.y: r for r in summaries.race_summaries(records(spark, rows)).collect()}
    assert tuple(got[2024])[2:] == (75, "long", 40, 1119.5, 1100.0, 50, "long", 2022, 105, 10.3)
    assert tuple(got[2022])[2:] == (31, None, 31, 1015.0, 1000.0, None, None, None, None, None)
    assert tuple(got[2023])[2:] == (0, None, 0, None, None, 0, None, None, None, None)


@pytest.mark.parametrize("n,t,told", [(29, 1000.0, False), (30, 1000.0, True), (30, 1300.0, False), (61, 1000.0, False), (60, 1000.0, True)])
def test_changes_are_guarded(spark, n, t, told):
    points = spark.createDataFrame([("A", "l", 2020, 1000, 30), ("A", "l", 2021, int(t), n)], "rk string, label string, y long, median long, n long")
    assert summaries.changes(points).count() == int(told)


def test_trends_summary(spark):
    def year(y, women, young):
        return [(y, "F" if i < women else "M", "19-29" if i < young else "40-49") for i in range(40)]

    view = spark.createDataFrame(year(2020, 10, 30) + year(2021, 0, 0)[:5] + year(2022, 20, 10) + year(2023, 40, 40), "y long, g string, ag string")
    got = {r.what: tuple(r)[1:] for r in summaries.trends_summary(view, 2023).collect()}
    assert got == {"women": (None, 2020, 2022, 25, 50), "age_up": ("40-49", 2020, 2022, 25, 75), "age_down": ("19-29", 2020, 2022, 75, 25), "age_top": ("40-49", 2020, 2022, 25, 75)}
    assert summaries.trends_summary(view.filter("y = 2020"), 2023).count() == 0
    assert summaries.trends_summary(view.limit(0), 2023).count() == 0


@pytest.mark.parametrize("empty_of", ["index", "crossyear", "difficulty", "benchmarks", "slim"])
def test_no_rows(spark, empty_of):
    assert getattr(races, empty_of)(records(spark, [row("a")]).limit(0)).count() == 0

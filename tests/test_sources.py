import json
import os
import shutil

from podia.operators.merge import without_copies, without_zero_times
from podia.operators.normalise import RECORD, enrich, make_records
from podia.sources import readers
from podia.streaming import ingest


def test_json_csv_parquet(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"name": "王小明", "year": 2024, "junk": 1, "splits": ["1"]}, {"name": None}]), encoding="utf-8")
    rows = readers.read_results(spark, str(tmp_path / "a.json"), "json", {"name": "name_raw"}, multiLine=True)
    assert rows.columns == [f.name for f in RECORD]
    assert sorted(((r.name_masked, r.year, r.splits) for r in rows.collect()), key=str) == [("王○明", 2024, ["1"]), (None, None, None)]
    rows.write.parquet(str(tmp_path / "p"))
    assert readers.read_results(spark, str(tmp_path / "p"), "parquet").count() == 2
    (tmp_path / "c.csv").write_text(",".join(f.name for f in RECORD) + "\n" + ",".join("7" if f.name == "year" else "x" if f.name == "name_raw" else "" for f in RECORD) + "\n", encoding="utf-8")
    assert [(r.year, r.name_raw) for r in readers.read_results(spark, str(tmp_path / "c.csv"), "csv", header=True).collect()] == [(7, "x")]


ODD = ['a "quoted" } brace', "{[}]", "back\\\\slash\\\\", "tab\\t,", "},{", "]", "\\u007d", ""]


def test_large_arrays_are_read_by_many_tasks(spark, tmp_path):
    rows = [{"name_raw": ODD[i % len(ODD)] + str(i), "year": i, "splits": ["}", "x"] if i % 3 else [], "junk": {"deep": [{"a": ODD[i % 5]}, {}]}} for i in range(3000)]
    (tmp_path / "a").mkdir()
    for name, part, indent in (("1.json", rows[:2500], None), ("2.json", rows[2500:], 2), ("3.json", [], None), ("4.json", [{}], None)):
        (tmp_path / "a" / name).write_text(json.dumps(part, ensure_ascii=name == "1.json", indent=indent), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = readers.json_array_records(spark, str(tmp_path / "a"))
        assert spark.read.text(str(tmp_path / "a" / "1.json")).rdd.getNumPartitions() > 20
        got = sorted(((r.path.rsplit("/", 1)[1], r.place, json.loads(r.record)) for r in found.collect()), key=lambda x: x[:2])
        records = readers.read_results(spark, str(tmp_path / "a"), "json_array").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [x[2] for x in got] == [*rows, {}]
    assert [x[1] for x in got if x[0] == "2.json"] == list(range(500))
    in_order = sorted(records, key=lambda r: (r.source_ord, r.row_ord))
    assert [(r.name_raw, r.year, r.splits) for r in in_order if r.source_ord < 2] == [(r["name_raw"], r["year"], r["splits"]) for r in rows]
    assert [(r.source_ord, r.row_ord) for r in in_order[-1:]] == [(2, 0)]


def _result(name, seconds, year=2026, source=0, order=0, **kw):
    return {"name_raw": name, "finish_seconds": seconds, "year": year, "date": f"{year}-03-01", "race_key": "A", "source_ord": source, "row_ord": order} | kw


FILES = [
    [_result("王小明", 3600.0, order=0), _result(None, None, order=1, status="DNF"), _result(None, None, order=2, status="DNF"), _result("李*", 4000.0, order=3)],
    [_result("王小明", 3600.4, 2026, 1), _result("陳大文", 3700.0, 2015, 1, 1), _result("陳大文", 3700.0, 2015, 1, 2), _result("李四", 4000.0, 2026, 1, 3), _result("林", 0.0, 2026, 1, 4)],
    [_result("王○", None, 2015, 2, 0, status="DNS"), _result("王*明", 3600.0, 2026, 2, 1), _result("陳大文", 3700.9, 2015, 2, 2), _result("陳大文", 3701.0, 2015, 2, 3)],
]


def test_ingest_equals_the_batch_merge(spark, tmp_path):
    """An old season that comes late stays, so do rows without a name or a time; copies go as they do in the batch."""
    src, out, point = (str(tmp_path / n) for n in ("in", "out", "point"))
    os.makedirs(src)
    for i, rows in enumerate(FILES):
        with open(f"{src}/{i}.json", "w", encoding="utf-8") as f:
            f.write("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
        ingest.ingest(spark, src, out, point).awaitTermination()
    got = sorted((r.source_ord, r.row_ord) for r in ingest.read_ingested(spark, out).collect())
    every = enrich(make_records(without_zero_times(spark.read.schema(RECORD).json(src))))
    assert got == sorted((r.source_ord, r.row_ord) for r in without_copies(every).collect())
    assert {(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (2, 0), (2, 3)} == set(got)
    ingest.ingest(spark, src, out, point).awaitTermination()
    assert ingest.read_ingested(spark, out).count() == len(got)
    again = spark.read.parquet(f"{out}/batch=2").count()
    third = enrich(make_records(spark.read.schema(RECORD).json(f"{src}/2.json")))
    parts = [r.part for r in ingest.checked(third).select(ingest.key_part().alias("part")).distinct().collect()]
    known = ingest.known_keys(spark, out, parts, 2)
    assert ingest.without_known(third, known).count() == again
    opened = {f.split("part=")[1].split("/")[0] for f in known.inputFiles()}
    assert opened <= set(parts) and len(opened) < len(os.listdir(f"{out}_keys"))
    assert ingest.known_keys(spark, out, ["1900-3"], 9).count() == ingest.known_keys(spark, out, parts, 0).count() == 0


def test_a_batch_that_failed_half_way_is_taken_again(spark, tmp_path):
    """The results of a batch are lost after its keys were written: run again, it finds them new."""
    src, out, point = (str(tmp_path / n) for n in ("in", "out", "point"))
    os.makedirs(src)
    rows = [_result("王小明", 3600.0 + i, order=i) for i in range(40)]
    for i, part in enumerate((rows[:25], rows[15:])):
        with open(f"{src}/{i}.json", "w", encoding="utf-8") as f:
            f.write("\n".join(json.dumps(r, ensure_ascii=False) for r in part))
        ingest.ingest(spark, src, out, point).awaitTermination()
    assert ingest.read_ingested(spark, out).count() == 40
    shutil.rmtree(f"{out}/batch=1")
    os.remove(f"{point}/commits/1")
    if os.path.exists(f"{point}/commits/.1.crc"):
        os.remove(f"{point}/commits/.1.crc")
    ingest.ingest(spark, src, out, point).awaitTermination()
    assert ingest.read_ingested(spark, out).filter("batch = 1").count() == 15
    assert ingest.read_ingested(spark, out).count() == 40


def test_incremental_ingest(spark, tmp_path):
    src, out, point = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    line = lambda **kw: json.dumps({"name_raw": "王小明", "year": 2024, "date": "2024-05-01", "race_key": "A", "finish_seconds": 10.0} | kw) + "\n"
    (tmp_path / "in" / "1.json").write_text(line() + line() + line(finish_seconds=0.0) + line(finish_seconds=11.0), encoding="utf-8")
    ingest.ingest(spark, src, out, point).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    (tmp_path / "in" / "2.json").write_text(line() + line(year=2025, date="2025-05-01"), encoding="utf-8")
    ingest.ingest(spark, src, out, point).awaitTermination()
    assert spark.read.parquet(out).count() == 3

import os

from pyspark.sql import functions as F

from podia.operators import increment, races

from .test_operators import records, row


def builds(spark):
    old = [row(f"a{i}", i + 1, race=k, year=y, finish_seconds=1000.0 + i, gender="F" if i % 3 else "M") for k in ("A", "B/x y") for y in (2022, 2023, None) for i in range(12)]
    old = [r | {"row_ord": i} for i, r in enumerate(old)]
    new = [r for r in old if not (r["race_key"] == "A" and r["year"] == 2022)]
    new = [r | {"finish_seconds": r["finish_seconds"] + 5} if r["race_key"] == "B/x y" and r["year"] is None and r["rank_overall"] == 3 else r for r in new]
    new += [row("late", 1, race="C", year=2024, finish_seconds=500.0, row_ord=999)]
    return records(spark, old), records(spark, new)


def plain(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)


def test_changed_race_years(spark):
    old, new = builds(spark)
    got = {(r.race_key, r.year): r.state for r in increment.changed_race_years(increment.digests(old), increment.digests(new)).collect()}
    assert got == {("A", 2022): "missing", ("B/x y", None): "changed", ("C", 2024): "added"}
    assert increment.changed_race_years(increment.digests(old), increment.digests(old.repartition(5))).count() == 0
    twice = old.unionByName(old.limit(2))
    assert increment.changed_race_years(increment.digests(old), increment.digests(twice)).count() > 0


def test_touched_race_years_alone_are_rewritten(spark, tmp_path):
    old, new = builds(spark)
    everything = old.select("race_key", "year").distinct()
    changed = increment.changed_race_years(increment.digests(old), increment.digests(new)).persist()
    for name, product in {"board": races.leaderboard, "slim": races.slim, "states": lambda r: increment.states(races.slim(r))}.items():
        path = str(tmp_path / name)
        increment.refresh(product, old, everything, path)
        assert plain(increment.read_product(spark, path)) == plain(product(old))
        files = {p: os.stat(os.path.join(p, f)).st_mtime_ns for p, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
        assert increment.refresh(product, new, changed, path) == 3
        assert plain(increment.read_product(spark, path)) == plain(product(new))
        after = {p: os.stat(os.path.join(p, f)).st_mtime_ns for p, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
        assert sum(after.get(p) == t for p, t in files.items()) == len(files) - 2
        assert increment.refresh(product, new, changed.limit(0), path) == 0
    sums = increment.counts(increment.read_product(spark, str(tmp_path / "states")), ["y", "g"])
    full = races.slim(new).groupBy("y", "g").agg(F.count("*").alias("n"), F.round(F.avg("t"), 6).alias("mean"))
    assert plain(sums) == plain(full)

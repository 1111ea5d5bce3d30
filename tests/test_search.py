import pytest

from podia.operators import athletes, search

NAMES = ["王○明", "王○華", "J○ S○", "jo○n smith", "○", None, "abcd ○", "陳○", "Ann○ Lee", "ann", "lee", "ab cd"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rows = [(f"{i * 40503 % 65536:04x}{i:06x}", NAMES[i % len(NAMES)], i % 7, i % 3, i % 5 or None, "tm") for i in range(400)]
    df = spark.createDataFrame(rows, "id string, nm string, n long, ny long, best long, tm string")
    path = str(tmp_path_factory.mktemp("search") / "index")
    search.write_index(df, path)
    return df, path


@pytest.mark.parametrize("query", ["王", "王明", "ann", "ANN lee", "annl", "○", "", "  ", "nobody", "陳", "abcd", "9e37", "0000", "00000000", "annlex", "smith", "j○ s"])
def test_the_index_answers_like_the_scan(spark, index, query):
    df, path = index
    want = [tuple(r) for r in athletes.search(df, query).collect()]
    got = search.lookup(spark, path, query)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == want


def test_only_some_buckets_are_opened(spark, index):
    _, path = index
    opened = search._opened(spark, f"{path}/lists", search.LISTS, ["ann"])
    assert len({r.bucket for r in opened.select("bucket").distinct().collect()}) == 1
    assert "PartitionFilters: [isnotnull(bucket" in opened._jdf.queryExecution().toString()


def test_an_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], "id string, nm string, n long, ny long, best long, tm string")
    search.write_index(df, str(tmp_path / "i"))
    assert search.lookup(spark, str(tmp_path / "i"), "a").count() == 0

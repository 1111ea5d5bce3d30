"""A written index for athlete search: a lookup opens only the buckets of its own characters and hits."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podia.functions import text as X
from podia.operators.athletes import search

#: Characters of the longest stretch of a name, and of an id's start, under which it is listed.
LONGEST, ID_START = 3, 4
BUCKETS = 256


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _stretches(form: Column) -> Column:
    """The different stretches of one to LONGEST characters of a name."""
    empty = F.array().cast("array<string>")

    def of(n: int) -> Column:
        return F.when(F.length(form) >= n, F.transform(F.sequence(F.lit(1), F.length(form) - n + 1), lambda i: F.substring(form, i, F.lit(n)))).otherwise(empty)

    return F.array_distinct(F.concat(*[of(n) for n in range(1, LONGEST + 1)]))


def write_index(athletes: DataFrame, path: str) -> None:
    """Write an athletes' index for lookups: under path/rows the athletes by id, under path/lists who has a stretch of
    characters or an id that starts so, under path/counts how many each list has; all in buckets.

    A list in a bucket is dealt to several files, so that no common character is one task's work. A null name is empty;
    an empty index answers with nothing.
    """
    athletes.sparkSession.createDataFrame([(athletes.schema.json(),)], "value string").write.mode("overwrite").text(f"{path}/schema")
    form = F.coalesce(X.search_form(F.col("nm")), F.lit(""))
    listed = athletes.select("id", F.col("n").cast("long"), F.col("ny").cast("long"), F.col("best").cast("long"), form.alias("form"), F.explode(F.concat(_stretches(form), F.array(F.concat(F.lit("#"), F.substring("id", 1, ID_START))))).alias("key"))
    lists = listed.withColumn("bucket", _bucket(F.col("key")))
    lists.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(4))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/lists")
    counts = listed.groupBy("key").agg(F.count("*").alias("size")).withColumn("bucket", _bucket(F.col("key")))
    counts.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/counts")
    rows = athletes.withColumn("bucket", _bucket(F.col("id")))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")


LISTS = "id string, n long, ny long, best long, form string, key string, bucket int"
COUNTS = "key string, size long, bucket int"


def _rows_schema(spark: SparkSession, path: str) -> T.StructType:
    found = T.StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()[0]))
    return T.StructType([*found.fields, T.StructField("bucket", T.IntegerType())])


def _opened(spark: SparkSession, path: str, schema: str | T.StructType, keys: list[str]) -> DataFrame:
    """The rows of the buckets that these keys fall into: the folders that Spark reads."""
    buckets = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(_bucket(F.col("k"))).distinct().collect()]
    return spark.read.schema(schema).parquet(path).filter(F.col("bucket").isin(buckets))


def lookup(spark: SparkSession, path: str, query: str, limit: int = 20) -> DataFrame:
    """The answer of athletes.search() from a written index.

    Of the query's stretches the one with the shortest list is looked through,
    and every name in it is checked; an id's start has a list of its own. Only the hits, `limit` at
    most, are then fetched whole. A query of nothing but spaces asks for all athletes, and reads them.
    """
    form = "".join(query.replace(X.MASK, "").split()).lower()
    if not form:
        return search(spark.read.schema(_rows_schema(spark, path)).parquet(f"{path}/rows").drop("bucket"), query, limit)
    size = min(LONGEST, len(form))
    keys = sorted({form[i : i + size] for i in range(len(form) - size + 1)})
    known = _opened(spark, f"{path}/counts", COUNTS, keys).filter(F.col("key").isin(keys)).select("key", "size").collect()
    best = min(((r["size"], r["key"]) for r in known), default=None) if len(known) == len(keys) else None
    by_id = len(form) >= ID_START and all(c in "0123456789abcdef" for c in form)
    wanted = [best[1]] if best else []
    start = "#" + form[:ID_START] if by_id else None
    lists = _opened(spark, f"{path}/lists", LISTS, [*wanted, *([start] if start else [])])
    named = F.col("key").isin(wanted) & F.col("form").contains(form)
    met = lists.filter(named | ((F.col("key") == start) & F.col("id").startswith(form)) if start else named)
    order = [F.desc("n"), F.desc("ny"), F.coalesce("best", F.lit(9999)), "id"]
    hits = [r["id"] for r in met.select("id", "n", "ny", "best").distinct().orderBy(*order).limit(limit).collect()]
    return _opened(spark, f"{path}/rows", _rows_schema(spark, path), hits).filter(F.col("id").isin(hits)).drop("bucket").orderBy(*order)

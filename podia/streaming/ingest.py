"""New source files as they arrive: an incremental, resumable merge that holds each batch against the keys it may meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from podia.functions import text as X
from podia.operators.merge import without_copies, without_zero_times
from podia.operators.normalise import RECORD, enrich, make_records

#: The rank of what is written already among the sources: before all others.
WRITTEN = -1
#: Parts of a year's keys. A batch opens only the parts that its own keys fall into.
BUCKETS = 64
KEYS = "year long, name_raw string, finish_seconds double, source_ord long, row_ord long, number long"


def new_records(spark: SparkSession, path: str) -> DataFrame:
    """A stream of normalised records from JSON-lines files under path, timeless rows dropped, with their `race_day`."""
    raw = spark.readStream.schema(RECORD).json(path)
    first_of_year = F.make_timestamp(F.coalesce("year", F.lit(1970)).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return enrich(make_records(without_zero_times(raw))).withColumn("race_day", F.coalesce(F.try_to_timestamp(F.substring("date", 1, 10)), first_of_year))


def checked(rows: DataFrame) -> DataFrame:
    """The rows that may have copies: those with a name and a time."""
    return rows.filter(~X.blank(F.col("name_raw")) & F.coalesce(F.col("finish_seconds") != 0, F.lit(False)))


def key_part() -> Column:
    """The part of the key index that a row's key belongs to: rows that may be copies of each other share it."""
    bucket = F.pmod(F.xxhash64(X.mask_name(F.col("name_raw")), F.floor("finish_seconds")), F.lit(BUCKETS))
    return F.concat_ws("-", F.coalesce(F.col("year").cast("string"), F.lit("none")), bucket.cast("string"))


def known_keys(spark: SparkSession, out: str, parts: list[str], before: int) -> DataFrame:
    """The keys in these parts of the index beside out that batches before that one have written; other parts aren't even listed."""
    folders = [f"{out}_keys/part={p}" for p in sorted(parts)]
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    there = [f for f in folders if path(f).getFileSystem(conf).exists(path(f))]
    if not there:
        return spark.createDataFrame([], KEYS)
    return spark.read.schema(KEYS).parquet(*there).filter(F.col("number") < before)


def without_known(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """rows without copies of each other or of known keys, by the rules of the batch merge: all that is known came before."""
    if known is None:
        return without_copies(rows)
    before = {"source_ord": F.lit(WRITTEN).cast("long")} | {f.name: F.lit(None).cast(f.dataType) for f in rows.schema if f.name not in known.columns}
    keys = checked(rows).select("year", X.mask_name(F.col("name_raw")).alias("m"), F.floor("finish_seconds").alias("s")).distinct().withColumnRenamed("year", "y")
    near = F.col("year").eqNullSafe(F.col("y")) & (X.mask_name(F.col("name_raw")) == F.col("m")) & (F.floor("finish_seconds") == F.col("s"))
    met = known.join(keys, near, "left_semi").withColumns(before)
    return without_copies(rows.unionByName(met.select(rows.columns))).filter(F.col("source_ord") != WRITTEN)


def ingest(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Take in the files that are there now and stop; run again for the next.

    Each batch is held against the keys written before, however old a season is, so
    nothing is dropped for being late and rows without a name or a time stay,
    as in the batch merge. Of the key index (out_keys: year, name and time of
    what was written, in parts by year and hash) a batch reads only the parts that its own
    keys fall into, never the results. They are written under out/batch=N by year; a batch
    that is run again after a failure replaces its own folder, so every result
    is there exactly once, and passes over the keys that it wrote itself.
    """

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        order = {"source_ord": F.coalesce("source_ord", F.lit(0).cast("long")), "row_ord": F.coalesce("row_ord", F.monotonically_increasing_id())}
        staged = f"{checkpoint}/staged"  # numbered once, so that every later read sees the same rows
        batch.withColumns(order).write.mode("overwrite").parquet(staged)
        rows = session.read.schema(batch.schema).parquet(staged)
        parts = [r.part for r in checked(rows).select(key_part().alias("part")).distinct().collect()]
        folder = f"{out}/batch={number}"
        without_known(rows, known_keys(session, out, parts, number)).write.mode("overwrite").partitionBy("year").parquet(folder)
        kept = session.read.schema(batch.schema).parquet(folder)
        keys = checked(kept).select("year", "name_raw", "finish_seconds", "source_ord", "row_ord", F.lit(number).cast("long").alias("number"), key_part().alias("part"))
        keys.repartition("part").write.mode("append").partitionBy("part").parquet(f"{out}_keys")

    return new_records(spark, path).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(take).start()


def read_ingested(spark: SparkSession, out: str, schema: T.StructType | None = None, before: int | None = None) -> DataFrame:
    """What ingest() has written; with before, by the batches before that one."""
    reader = spark.read if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    rows = reader.parquet(out)
    return rows if before is None else rows.filter(F.col("batch") < before)


def finishers_by_month(rows: DataFrame) -> DataFrame:
    """Running counts of results by race and month of a stream of new_records()."""
    return rows.groupBy(F.window("race_day", "30 days").alias("w"), "race_key").agg(F.count("*").alias("n")).select(F.col("w.start").alias("since"), "race_key", "n")

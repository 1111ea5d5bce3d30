"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, in the folder that spark.checkpoint.dir names.

    Only a local master, which has no other machine, may leave it unset (tests,
    a laptop): there a temporary folder is made. Elsewhere that is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    base = conf or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = tempfile.mkdtemp(prefix="podia-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tables that materialise() has written in this session: the path, and a weak reference to what plans read it through.
_written: list[tuple[str, Any]] = []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    relation = table._jdf.queryExecution().analyzed().collectLeaves().head().relation()
    _written.append((path, df.sparkSession._jvm.java.lang.ref.WeakReference(relation)))
    return table


def sweep(spark: SparkSession) -> None:
    """Delete the tables of materialise() that nothing reads any more.

    Every plan over such a table, cached ones too, holds the relation that the
    table was read as; a table goes when the JVM has collected that relation, and
    so never while a DataFrame that needs it can still be used.
    """
    gc.collect()
    spark._jvm.java.lang.System.gc()
    conf = spark._jsc.hadoopConfiguration()
    for item in [x for x in _written if x[1].get() is None]:
        where = spark._jvm.org.apache.hadoop.fs.Path(item[0])
        where.getFileSystem(conf).delete(where, True)
        _written.remove(item)


#: Names of the columns of numbered(): what tells rows apart, whatever their ids, and the row itself.
ROW, WHOLE = "row_number", "whole"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """(ROW, WHOLE): each row of df as a struct, so that its columns' names clash with none, and a number of its own, written once so that every later read sees the same."""
    return materialise(df.select(F.monotonically_increasing_id().alias(ROW), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(WHOLE)), name)


def of_whole(col: str) -> Column:
    """A column of the row in WHOLE."""
    return F.col(WHOLE).getField(col)


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids that are broadcast at most (some 64 MB as a hash table); more are met by a shuffle.
MAX_BROADCAST_IDS = 1_000_000


#: Text that a Python worker gets at once, or one row that has more.
BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Have Arrow batches bounded by BATCH_BYTES, so that a worker's memory doesn't hang on how long 10,000 texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def few(ids: DataFrame, name: str) -> DataFrame:
    """A table of ids, written and counted; marked for broadcast if there are MAX_BROADCAST_IDS of them at most.

    So texts needn't be shuffled to meet a few ids, and many ids are never broadcast.
    """
    ids = materialise(ids, name)
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def one_of_each(rows: DataFrame, named: DataFrame) -> DataFrame:
    """The rows in WHOLE of numbered rows, with just one of each group of named (ROW, group, id): one with the smallest non-null id.

    Rows that named doesn't hold stay.
    """
    first = named.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", ROW)).alias("first"))
    gone = named.join(first, "group").filter(F.col(ROW) != F.col(f"first.{ROW}")).select(ROW)
    return rows.join(few(gone, "copies"), ROW, "left_anti").select(f"{WHOLE}.*")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def same(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    """Equality of the named columns in which null equals null."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def words_of(data: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of UTF-8 bytes; bytes.split() takes just these six as white space."""
    return data.split()


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def hex_text(col: Column) -> Column:
    return F.lower(F.hex(col))

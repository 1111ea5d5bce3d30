"""Sources of results as files: JSON lines and arrays, CSV, Parquet and ORC, all as records of one schema."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podia.operators.normalise import RECORD, make_records

FORMATS = ("json", "json_array", "csv", "parquet", "orc")


def read_results(spark: SparkSession, path: str, fmt: str = "json", renames: dict[str, str] | None = None, **options) -> DataFrame:
    """Files of one source as records; renames maps the source's columns to the record's.

    json has an object a line; json_array one array of objects a file, however
    large, see json_array_records(). The schema is given, never inferred; columns of the source that are no field
    of a record are dropped at the scan. Of arrays, source_ord and row_ord are the
    places of file and record, unless the source has them.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = spark.read.options(**options)
    if fmt in ("json", "csv"):
        back = {v: k for k, v in (renames or {}).items()}
        fields = ", ".join(f"`{back.get(f.name, f.name)}` {'string' if fmt == 'csv' else f.dataType.simpleString()}" for f in RECORD)
        rows = reader.schema(fields).format(fmt).load(path)
    elif fmt == "json_array":
        back = {v: k for k, v in (renames or {}).items()}
        fields = ", ".join(f"`{back.get(f.name, f.name)}` {f.dataType.simpleString()}" for f in RECORD)
        found = json_array_records(spark, path).withColumn("r", F.from_json("record", fields))
        places = {"row_ord": F.col("place"), "source_ord": (F.dense_rank().over(Window.orderBy("path")) - 1).cast("long")}
        files = found.select("path").distinct().withColumn("source", places.pop("source_ord"))
        own = {f.name: F.col(f"r.`{back.get(f.name, f.name)}`") for f in RECORD}
        own |= {"row_ord": F.coalesce(own["row_ord"], places["row_ord"]), "source_ord": F.coalesce(own["source_ord"], F.col("source"))}
        return make_records(found.join(F.broadcast(files), "path").select(*[c.alias(n) for n, c in own.items()]))
    else:
        rows = reader.format(fmt).load(path)
    if fmt == "csv":
        rows = rows.withColumn("splits", F.from_json("splits", "array<string>"))
    return make_records(rows.withColumnsRenamed(renames or {}))


def _outside(piece: Column) -> Column:
    """A piece of JSON without its strings; it starts outside of one."""
    return F.regexp_replace(piece, '"[^"]*("|$)', "")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def json_array_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, record): the objects of JSON arrays, one array a file, each as text with its place in the array.

    Spark's text reader cuts files at `}`, so that any number of tasks read stretches of a large
    file without having seen what stands before. Whether a piece starts within a
    string is the parity of the quotes before it, and how deep it ends is what braces and brackets
    outside strings add up to: both are running sums, first of stretches, then of
    the pieces in each. An object of the array ends where the depth is that of the array
    again; its pieces are joined by their number. Escaped characters never
    stand at a cut. A file that is no array of objects gives no records, or broken ones.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"))
    pieces = raw.withColumn("bare", F.regexp_replace("piece", r"(?s)\\.", "")).withColumn("quotes", _count(F.col("bare"), '"').cast("long"))

    def before(rows: DataFrame, value: str, name: str) -> DataFrame:
        """rows with the sum of value over all earlier pieces of the file."""
        stretches = rows.groupBy("path", "start").agg(F.sum(value).alias("own"))
        earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        stretches = stretches.select("path", "start", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("base"))
        within = Window.partitionBy("path", "start").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0))).join(stretches, ["path", "start"]).withColumn(name, F.col(name) + F.col("base")).drop("base")

    pieces = before(pieces, "quotes", "quoted")
    inside = F.col("quoted") % 2 == 1
    marks = _outside(F.when(inside, F.concat(F.lit('"'), "bare")).otherwise(F.col("bare")))
    closes = ((F.col("quoted") + F.col("quotes")) % 2 == 0).cast("long")  # whether the brace of the cut is one
    pieces = pieces.withColumn("closes", closes).withColumn("deeper", _count(marks, "{") + _count(marks, "[") - _count(marks, "]") - closes)
    pieces = before(pieces, "deeper", "depth")
    ends = ((F.col("closes") == 1) & (F.col("depth") + F.col("deeper") == 1)).cast("long")
    pieces = before(pieces.withColumn("ends", ends), "ends", "place")
    whole = pieces.groupBy("path", "place").agg(F.array_sort(F.collect_list(F.struct("start", "at", "piece"))).alias("parts"), F.max("ends").alias("ended"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["piece"]), "}"), F.lit("}"))
    return whole.filter("ended = 1").select("path", "place", F.regexp_replace(text, r"^[\s\x{FEFF}]*[\[,]\s*", "").alias("record"))

"""Records of one schema: defaults for missing fields, derived fields, and cross-source normalisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podia.functions import text as X

_TEXT = [
    "source_platform", "source_url", "source_format", "race_name_raw", "race_name_canonical", "race_key", "date", "race_type",
    "region", "result_label", "category_raw", "gender", "age_group", "bib", "uci_id", "tsu_rider_id", "name_raw", "name_masked",
    "nationality", "team", "finish_time", "status", "scraped_at",
]
#: The record that every source is brought to.
RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.LongType()) for c in ("year", "rank_overall", "laps", "source_ord", "row_ord")]
    + [T.StructField("finish_seconds", T.DoubleType()), T.StructField("splits", T.ArrayType(T.StringType()))]
)


def make_records(rows: DataFrame) -> DataFrame:
    """rows in the record schema: absent fields null, the mask, seconds, race name, key and year derived where they are missing."""
    have = set(rows.columns)
    out = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD])
    name = F.col("race_name_raw")
    return out.withColumns(
        {
            "name_masked": X.filled(F.col("name_masked"), X.mask_name(F.col("name_raw"))),
            "finish_seconds": F.coalesce("finish_seconds", X.time_to_seconds(F.col("finish_time"))),
            "race_name_canonical": X.filled(F.col("race_name_canonical"), X.canonical_race_name(name)),
            "race_key": X.filled(F.col("race_key"), X.race_key(name)),
            "year": F.coalesce("year", X.extract_year(name)),
        }
    )


def enrich(rows: DataFrame, canonical: dict[str, str] | None = None) -> DataFrame:
    """rows with series (unless they have it), race_class, gender and age_band; gender and age come from the category where they are missing.

    canonical renames race keys of one event that sources call differently; the
    table is curated by hand, so it is a small map inside the plan.
    """
    gender, category = F.col("gender") if "gender" in rows.columns else F.lit(None).cast("string"), F.col("category_raw")
    age = F.col("age_group") if "age_group" in rows.columns else F.lit(None).cast("string")
    if canonical:
        table = F.create_map(*[F.lit(x) for pair in canonical.items() for x in pair])
        known = F.try_element_at(table, F.col("race_key"))
        rows = rows.withColumns({"race_name_canonical": F.coalesce(known, "race_name_canonical"), "race_key": F.coalesce(known, "race_key")})
    if "series" not in rows.columns:
        rows = rows.withColumn("series", X.by_pattern(X.filled(F.col("race_name_raw"), F.col("race_name_canonical")), X.SERIES))
    certified = F.coalesce(F.col("series") == X.CERTIFIED, F.lit(False))
    return rows.withColumns(
        {
            "race_class": F.when(certified, "認證").otherwise(X.race_class(F.col("result_label"), category)),
            "gender": F.when(gender.isin("M", "F"), gender).otherwise(F.coalesce(X.gender_from_category(category), gender)),
            "age_band": X.age_band(X.filled(age, X.age_from_category(category))),
        }
    )


def union_sources(sources: list[DataFrame]) -> DataFrame:
    """All sources in one record schema, numbered in order; row_ord keeps the rows' order if a source has it."""
    numbered = [make_records(s).withColumn("source_ord", F.lit(i).cast("long")) for i, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, numbered)

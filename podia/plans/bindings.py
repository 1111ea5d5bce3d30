"""How the warehouse tables stand for race results: one order line is one rider's result in a race of a year.

The text is plain SQL that Spark and other engines read alike, so that the
queries' SQL counterparts can start from the very same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from podia.functions import text as T
from podia.operators.normalise import enrich

TABLES = ("lineitem", "orders", "customer", "part", "supplier", "nation", "region")

#: race = brand, edition = year of shipping, sub-event = part type, rider = customer, time = price.
RESULTS = """
SELECT r.*,
       CASE WHEN finish_seconds IS NOT NULL THEN
         CAST(row_number() OVER (PARTITION BY race_key, year, result_label, finish_seconds IS NULL ORDER BY finish_seconds, row_ord) AS BIGINT)
       END AS rank_overall
FROM (
  SELECT CAST(((l.l_orderkey * 100000 + l.l_partkey) * 10000 + l.l_suppkey) * 8 + l.l_linenumber AS BIGINT) AS row_ord,
         o.o_orderpriority AS source_platform,
         CAST(substr(o.o_orderpriority, 1, 1) AS BIGINT) AS source_ord,
         CAST(year(l.l_shipdate) AS STRING) || ' ' || p.p_brand || ' ' || p.p_name AS race_name_raw,
         p.p_brand AS race_name_canonical,
         p.p_brand AS race_key,
         CAST(year(l.l_shipdate) AS BIGINT) AS year,
         CAST(CAST(l.l_shipdate AS DATE) AS STRING) AS date,
         CASE WHEN p.p_size % 6 = 0 THEN NULL ELSE 'Series ' || CAST(p.p_size % 6 AS STRING) END AS series,
         r.r_name AS region,
         p.p_type AS result_label,
         CASE WHEN c.c_custkey % 5 = 4 THEN 'OPEN'
              ELSE CASE WHEN c.c_custkey % 3 = 0 THEN 'W' ELSE 'M' END || CAST(15 + 5 * (c.c_custkey % 10) AS STRING) END AS category_raw,
         CAST(l.l_linenumber AS BIGINT) AS bib,
         CASE WHEN c.c_custkey % 7 = 0 AND l.l_linenumber % 2 = 1 THEN 'U' || CAST(c.c_custkey AS STRING) END AS uci_id,
         CASE WHEN c.c_custkey % 5 = 0 AND l.l_linenumber % 3 = 1 THEN 'T' || CAST(c.c_custkey AS STRING) END AS tsu_rider_id,
         c.c_mktsegment || ' ' || substr(c.c_name, 10, 7) || CAST(c.c_custkey % 97 AS STRING) AS name_raw,
         n.n_name AS nationality,
         CASE WHEN l.l_linenumber = 1 THEN s.s_name WHEN c.c_custkey % 11 = 0 THEN NULL WHEN c.c_custkey % 13 = 0 THEN '個人'
              ELSE 'Team ' || CAST(c.c_custkey % 60 AS STRING) END AS team,
         CASE WHEN l.l_returnflag = 'R' THEN NULL ELSE CAST(floor(l.l_extendedprice) AS DOUBLE) + 600 END AS finish_seconds,
         CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'F' THEN 'DNF' WHEN l.l_returnflag = 'R' THEN 'DNS'
              WHEN l.l_returnflag = 'N' THEN 'FIN' END AS status,
         CAST(l.l_quantity AS BIGINT) AS laps
  FROM {lineitem} l
  JOIN {orders} o ON l.l_orderkey = o.o_orderkey
  JOIN {customer} c ON o.o_custkey = c.c_custkey
  JOIN {part} p ON l.l_partkey = p.p_partkey
  JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
  JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  JOIN {region} r ON n.n_regionkey = r.r_regionkey
) r
"""

#: Which parts stand for which discipline.
RULES = [("climb", "hot"), ("crit", "ring"), ("tt", "red")]
#: Climbs with a known course: (race, elevation in m, distance in km, grade in %).
PROFILES = [("Brand#1", 3200, 52.0, 6.2), ("Brand#7", 2100, 31.5, 6.7), ("Brand#13", 1500, 18.0, 8.3), ("Brand#21", 900, 12.0, 7.5)]

#: The joins of RESULTS as Spark makes them: riders meet the orders, a quarter of the lines, before the lines do.
_FROM = re.compile(r"FROM \{lineitem\} l.*?(?=\n\) r)", re.S)
_BY_SIZE = """FROM {lineitem} l
  JOIN {part} p ON l.l_partkey = p.p_partkey
  JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
  JOIN ({orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
        JOIN {region} r ON n.n_regionkey = r.r_regionkey) ON l.l_orderkey = o.o_orderkey"""


#: The rows of RESULTS before they are ranked.
_UNRANKED = re.compile(r"FROM \(\s*(SELECT .*)\n\) r", re.S)
#: The columns that ranks follow from.
RANKED_BY = ["race_key", "year", "result_label", "finish_seconds", "row_ord"]


def _normalised(spark: SparkSession, sf_dir: str, ranked: bool) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    sql = _FROM.sub(lambda _: _BY_SIZE, RESULTS)
    return enrich(spark.sql(sql if ranked else _UNRANKED.search(sql)[1], **tables).withColumn("name_masked", T.mask_name(F.col("name_raw"))))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results of the tables in sf_dir, normalised."""
    return _normalised(spark, sf_dir, ranked=True)


def digested(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Of results(): race_key, year, finish_seconds, rank_overall, some more columns, and `rest`, a hash of all that don't follow from these.

    For digests of results: a row's texts are hashed before it is ranked, so that ranking moves the hash and not them.
    """
    rows = _normalised(spark, sf_dir, ranked=False)
    rest = F.xxhash64(*sorted(set(rows.columns) - set(more)))
    short = rows.select(*dict.fromkeys([*RANKED_BY, *more]), rest.alias("rest"))
    group = Window.partitionBy("race_key", "year", "result_label", F.col("finish_seconds").isNull()).orderBy("finish_seconds", "row_ord")
    ranked = short.withColumn("rank_overall", F.when(F.col("finish_seconds").isNotNull(), F.row_number().over(group).cast("long")))
    return ranked.select(*dict.fromkeys(["race_key", "year", "finish_seconds", "rank_overall", *more]), "rest")


def profiles(spark: SparkSession) -> DataFrame:
    known = spark.createDataFrame(PROFILES, "race_key string, elev_m int, dist_km double, grade double")
    return known.withColumns({"name": F.concat(F.lit("Mount "), "race_key"), "conf": F.when(F.col("elev_m") > 2000, "high").otherwise("med")})

"""Sharding by a permutation-filled lookup table: balanced, and stable when shards come and go."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from podia.llm.common import free_name

#: The table is broadcast; this is the bound of its size (12 bytes an entry, 12 MB).
MAX_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = 65537) -> list[int]:
    """The index of the shard of each slot.

    Each shard has its own order of preference over all slots, offset + j *
    skip modulo the prime number of slots. Shards take turns, each claiming
    the first free slot of its order, until none is free; so their shares
    differ by one slot at most. The order of a shard depends on its name
    alone, so a change of the list moves few slots of the others.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not is_prime(slots) or slots > MAX_SLOTS or slots < len(shards):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    seeds = [hashlib.sha256(name.encode()).digest() for name in shards]
    at = [int.from_bytes(s[:8], "big") % slots for s in seeds]
    skip = [int.from_bytes(s[8:16], "big") % (slots - 1) + 1 for s in seeds]
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + skip[i]) % slots
            table[slot], at[i] = i, (slot + skip[i]) % slots
            free -= 1
            if not free:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], slots: int, name: str) -> DataFrame:
    schema = T.StructType([T.StructField("slot", T.LongType(), False), T.StructField(name, T.StringType(), False)])
    return spark.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], schema)


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key: XXH64 of its text, modulo slots. A null key has the slot of the empty text."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots))


def place(df: DataFrame, key: str, shards: list[str], slots: int = 65537, out: str = "shard") -> DataFrame:
    """df with the column `out`: each row's shard, by one probe of the broadcast table (bound: MAX_SLOTS entries).

    No shuffle. Rows with equal keys share a shard. Null keys go where the
    empty text goes; repeated rows each get their shard; an empty table stays
    empty. A column of df called `out` is replaced.
    """
    slot = free_name(df, f"{out}_slot")
    table = table_frame(df.sparkSession, shards, slots, out).withColumnRenamed("slot", slot)
    return df.withColumn(slot, slot_of(F.col(key), slots)).drop(out).join(F.broadcast(table), slot).drop(slot)


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, slots: int = 65537, split: int = 8) -> None:
    """Write df as Parquet under path/shard=NAME, every shard in up to `split` files so that none is one task's work.

    Rows are dealt over a shard's files by a hash of their columns, maps left
    out; a null key has a shard like any other. A column `shard` of df is kept as shard_, as the
    folders give the name its meaning; an empty table writes no shard.
    """
    if "shard" in df.columns:
        other = free_name(df, "shard_")
        df, key = df.withColumnRenamed("shard", other), other if key == "shard" else key
    placed = place(df, key, shards, slots)
    part = F.pmod(F.xxhash64(F.lit(0), *[F.col(c) for c, kind in df.dtypes if "map<" not in kind]), F.lit(split))
    placed.repartition(len(shards) * split, "shard", part).write.partitionBy("shard").parquet(path)

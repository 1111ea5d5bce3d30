"""Aggregates whose definition the products depend on."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median(col: Column) -> Column:
    """The middle value, or the mean of the two middle ones."""
    return F.percentile(col, 0.5)


def quantile(col: Column, q: float) -> Column:
    """Linear interpolation between the two neighbours at q * (n - 1)."""
    return F.percentile(col, q)


def quantiles(counted: DataFrame, by: list[str], value: str, wanted: dict[str, float], bins: float) -> DataFrame:
    """(by..., n, wanted...): the wanted quantile()s of values (by, value, c), each there c times.

    No group's values meet in one task: they are counted in bins, so many for each unit, and only the few
    bins that hold a wanted place are looked into, each by itself.
    """
    counted = counted.withColumn("__bin", F.floor(F.col(value) * bins))
    of = Window.partitionBy(*by)
    binned = counted.groupBy(*by, "__bin").agg(F.sum("c").alias("c"))
    binned = binned.withColumns({"n": F.sum("c").over(of), "__from": F.sum("c").over(of.orderBy("__bin")) - F.col("c")})
    at = {name: (F.col("n") - 1) * F.lit(q) for name, q in wanted.items()}
    holds = lambda place: (F.col("__from") <= place) & (place < F.col("__from") + F.col("c"))
    held = binned.filter(reduce(or_, [holds(x) for place in at.values() for x in (F.floor(place), F.ceil(place))]))
    keys = [*by, "__bin"]
    held = held.select(*[F.col(k).alias(f"{k}__") for k in keys], "n", F.col("__from").alias("__before"))
    inside = counted.join(F.broadcast(held), reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}__")) for k in keys]))
    inside = inside.groupBy(*keys, "n", "__before", value).agg(F.sum("c").alias("c"))  # a value may come in several counts
    inside = inside.withColumn("__from", F.col("__before") + F.sum("c").over(Window.partitionBy(*keys).orderBy(value)) - F.col("c"))
    ends = {(name, end): f(place) for name, place in at.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    found = inside.groupBy(*by, "n").agg(*[F.max(F.when(holds(place), F.col(value))).alias(f"__{name}_{end}") for (name, end), place in ends.items()])

    def between(name: str) -> Column:
        low, high = F.col(f"__{name}_low"), F.col(f"__{name}_high")
        return F.when(low == high, low).otherwise((F.ceil(at[name]) - at[name]) * low + (at[name] - F.floor(at[name])) * high)

    return found.select(*by, "n", *[between(name).alias(name) for name in wanted])


def half_even(col: Column, digits: int = 0) -> Column:
    """Rounding of halves to the even neighbour."""
    return F.bround(col, digits)


def in_field_percent(rank: Column, field: Column) -> Column:
    """The share of the field that was beaten; null for a rank that is missing, zero or beyond the field."""
    return F.when((field >= 1) & (rank >= 1) & (rank <= field), (field - rank) / field * 100)


def mode(value: str, tie: Column | None = None) -> Column:
    """Of groupBy-ed rows (value, n): the most frequent value, ties by `tie` (the value itself by default)."""
    return F.min_by(F.col(value), F.struct(-F.col("n"), F.col(value) if tie is None else tie))

"""Exact ranks, quantiles and positions without putting a whole group on one task.

The values of a group are first reduced to (value, count), then cut into slices of fixed width. A window function
runs inside one slice only; what the earlier slices hold is added as an offset from a tiny per-slice table. Equal values
are one row, however often they occur.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_positions(df: DataFrame, keys: Sequence[str], value: str, slice_width: float = 0.01) -> DataFrame:
    """Distinct values per key with ``cnt``, ``before`` (how many rows are smaller) and ``total``."""
    k = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*k, value).agg(F.count("*").alias("cnt"))
    sliced = counts.withColumn("_slice", F.floor(F.col(value) / float(slice_width)))
    sizes = sliced.groupBy(*k, "_slice").agg(F.sum("cnt").alias("_n"))
    order = Window.partitionBy(*k).orderBy("_slice")
    offsets = sizes.withColumns(
        {
            "_offset": F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "total": F.sum("_n").over(Window.partitionBy(*k)),
        }
    ).drop("_n")
    inside = Window.partitionBy(*k, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("_local", F.coalesce(F.sum("cnt").over(inside), F.lit(0)))
        .join(offsets, [*k, "_slice"])
        .withColumn("before", F.col("_offset") + F.col("_local"))
        .drop("_slice", "_offset", "_local")
    )


def average_ranks(df: DataFrame, keys: Sequence[str], wanted: dict[str, str], slice_width: float | dict[str, float] = 0.01) -> DataFrame:
    """Attach the mean rank of each value within its key; ties share it. ``wanted``: value column to rank column.

    All ranks come from the same input, so the plan grows by the number of columns and not by its power.
    """
    out = df
    for value, name in wanted.items():
        width = slice_width[value] if isinstance(slice_width, dict) else slice_width
        mean = (F.col("before") + (F.col("cnt") + 1) / 2).alias(name)
        out = out.join(value_positions(df, keys, value, width).select(*keys, value, mean), [*keys, value], "left")
    return out


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str, slice_width: float = 0.01) -> DataFrame:
    return average_ranks(df, keys, {value: out}, slice_width)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float], slice_width: float = 0.01) -> DataFrame:
    """Linearly interpolated quantiles, one row per key."""
    pos = value_positions(df, keys, value, slice_width)
    first, last = F.col("before"), F.col("before") + F.col("cnt") - 1

    def at(index: Column) -> Column:
        return F.max(F.when((first <= index) & (index <= last), F.col(value)))

    aggs: list[Column] = []
    for name, q in wanted.items():
        spot = (F.col("total") - 1) * float(q)
        aggs += [at(F.floor(spot)).alias(f"_lo_{name}"), at(F.ceil(spot)).alias(f"_hi_{name}"), F.max(spot - F.floor(spot)).alias(f"_w_{name}")]
    out = pos.groupBy(*keys).agg(*aggs)
    cols = {
        n: F.when(F.col(f"_w_{n}") == 0, F.col(f"_lo_{n}")).otherwise(F.col(f"_lo_{n}") * (1 - F.col(f"_w_{n}")) + F.col(f"_hi_{n}") * F.col(f"_w_{n}"))
        for n in wanted
    }
    return out.select(*keys, *[c.alias(n) for n, c in cols.items()])


def row_positions(df: DataFrame, keys: Sequence[str], ts: str, tie: str, slice_seconds: float, pos: str = "pos", size: str = "size") -> DataFrame:
    """Zero-based position of each row in its key by time, and the size of the key. Sorted per time slice only."""
    k = list(keys)
    sliced = df.withColumn("_slice", F.floor(F.unix_micros(ts) / float(slice_seconds * 1e6)))
    order = Window.partitionBy(*k).orderBy("_slice")
    offsets = (
        sliced.groupBy(*k, "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumns(
            {
                "_offset": F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                size: F.sum("_n").over(Window.partitionBy(*k)),
            }
        )
        .drop("_n")
    )
    inside = Window.partitionBy(*k, "_slice").orderBy(ts, tie)
    local = sliced.withColumn("_local", F.row_number().over(inside) - 1)
    return local.join(offsets, [*k, "_slice"]).withColumn(pos, F.col("_offset") + F.col("_local")).drop("_slice", "_offset", "_local")

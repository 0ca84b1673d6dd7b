"""Joining a fact table to a per-value table when values may be very unequal in size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.text import col

# what may be broadcast or handled by one task, measured before it is
SMALL_BYTES = 32 << 20
HOT_SHARE = 0.001
SPREAD = 997


def row_bytes(df: DataFrame) -> Column:
    """Rough size of a row in memory: its texts and 16 bytes for everything else."""
    size = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind not in ("string", "binary"):
            continue
        size = size + F.coalesce(F.octet_length(col(name)), F.lit(0))
    return size


def is_small(df: DataFrame) -> bool:
    """Whether the measured size of ``df`` is within SMALL_BYTES."""
    return (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= SMALL_BYTES


def join_spread(big: DataFrame, small: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Inner join of ``big`` with a smaller table on ``key``, with ``big`` free to be skewed.

    Up to SMALL_BYTES the small side is broadcast. Beyond that the keys with over 0.1 % of the rows of ``big`` (so
    under 1,000) are split into as many lanes as they hold such shares, and only their rows of ``small`` are copied.
    """
    if is_small(small):
        return big.join(F.broadcast(small), key)
    counts = big.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    share = max(1.0, HOT_SHARE * (counts.agg(F.sum("_rows")).first()[0] or 0))
    lanes = counts.where(F.col("_rows") > share).select(
        F.col(key).alias("_hot"), F.ceil(F.col("_rows") / share).cast("int").alias("_lanes")
    )
    width = F.coalesce("_lanes", F.lit(1))

    def marked(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(lanes), F.col(key) == F.col("_hot"), "left")

    lane = F.pmod(F.xxhash64(F.col(spread_by)), width).cast("int")
    left = marked(big).withColumn("_lane", lane).drop("_hot", "_lanes")
    copies = F.explode(F.sequence(F.lit(0), width - 1))
    right = marked(small).select("*", copies.alias("_lane")).drop("_hot", "_lanes")
    return left.join(right, [key, "_lane"]).drop("_lane")


def attach(df: DataFrame, dim: DataFrame, key: str, value: str, rows: str) -> DataFrame:
    """Left-join ``dim[value]`` on a non-null ``key``; ``dim[rows]`` is the key's row count in ``df``.

    A dimension of up to SMALL_BYTES is broadcast. A larger one is shuffled, except for the
    keys that each hold over 0.1 % of all rows: there are under 1,000 of those, so they are
    broadcast, and their fact rows are spread over the shuffle instead of meeting in one task.
    """
    size = dim.agg(F.sum(row_bytes(dim)).alias("bytes"), F.sum(rows).alias("rows")).first()
    if (size["bytes"] or 0) <= SMALL_BYTES:
        return df.join(F.broadcast(dim.select(key, value)), key, "left")

    hot = F.col(rows) > F.lit(size["rows"] * HOT_SHARE)
    few = dim.where(hot).select(F.col(key).alias("_hot"), F.col(value).alias("_hot_value"))
    many = dim.where(~hot).select(
        F.col(key).alias("_key"), F.lit(0).alias("_lane"), F.col(value).alias("_many_value")
    )
    marked = df.join(F.broadcast(few), F.col(key) == F.col("_hot"), "left")
    other = [c for c in df.columns if c != key]
    lane = F.when(
        F.col("_hot").isNotNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in other]), F.lit(SPREAD)) + 1
    ).otherwise(0)
    marked = marked.withColumn("_row_lane", lane.cast("int"))
    joined = marked.join(
        many, (F.col(key) == F.col("_key")) & (F.col("_row_lane") == F.col("_lane")), "left"
    )
    return joined.withColumn(value, F.coalesce("_hot_value", "_many_value")).drop(
        "_hot", "_hot_value", "_key", "_lane", "_many_value", "_row_lane"
    )

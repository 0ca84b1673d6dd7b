"""Exact global order without a single-partition window.

The table is range-partitioned and sorted on its keys, numbered by
``monotonically_increasing_id`` (partition in the high bits, place within it in the low 33)
and saved, so every later read sees the same partitions. What crosses partitions is then one
row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.plans.scratch import save

PART, PLACE = "_part", "_place"


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_global_order(df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Saved copy of ``df`` with ``_part`` and ``_place`` in the order of ``keys``.

    Rows that tie on every key are ordered by a hash of the row, which also lets a tie group
    of any size spread over many partitions.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    # maps have no hash; the other columns tell rows apart well enough to spread them
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.MapType)])
    keys = [*keys, tie.asc()]
    numbered = (
        # no fixed number: adaptive execution may merge neighbouring ranges of a small table
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(PLACE, F.monotonically_increasing_id())
        .withColumn(PART, F.shiftright(PLACE, 33).cast("int"))
    )
    return save(numbered)


def with_global_rank(df: DataFrame, keys: Sequence[Column | str], name: str) -> DataFrame:
    """Append the 1-based position of every row in the order of ``keys``."""
    placed = in_global_order(df, keys)
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # one row per shuffle partition: small whatever the table size
    starts = (
        placed.groupBy(PART)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    place_in_part = F.col(PLACE).bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(starts), PART)
        .withColumn(name, F.col("_start") + place_in_part + 1)
        .drop(PART, PLACE, "_start")
    )


def fill_in_order(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[Column | str],
    backward: bool = False,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Carry the last (or, backward, the next) non-null value over the whole table.

    With ``partition_by`` values stay within their key. The table is ordered by key first, so
    a key of any size spreads over many tasks like everything else.
    """
    groups = [F.col(f"`{k}`") for k in partition_by]
    placed = in_global_order(df, [*groups, *order_by])
    # Always "the last present value so far", in the one direction or the other: a frame that
    # ends at the current row is kept up step by step, one that starts there is scanned anew.
    place, part = (F.desc(PLACE), F.desc(PART)) if backward else (F.asc(PLACE), F.asc(PART))
    inside = Window.partitionBy(PART, *groups).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    outside = Window.partitionBy("_group").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    nearest = F.min_by if backward else F.max_by

    # What a partition hands on per key. Only its first and last key can go on elsewhere, so
    # two rows per shuffle partition are left.
    key = F.struct(*groups) if partition_by else F.struct(F.lit(1).alias("_all"))
    keyed = placed.withColumn("_group", key)
    edges = keyed.groupBy(PART, "_group").agg(
        *[
            nearest(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), F.col(PLACE))).alias(f"_edge{i}")
            for i, c in enumerate(columns)
        ],
        F.min(PLACE).alias("_first"),
        F.max(PLACE).alias("_last"),
    )
    ends = placed.groupBy(F.col(PART).alias("_p")).agg(F.min(PLACE).alias("_start"), F.max(PLACE).alias("_end"))
    outermost = (F.col("_first") == F.col("_start")) | (F.col("_last") == F.col("_end"))
    edges = edges.join(F.broadcast(ends), (F.col(PART) == F.col("_p")) & outermost)
    carried = edges.select(
        F.col(PART).alias("_to"),
        F.col("_group").alias("_to_group"),
        *[F.last(f"_edge{i}", ignorenulls=True).over(outside).alias(f"_carry{i}") for i in range(len(columns))],
    )
    filled = keyed.join(
        F.broadcast(carried), (F.col(PART) == F.col("_to")) & F.col("_group").eqNullSafe(F.col("_to_group")), "left"
    )
    filled = filled.withColumns(
        {
            c: F.coalesce(
                F.col(f"`{c}`"),
                F.last(F.col(f"`{c}`"), ignorenulls=True).over(inside),
                F.col(f"_carry{i}"),
            )
            for i, c in enumerate(columns)
        }
    )
    return filled.select(*[F.col(f"`{c}`") for c in df.columns])

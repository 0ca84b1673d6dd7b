"""Pieces that several training-data operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.text import col

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_BYTES = 16 << 20
HOT_SHARE = 0.001
LANES = 4096
BATCH_ROWS = 1000


def whole(text: Column) -> Column:
    """The text, empty where missing."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of anything but blanks, tabs and line ends."""
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key written as text, modulo ``folds``; a missing key counts as empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def windows(items: Column, size: Column | int, width: int = 5) -> Column:
    """One 64-bit hash per run of ``width`` consecutive items; none where there are fewer."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(0), size - width)
    runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(items, i + k) for k in range(width)]))
    return F.when(size >= width, runs).otherwise(F.array().cast("array<bigint>"))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def attach(df: DataFrame, dim: DataFrame, key: str, rows: str, spread_by: Sequence[str]) -> DataFrame:
    """Left-join the other columns of ``dim`` (one row per ``key``) to ``df``, whatever the skew of ``key``.

    ``dim[rows]`` is the number of rows of ``df`` with that key; it is not returned. A measured size of up
    to BROADCAST_BYTES is broadcast. Beyond that the keys that hold over 0.1 % of all rows each (so under 1,000)
    are broadcast, and their rows are spread over the shuffle by ``spread_by`` instead of meeting in one task.
    """
    values = [c for c in dim.columns if c not in (key, rows)]
    bytes_each = F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + 16 * (1 + len(values))
    size = dim.agg(F.sum(bytes_each).alias("bytes"), F.sum(rows).alias("rows")).first()
    if (size["bytes"] or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(dim.drop(rows)), key, "left")
    hot = F.col(rows) > F.lit(size["rows"] * HOT_SHARE)
    few = dim.where(hot).select(F.col(key).alias("_hot"), F.struct(*values).alias("_few"))
    many = dim.where(~hot).select(F.col(key).alias("_key"), F.lit(0).alias("_zero"), F.struct(*values).alias("_many"))
    lane = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*map(col, spread_by)), F.lit(LANES)))
    joined = df.join(F.broadcast(few), F.col(key) == F.col("_hot"), "left").withColumn("_lane", lane.cast("int"))
    joined = joined.join(many, (F.col(key) == F.col("_key")) & (F.col("_lane") == F.col("_zero")), "left")
    picked = [F.coalesce(F.col(f"_few.{v}"), F.col(f"_many.{v}")).alias(v) for v in values]
    return joined.select(*[col(c) for c in df.columns], *picked)


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to BATCH_ROWS rows: whole texts are long, and a worker holds several
    copies of a batch at once. A smaller setting of the session's own stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df

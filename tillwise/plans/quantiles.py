"""Exact quantiles of a column of any size.

``percentile`` keeps every distinct value in one final task. Here a mergeable sketch proposes
a narrow bracket around each wanted rank, a counting pass proves that the rank lies inside it,
and the steps repeat until few enough rows are left to look at directly. The result never
depends on the sketch, only the number of passes does.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

SKETCH_ACCURACY = 10_000
DIRECT_ROWS = 20_000


@dataclass
class _Bracket:
    """Closed value range known to hold one rank (0-based, counted in weight)."""

    rank: int
    low: float
    high: float
    below: int
    weight: int
    rows: int

    @property
    def open(self) -> bool:
        return self.low < self.high and self.rows > DIRECT_ROWS


def _counts(values: DataFrame, ranges: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Per range: weight below it, weight inside it, rows inside it; one pass for all."""
    measures = []
    for i, (low, high) in enumerate(ranges):
        inside = F.col("v").between(low, high)
        measures += [
            F.sum(F.when(F.col("v") < low, F.col("w")).otherwise(0)).alias(f"b{i}"),
            F.sum(F.when(inside, F.col("w")).otherwise(0)).alias(f"w{i}"),
            F.count(F.when(inside, True)).alias(f"r{i}"),
        ]
    row = values.agg(*measures).first()
    return [(row[f"b{i}"], row[f"w{i}"], row[f"r{i}"]) for i in range(len(ranges))]


def _narrow(values: DataFrame, brackets: list[_Bracket]) -> None:
    wide = [b for b in brackets if b.open]
    margin = 2.0 / SKETCH_ACCURACY
    sketches = []
    for i, b in enumerate(wide):
        place = (b.rank - b.below + 0.5) / b.weight
        ends = [max(0.0, place - margin), min(1.0, place + margin)]
        member = F.when(F.col("v").between(b.low, b.high), F.col("v"))
        sketches.append(F.percentile_approx(member, ends, SKETCH_ACCURACY).alias(f"s{i}"))
    row = values.agg(*sketches).first()
    proposed = [tuple(row[f"s{i}"]) for i in range(len(wide))]
    for b, (low, high), (below, inside, rows) in zip(wide, proposed, _counts(values, proposed)):
        if b.rank < below:
            # the rank lies under the proposal: keep the part up to its lower end
            b.high, b.weight, b.rows = _below(values, b.low, low)
        elif b.rank >= below + inside:
            b.low, b.below, b.weight, b.rows = _above(values, high, b.high, below + inside)
        else:
            b.low, b.high, b.below, b.weight, b.rows = low, high, below, inside, rows


def _below(values: DataFrame, low: float, stop: float) -> tuple[float, int, int]:
    row = values.where((F.col("v") >= low) & (F.col("v") < stop)).agg(
        F.max("v").alias("v"), F.sum("w").alias("w"), F.count("v").alias("r")
    ).first()
    return row["v"], row["w"], row["r"]


def _above(values: DataFrame, start: float, high: float, below: int) -> tuple[float, int, int, int]:
    row = values.where((F.col("v") > start) & (F.col("v") <= high)).agg(
        F.min("v").alias("v"), F.sum("w").alias("w"), F.count("v").alias("r")
    ).first()
    return row["v"], below, row["w"], row["r"]


def _at_ranks(values: DataFrame, ranks: list[int], total: Row) -> dict[int, float]:
    brackets = [_Bracket(r, total["lo"], total["hi"], 0, total["w"], total["r"]) for r in ranks]
    while any(b.open for b in brackets):
        _narrow(values, brackets)

    found = {b.rank: b.low for b in brackets if b.low == b.high}
    rest = [b for b in brackets if b.rank not in found]
    if rest:
        wanted = F.lit(False)
        for b in rest:
            wanted = wanted | F.col("v").between(b.low, b.high)
        # at most DIRECT_ROWS rows per rank by construction
        few = values.where(wanted).groupBy("v").agg(F.sum("w").alias("w")).toPandas()
        few = few.sort_values("v")
        for b in rest:
            part = few[few["v"].between(b.low, b.high)]
            upto = b.below + part["w"].cumsum()
            found[b.rank] = float(part["v"][upto > b.rank].iloc[0])
    return found


def _between(low: float, high: float, share: float) -> float:
    if share >= 0.5:
        return high - (high - low) * (1 - share)
    return low + (high - low) * share


def exact_quantiles(
    df: DataFrame, column: str, probabilities: list[float], weight: str | None = None
) -> list[float | None]:
    """Linearly interpolated quantiles; missing values are left out.

    ``weight`` (a whole number per row) counts a row that many times.
    """
    value = F.col(f"`{column}`").cast("double")
    values = df.select(
        F.nanvl(value, F.lit(None)).alias("v"),
        (F.col(f"`{weight}`").cast("long") if weight else F.lit(1).cast("long")).alias("w"),
    ).where("v IS NOT NULL AND w > 0")
    total = values.agg(
        F.sum("w").alias("w"), F.count("v").alias("r"), F.min("v").alias("lo"), F.max("v").alias("hi")
    ).first()
    if not total["r"]:
        return [None] * len(probabilities)
    places = [(total["w"] - 1) * p for p in probabilities]
    ranks = sorted({int(f(h)) for h in places for f in (math.floor, math.ceil)})
    found = _at_ranks(values, ranks, total)
    return [_between(found[math.floor(h)], found[math.ceil(h)], h - math.floor(h)) for h in places]

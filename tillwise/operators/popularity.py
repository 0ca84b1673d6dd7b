"""Best-selling items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.text import is_numeric, known, strip


def item_text(df: DataFrame, item_col: str) -> Column:
    """Item as trimmed text; missing becomes the text "nan"."""
    return F.coalesce(strip(known(df, item_col).cast("string")), F.lit("nan"))


def numeric_quantity(df: DataFrame, qty_col: str | None) -> bool:
    return bool(qty_col) and qty_col in df.columns and is_numeric(df, qty_col)


def popular_items(df: DataFrame, item_col: str, qty_col: str | None = None, top_n: int = 5) -> DataFrame:
    """(item, score): summed quantity, or rows where there is no numeric quantity."""
    if numeric_quantity(df, qty_col):
        score = F.coalesce(F.sum(known(df, qty_col).cast("double")), F.lit(0.0))
    else:
        score = F.count(F.lit(1))
    totals = df.groupBy(item_text(df, item_col).alias("item")).agg(score.alias("_score"))
    top = totals.orderBy(F.desc("_score"), "item").limit(top_n)
    return top.select("item", F.col("_score").cast("long").alias("score"))

"""Customer segments from recency, frequency and monetary value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.text import col, known
from tillwise.operators.cleaning import change_type
from tillwise.operators.outliers import outlier_scores
from tillwise.plans.lookups import attach
from tillwise.plans.ordering import with_global_rank
from tillwise.plans.quantiles import exact_quantiles
from tillwise.plans.scratch import save

# fixed values
LEAST_CUSTOMERS = 10
SMALL_TABLE_SEGMENT = "Standard Customer"
WHALE_QUANTILE = 0.90
CAP_QUANTILE = 0.99

FEATURES = ["log_recency", "log_frequency", "log_monetary"]


def parse_dates(df: DataFrame, date_col: str) -> DataFrame:
    return change_type(df, date_col, "datetime64[ns]")


def rfm_table(df: DataFrame, id_col: str, date_col: str, amount_col: str) -> DataFrame:
    """Saved table of id, Recency (whole days), Frequency (rows), Monetary (> 0 only).

    The fact table is read once: the newest date of all, undated ids and rows without an id
    included, comes from the per-id aggregate.
    """
    dated = parse_dates(df, date_col)
    last = col(date_col)
    if isinstance(dated.schema[date_col].dataType, T.DateType):
        last = last.cast("timestamp")
    grouped = save(
        dated.groupBy(known(dated, id_col).alias(id_col)).agg(
            F.max(last).alias("_last"),
            F.count(F.lit(1)).alias("Frequency"),
            F.coalesce(F.sum(known(df, amount_col)), F.lit(0)).cast("double").alias("Monetary"),
        )
    )
    newest = grouped.agg(F.max("_last").cast("string")).first()[0]
    anchor = F.lit(newest).cast(grouped.schema["_last"].dataType) + F.expr("INTERVAL 1 DAY")
    return grouped.where(col(id_col).isNotNull() & (F.col("Monetary") > 0)).select(
        col(id_col), F.timestamp_diff("DAY", F.col("_last"), anchor).alias("Recency"), "Frequency", "Monetary"
    )


def with_log_features(rfm: DataFrame) -> DataFrame:
    return rfm.withColumns(
        dict(zip(FEATURES, (F.log1p("Recency"), F.log1p("Frequency"), F.log1p("Monetary"))))
    )


def with_outlier_scores(rfm: DataFrame) -> DataFrame:
    """Append lof_score and is_outlier of each customer's point to the RFM table."""
    logged = with_log_features(rfm)
    key = F.struct(*FEATURES)
    marks = outlier_scores(logged, FEATURES).select(
        key.alias("_point"), F.struct("lof_score", "is_outlier").alias("_mark"), "copies"
    )
    marked = attach(logged.withColumn("_point", key), marks, "_point", "_mark", "copies")
    return marked.select(*[col(c) for c in rfm.columns], "_mark.lof_score", "_mark.is_outlier")


def flag_whales(rfm: DataFrame, cutoff: float) -> DataFrame:
    """Append Is_Whale: an outlier whose Monetary reaches ``cutoff``."""
    whale = F.col("is_outlier") & (F.col("Monetary") >= F.lit(cutoff))
    return with_outlier_scores(rfm).select(*[col(c) for c in rfm.columns], whale.alias("Is_Whale"))


def whales(rfm: DataFrame) -> DataFrame:
    (cutoff,) = exact_quantiles(rfm, "Monetary", [WHALE_QUANTILE])
    return flag_whales(rfm, cutoff).where("Is_Whale").drop("Is_Whale")


def quarters(df: DataFrame, id_col: str, rows: int, measures: dict[str, Column]) -> dict[str, Column]:
    """Per measure 1..4: which quarter of the span 1..rows a row's rank falls in, upper edges included.

    Ranks go by measure, then id. Only the first row of each quarter is needed to tell them apart, so all measures are
    ordered in one narrow sort, three rows of each are looked up, and the scores are comparisons with literals.
    """
    slots = [F.struct(F.lit(i).alias("m"), c.cast("double").alias("v"), col(id_col).alias("id")) for i, c in enumerate(measures.values())]
    ranked = with_global_rank(df.select(F.inline(F.array(*slots))), ["m", "v", "id"], "rank")
    # the smallest rank r with floor((4 (r - 1) + rows - 2) / (rows - 1)) >= k
    starts = [1 - (-(k * (rows - 1) - (rows - 2)) // 4) for k in (2, 3, 4)]
    wanted = [i * rows + r for i in range(len(measures)) for r in starts]
    edges = ranked.where(F.col("rank").isin(wanted)).select("m", "v", "id").collect()
    scores = {}
    for i, (name, c) in enumerate(measures.items()):
        here = F.struct(c.cast("double").alias("v"), col(id_col).alias("id"))
        score = F.lit(1)
        for e in edges:
            if e["m"] == i:
                edge = F.struct(F.lit(e["v"]).alias("v"), F.lit(e["id"]).cast(df.schema[id_col].dataType).alias("id"))
                score = score + (here >= edge).cast("int")
        scores[name] = score
    return scores


def segment_label(whale: Column, r: Column, f: Column, m: Column) -> Column:
    # fixed values: labels and limits
    return (
        F.when(whale, "VIP / Whale")
        .when(r + f + m >= 11, "Premium / Champion")
        .when(f >= 3, "Loyal Customer")
        .when((r >= 3) & (m <= 2), "Discount Seeker")
        .when(r == 2, "At Risk")
        .otherwise("Lost Customer")
    )


def rfm_segments(
    df: DataFrame, id_col: str, date_col: str, amount_col: str, find_whales: bool = True
) -> DataFrame:
    """RFM table with scores and Segment; ``find_whales=False`` skips the outlier search.

    Under ten customers everyone is a standard customer and there are no score columns.
    """
    rfm = rfm_table(df, id_col, date_col, amount_col)
    rows, undated = rfm.agg(F.count(F.lit(1)), F.count_if(F.col("Recency").isNull())).first()
    if rows < LEAST_CUSTOMERS:
        return rfm.withColumn("Segment", F.lit(SMALL_TABLE_SEGMENT))
    if undated:
        raise ValueError(f"{undated} customers have no date in column {date_col!r}")

    cutoff, money_cap = exact_quantiles(rfm, "Monetary", [WHALE_QUANTILE, CAP_QUANTILE])
    flagged = flag_whales(rfm, cutoff) if find_whales else rfm.withColumn("Is_Whale", F.lit(False))
    (count_cap,) = exact_quantiles(rfm, "Frequency", [CAP_QUANTILE])
    scores = quarters(rfm, id_col, rows, {
        "r": F.col("Recency"), "f": F.least("Frequency", F.lit(count_cap)), "m": F.least("Monetary", F.lit(money_cap)),
    })
    scored = flagged.select(
        *[col(c) for c in rfm.columns],
        "Is_Whale",
        (5 - scores["r"]).cast("int").alias("R_Score"), scores["f"].alias("F_Score"), scores["m"].alias("M_Score"),
    )
    r, f, m = F.col("R_Score"), F.col("F_Score"), F.col("M_Score")
    return scored.withColumn(
        "RFM_Score", F.concat(r.cast("string"), f.cast("string"), m.cast("string"))
    ).withColumn("Segment", segment_label(F.col("Is_Whale"), r, f, m)).drop("Is_Whale")


def segment_summary(segments: DataFrame) -> DataFrame:
    """Customers and revenue per segment, largest first."""
    return (
        segments.groupBy("Segment")
        .agg(F.count(F.lit(1)).alias("customers"), F.bround(F.sum("Monetary"), 2).alias("revenue"))
        .orderBy(F.desc("customers"), "Segment")
    )

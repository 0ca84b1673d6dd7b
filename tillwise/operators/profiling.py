"""Column profiles of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.text import col, is_numeric, known, to_number, words

# fixed values
CATEGORY_LIMIT = 20
LISTED_VALUES = 50
DATE_LIKE = r"\d{2,4}[-/.]\d{1,2}[-/.]\d{1,2}"
SNIFFED_ROWS = 10

# far above CATEGORY_LIMIT, where the distinct-count sketch is still near exact
SCREEN_LIMIT = 200


def type_name(data_type: T.DataType, category: bool = False) -> str:
    match data_type:
        case _ if category:
            return "category"
        case T.ByteType() | T.ShortType() | T.IntegerType():
            return "int32"
        case T.LongType():
            return "int64"
        case T.FloatType() | T.DoubleType() | T.DecimalType():
            return "float64"
        case T.BooleanType():
            return "bool"
        case T.TimestampType() | T.TimestampNTZType() | T.DateType():
            return "datetime64[ns]"
    return "object"


def is_text(data_type: T.DataType) -> bool:
    return type_name(data_type) == "object"


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows")).withColumn("total_cols", F.lit(len(df.columns)))


def preview(df: DataFrame, order_by: Sequence[Column | str], rows: int = 10) -> DataFrame:
    """First rows in the given order."""
    return df.orderBy(*order_by).limit(rows)


def dataset_info(df: DataFrame) -> DataFrame:
    """Per column: counts of present and missing, type, numeric? and categorical?

    A numeric column counts as categorical under 20 distinct values. A sketch screens the
    columns first, so exact distinct counting only runs where few values exist and the
    map side already folds them.
    """
    names = df.columns
    types = {f.name: type_name(f.dataType, bool(f.metadata.get("category"))) for f in df.schema}
    counted = [c for c in names if types[c] not in ("object", "category", "bool")]
    narrow: list[str] = []
    if counted:
        sketch = df.agg(*[F.approx_count_distinct(known(df, c)).alias(f"d{i}") for i, c in enumerate(counted)])
        row = sketch.first()
        narrow = [c for i, c in enumerate(counted) if row[f"d{i}"] <= SCREEN_LIMIT]

    measures = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        measures.append(F.count(known(df, c)).alias(f"p{i}"))
        if c in narrow:
            # bounded by the screen, and no copy of every row per column as a distinct count would make
            measures.append(F.size(F.collect_set(known(df, c))).alias(f"u{i}"))
    lines = []
    for i, c in enumerate(names):
        if c in narrow:
            category = (F.col(f"u{i}") < CATEGORY_LIMIT) & (F.col("n") > 0)
        else:
            category = F.lit(c not in counted)
        lines.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.col(f"p{i}").alias("non_null"),
                (F.col("n") - F.col(f"p{i}")).alias("null_count"),
                F.lit(types[c]).alias("dtype"),
                F.lit(is_numeric(df, c)).alias("is_numeric"),
                category.alias("is_categorical"),
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*lines)))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier whole row (missing values equal each other).

    Rows are compared whole, and each map task folds its own copies before the shuffle, so a
    row with very many copies reaches the reducer as one partial count per task.
    """
    return (
        df.groupBy(*[col(c) for c in df.columns])
        .agg(F.count(F.lit(1)).alias("_copies"))
        .agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates"))
    )


def value_counts(df: DataFrame, column: str, limit: int = LISTED_VALUES) -> DataFrame:
    """Most frequent values, missing included; ties in value order."""
    counts = df.groupBy(known(df, column).alias("_v")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), F.asc_nulls_last("_v")).limit(limit).select(
        F.coalesce(F.col("_v").cast("string"), F.lit("nan")).alias("value"), "count"
    )


def uniqueness(df: DataFrame, column: str) -> DataFrame:
    """Distinct values (missing counts as one) and rows."""
    counts = df.groupBy(known(df, column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.count(F.lit(1)).alias("unique_count"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows")
    )


def _content_measures(df: DataFrame, columns: Sequence[str], tag: str) -> list[Column]:
    measures = []
    for i, c in enumerate(columns):
        text = col(c).cast("string")
        measures += [
            F.count(text).alias(f"{tag}p{i}"),
            F.avg(F.size(words(text))).alias(f"{tag}w{i}"),
            F.avg(F.char_length(text)).alias(f"{tag}l{i}"),
            # 128-bit digests: texts may be long, and only their equality matters
            F.count_distinct(F.md5(text)).alias(f"{tag}d{i}"),
        ]
    return measures


def _content_fields(i: int, tag: str) -> list[Column]:
    zero = F.lit(0.0)
    return [
        F.coalesce(f"{tag}w{i}", zero).alias("avg_words"),
        F.coalesce(f"{tag}l{i}", zero).alias("avg_len"),
        F.coalesce(F.try_divide(f"{tag}d{i}", f"{tag}p{i}"), zero).alias("uniqueness"),
        F.coalesce(F.try_divide(f"{tag}p{i}", "n"), zero).alias("non_null_ratio"),
    ]


def content_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per text column: mean words, mean characters, distinct share, present share."""
    columns = list(columns) if columns is not None else text_columns(df)
    if not columns:
        schema = "column string, avg_words double, avg_len double, uniqueness double, non_null_ratio double"
        return df.sparkSession.createDataFrame([], schema)
    lines = [F.struct(F.lit(c).alias("column"), *_content_fields(i, "c")) for i, c in enumerate(columns)]
    counted = df.agg(F.count(F.lit(1)).alias("n"), *_content_measures(df, columns, "c"))
    return counted.select(F.inline(F.array(*lines)))


def _valid_number(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, T.StringType):
        return to_number(col(column)).isNotNull()
    return known(df, column).isNotNull() if is_numeric(df, column) else F.lit(False)


def _valid_share(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.avg(F.when(_valid_number(df, column), 1.0).otherwise(0.0)), F.lit(0.0))


def numeric_ratio(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows that hold a number, or text that reads as one."""
    shares = df.agg(*[_valid_share(df, c).alias(f"r{i}") for i, c in enumerate(columns)])
    lines = [F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("valid_ratio")) for i, c in enumerate(columns)]
    return shares.select(F.inline(F.array(*lines)))


def column_facts(df: DataFrame, dataset: str, date_columns: Sequence[str], measured: Sequence[str]) -> DataFrame:
    """One row per column with its type and, for the ``measured`` ones, content measures.

    One aggregate that reads only the measured columns; the others show zeros.
    """
    texts = [c for c in text_columns(df) if c in measured]
    measures = [F.count(F.lit(1)).alias("n"), *_content_measures(df, texts, "c")]
    measures += [_valid_share(df, c).alias(f"r{i}") for i, c in enumerate(df.columns) if c in measured]
    zero = F.lit(0.0)
    blank = [zero.alias(c) for c in ("avg_words", "avg_len", "uniqueness", "non_null_ratio")]
    lines = [
        F.struct(
            F.lit(dataset).alias("dataset"),
            F.lit(i).alias("position"),
            F.lit(c).alias("column"),
            F.lit(type_name(df.schema[c].dataType)).alias("dtype"),
            F.lit(isinstance(df.schema[c].dataType, T.StringType)).alias("is_text"),
            F.lit(c in date_columns).alias("is_date"),
            F.col("n").alias("total_rows"),
            *(_content_fields(texts.index(c), "c") if c in texts else blank),
            (F.col(f"r{i}") if c in measured else zero).alias("valid_ratio"),
        )
        for i, c in enumerate(df.columns)
    ]
    return df.agg(*measures).select(F.inline(F.array(*lines)))


def looks_like_date(df: DataFrame, column: str, order_by: Sequence[Column | str]) -> DataFrame:
    """Timestamp type, or a date pattern among the first ten present values."""
    if type_name(df.schema[column].dataType) == "datetime64[ns]":
        return df.agg(F.lit(True).alias("is_date"))
    head = df.where(col(column).isNotNull()).orderBy(*order_by).limit(SNIFFED_ROWS)
    return head.agg(
        F.coalesce(F.bool_or(col(column).cast("string").rlike(DATE_LIKE)), F.lit(False)).alias("is_date")
    )

"""Cleaning and feature transforms.

Where a transform needs a constant of the column (mean, quartile, most frequent value), one
aggregate finds it and the returned frame is a plain projection or filter with that constant,
which Catalyst pushes to the scan. Nothing is joined to attach a constant.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions import text
from tillwise.functions.formula import formula
from tillwise.functions.text import as_text, col, is_float, is_numeric, known
from tillwise.plans import lookups
from tillwise.plans.ordering import fill_in_order, with_global_rank
from tillwise.plans.quantiles import exact_quantiles
from tillwise.plans.scratch import save

# fixed values
REVIEW_ALIASES = ["reviews_text", "review", "comments", "comment", "feedback", "text"]
RATING_ALIASES = ["reviews_rating", "rating", "stars", "score"]
TRUE_WORDS = ["true", "1", "yes"]
IQR_REACH = 1.5

# month first where both orders fit
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "yyyy/M/d",
    "d-M-yyyy",
    "d.M.yyyy",
    "d/M/yyyy",
    "d/M/yyyy H:mm",
    "d/M/yyyy H:mm:ss",
    "M/d/yyyy h:mm a",
    "M/d/yyyy h:mm:ss a",
    "d/M/yyyy h:mm a",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
    "d-MMM-yyyy",
    "d-MMM-yy",
    "M/d/yy",
    "d/M/yy",
    "yyyyMMdd",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm",
]

STRATEGIES = ("drop_col", "drop", "mean", "median", "mode", "ffill", "bfill")


def _replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[(new[c] if c in new else col(c)).alias(c) for c in df.columns])


# --- missing values ---


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep rows with every named column present; plain null tests, which reach the file scan."""
    tests = []
    for c in columns or df.columns:
        tests.append(col(c).isNotNull())
        if is_float(df, c):
            tests.append(~F.isnan(col(c)))
    return df.where(reduce(Column.__and__, tests)) if tests else df


def _fill_constants(df: DataFrame, constants: dict[str, object]) -> DataFrame:
    """Fill each column with its constant; a None constant leaves the column as it is."""
    return _replace_columns(
        df, {c: F.coalesce(known(df, c), F.lit(v)) for c, v in constants.items() if v is not None}
    )


def _means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Mean of every numeric column that has missing values (the others keep their type)."""
    columns = [c for c in columns if is_numeric(df, c)]
    if not columns:
        return {}
    measures = [m for c in columns for m in (F.avg(known(df, c).cast("double")), F.count_if(known(df, c).isNull()))]
    row = df.agg(*measures).first()
    return {c: row[2 * i] for i, c in enumerate(columns) if row[2 * i + 1]}


def fill_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _fill_constants(df, _means(df, columns))


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _fill_constants(df, {c: exact_quantiles(df, c, [0.5])[0] for c in _means(df, columns)})


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """The most frequent present value of every column that has any, the smallest of several; one job for all columns."""
    names = {c: f"_v{i}" for i, c in enumerate(columns)}
    slots = []
    for i, c in enumerate(columns):
        fields = [(known(df, c) if c == d else F.lit(None).cast(df.schema[d].dataType)).alias(names[d]) for d in columns]
        slots.append(F.struct(F.lit(i).alias("_i"), known(df, c).isNotNull().alias("_present"), *fields))
    if not slots:
        return {}
    stacked = df.select(F.inline(F.array(*slots))).where("_present")
    counts = stacked.groupBy("_i", *names.values()).agg(F.count(F.lit(1)).alias("_n"))
    best = [
        F.min(F.when(F.col("_i") == i, F.struct((-F.col("_n")).alias("n"), F.col(v).alias("v")))).alias(v)
        for i, v in enumerate(names.values())
    ]
    row = counts.agg(*best).first()
    return {c: row[v]["v"] for c, v in names.items() if row[v]}


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    modes = most_frequent(df, list(columns))
    filled = {c: F.coalesce(known(df, c), F.lit(v).cast(df.schema[c].dataType)) for c, v in modes.items()}
    return _replace_columns(df, filled)


def carry(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[Column | str],
    backward: bool = False,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Fill from the previous (or, backward, the next) present value in row order, over the
    whole table or within each key of ``partition_by``."""
    nulled = _replace_columns(df, {c: known(df, c) for c in columns})
    return fill_in_order(nulled, columns, order_by, backward, partition_by)


def fill_missing(
    df: DataFrame,
    strategy: str,
    columns: Sequence[str] | None = None,
    order_by: Sequence[Column | str] = (),
) -> DataFrame:
    """Apply one strategy to the named columns, by default to every column of the table."""
    columns = [c for c in (columns or df.columns) if c in df.columns]
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, expected one of {STRATEGIES}")
    if not columns:
        return df
    if strategy in ("ffill", "bfill"):
        if not order_by:
            raise ValueError(f"{strategy} needs order_by: rows of a table have no order of their own")
        return carry(df, columns, order_by, backward=strategy == "bfill")
    if strategy == "drop_col":
        return df.drop(*columns)
    action = {"drop": drop_missing, "mean": fill_mean, "median": fill_median, "mode": fill_mode}
    return action[strategy](df, columns)


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


# --- types and values ---


def _date_format(df: DataFrame, column: str) -> str:
    """The first known format that reads every present value; one value narrows the choice."""

    def read_by(pattern: str) -> Column:
        return F.try_to_timestamp(col(column), F.lit(pattern))

    some = df.where(col(column).isNotNull()).select(*[read_by(f).isNotNull() for f in DATE_FORMATS]).first()
    likely = [f for f, fits in zip(DATE_FORMATS, some or []) if fits]
    present, *read = df.agg(F.count(col(column)), *[F.count(read_by(f)) for f in likely]).first()
    if not present:
        return DATE_FORMATS[0]
    for pattern, n in zip(likely, read):
        if n == present:
            return pattern
    raise ValueError(f"cannot convert column {column!r} to datetime64[ns]: no date format fits all values")


def change_type(df: DataFrame, column: str, target: str) -> DataFrame:
    """Strict conversion to int64, float64, datetime64[ns], object or category.

    Raises ValueError when any value does not convert, before any result is produced.
    """
    if column not in df.columns:
        raise ValueError(f"column {column!r} does not exist")
    source = df.schema[column].dataType
    value, is_text = known(df, column), isinstance(source, T.StringType)
    moment = isinstance(source, (T.TimestampType, T.TimestampNTZType, T.DateType))
    if target == "datetime64[ns]":
        if moment:
            return df
        if not is_text:
            raise ValueError(f"cannot convert column {column!r} to {target}")
        pattern = _date_format(df, column)
        parsed = F.try_to_timestamp(value, F.lit(pattern))
        if "yy" in pattern.replace("yyyy", ""):
            # two-digit years from 69 on belong to the last century
            parsed = F.when(F.year(parsed) >= 2069, parsed - F.expr("INTERVAL 100 YEARS")).otherwise(parsed)
        return _replace_columns(df, {column: parsed})
    if target in ("object", "category"):
        meta = {"category": True} if target == "category" else {}
        new = as_text(df, column).alias(column, metadata=meta)
        return df.select(*[new if c == column else col(c) for c in df.columns])

    if target == "int64":
        if moment:
            epoch = F.lit("1970-01-01 00:00:00").cast(source)
            new = F.timestamp_diff("MICROSECOND", epoch, value) * 1000
        else:
            new = value.try_cast("bigint")
        wrong = new.isNull()
    elif target == "float64":
        new = text.to_number(value) if is_text else value.try_cast("double")
        wrong = new.isNull() & value.isNotNull()
    else:
        raise ValueError(f"unknown type {target!r}")
    bad = df.where(wrong).select(value.cast("string").alias("v")).limit(1).collect()
    if bad:
        raise ValueError(f"cannot convert column {column!r} to {target}: {bad[0]['v']!r}")
    return _replace_columns(df, {column: new})


def replace_value(df: DataFrame, column: str, find: object, replacement: object = None) -> DataFrame:
    """Replace whole values, both sides read as the column's type; empty replacement = missing."""
    data_type = df.schema[column].dataType

    def typed(raw: object) -> object:
        if isinstance(data_type, T.BooleanType):
            return str(raw).strip().lower() in TRUE_WORDS
        if isinstance(data_type, T.IntegralType):
            return int(raw)
        if isinstance(data_type, (T.FractionalType, T.DecimalType)):
            return float(raw)
        return str(raw)

    try:
        target = F.lit(typed(find))
        new = F.lit(None) if replacement in ("", None) else F.lit(typed(replacement))
    except ValueError:
        raise ValueError(f"cannot read {find!r} or {replacement!r} as {data_type.simpleString()}") from None
    hit = col(column).cast("string") == target if isinstance(data_type, T.DateType) else col(column) == target
    return _replace_columns(df, {column: F.when(hit, new.cast(data_type)).otherwise(col(column))})


def find_and_replace(df: DataFrame, column: str, find: str, replacement: str) -> DataFrame:
    """Replace whole values after turning the column into text."""
    value = as_text(df, column)
    return _replace_columns(df, {column: F.when(value == F.lit(find), F.lit(replacement)).otherwise(value)})


# --- encoding ---


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Code = place of the value among the sorted distinct texts, from 0; missing is "nan"."""
    order = df.columns
    named = _replace_columns(df, {column: F.coalesce(as_text(df, column), F.lit("nan"))})
    values = save(named.groupBy(col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_rows")))
    if lookups.is_small(values):
        codes = values.withColumn("_code", F.row_number().over(Window.orderBy("_value")).cast("long"))
    else:
        codes = with_global_rank(values, ["_value"], "_code")
    codes = codes.withColumn("_code", F.col("_code") - 1)
    joined = lookups.attach(named.withColumnRenamed(column, "_value"), codes, "_value", "_code", "_rows")
    return joined.select(*[F.col("_code").alias(column) if c == column else col(c) for c in order])


def one_hot(df: DataFrame, column: str, form: str = "columns") -> DataFrame:
    """The value as flags, one for each sorted distinct value but the first; missing sets none.

    ``columns`` makes a boolean column per value, so the plan grows with the number of values. ``sparse`` holds the
    same flags for any number of values: one column ``<column>_set`` names the flag that is set, NULL where none is.
    """
    value = known(df, column)
    if form == "sparse":
        first = df.agg(F.min(value).alias("v")).first()["v"]
        flag = F.when(value != F.lit(first), F.concat(F.lit(f"{column}_"), as_text(df, column)))
        return df.select(*[col(c) for c in df.columns if c != column], flag.alias(f"{column}_set"))
    if form != "columns":
        raise ValueError(f"unknown form {form!r}, expected columns or sparse")
    values = df.select(value.alias(column)).where(col(column).isNotNull()).distinct()
    listed = values.orderBy(col(column)).select(col(column).alias("v"), as_text(values, column).alias("t")).collect()
    flags = [F.coalesce(value == F.lit(r["v"]), F.lit(False)).alias(f"{column}_{r['t']}") for r in listed[1:]]
    return df.select(*[col(c) for c in df.columns if c != column], *flags)


# --- numbers ---


def trim_outliers(df: DataFrame, column: str) -> DataFrame:
    """Keep rows within 1.5 interquartile ranges of the quartiles; missing values go."""
    if column not in df.columns or not is_numeric(df, column):
        return df
    low, high = exact_quantiles(df, column, [0.25, 0.75])
    if low is None:
        return df.where(F.lit(False))
    reach = IQR_REACH * (high - low)
    return df.where(known(df, column).between(low - reach, high + reach))


def scale(df: DataFrame, column: str, method: str = "standard") -> DataFrame:
    """``minmax`` to [0, 1], anything else to zero mean and unit deviation; constant columns to 0."""
    if column not in df.columns or not is_numeric(df, column):
        return df
    value = known(df, column).cast("double")
    if method == "minmax":
        low, high = df.agg(F.min(value), F.max(value)).first()
        centre, width = low, (high - low) if low is not None else None
    else:
        centre, width = df.agg(F.avg(value), F.stddev_pop(value)).first()
    if centre is None:
        return _replace_columns(df, {column: value})
    return _replace_columns(df, {column: (value - F.lit(centre)) / F.lit(width or 1.0)})


def clean_text(df: DataFrame, column: str) -> DataFrame:
    return _replace_columns(df, {column: text.clean(col(column).cast("string"))})


def derive(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add (or overwrite) a column computed by a formula over the others."""
    if not name.strip() or not expression.strip():
        raise ValueError("column name and formula are required")
    return df.withColumn(name.strip(), formula(df, expression))


# --- names ---


def normalise_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip().lower().replace(" ", "_").replace(".", "_") for c in df.columns])


def rename_aliases(df: DataFrame) -> DataFrame:
    """Give the first alias found the standard name, unless the table has that name already."""
    for standard, aliases in (("review_text", REVIEW_ALIASES), ("rating", RATING_ALIASES)):
        found = next((a for a in aliases if a in df.columns), None)
        if found and standard not in df.columns:
            df = df.withColumnRenamed(found, standard)
    return df


def standardise(df: DataFrame) -> DataFrame:
    return rename_aliases(normalise_names(df))

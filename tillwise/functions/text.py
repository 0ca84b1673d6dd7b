"""Text and missing-value expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed value: anything but letters, digits, underscore and whitespace
NOT_WORD = r"(?U)[^\p{L}\p{N}_\s]"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(name: str) -> Column:
    """Column by exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    return F.nanvl(col(name), F.lit(None)) if is_float(df, name) else col(name)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Whitespace-separated pieces, none empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda piece: piece != "")


def clean(text: Column) -> Column:
    """Lower case, outer whitespace off, everything but word characters and whitespace out."""
    return F.regexp_replace(strip(F.lower(text)), NOT_WORD, "")


def to_number(text: Column) -> Column:
    """Double or NULL; stricter than a cast, which would accept suffixes such as ``1d``."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def as_text(df: DataFrame, name: str) -> Column:
    """The value as the reference table library prints it: 12345678.0 and 0.0001 in full, 1e+16, True, False, inf."""
    value = known(df, name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.when(value, "True").when(~value, "False")
    plain = value.cast("string")
    if not is_float(df, name):
        return plain
    size = F.abs(value)
    # all 17 digits of a double in this range fit the decimal
    full = F.regexp_replace(plain.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    full = F.when(full.endswith("."), F.concat(full, F.lit("0"))).otherwise(full)
    mantissa = F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", "")
    power = F.substring_index(plain, "E", -1)
    digits = F.regexp_replace(power, "^-", "")
    sign = F.when(power.startswith("-"), "-").otherwise("+")
    short = F.concat(mantissa, F.lit("e"), sign, F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits))
    infinite = F.when(value > 0, "inf").otherwise("-inf")
    written = F.when((size >= 1e-4) & (size < 1e16), full).otherwise(short)
    return F.when(size == float("inf"), infinite).when(plain.contains("E"), written).otherwise(plain)

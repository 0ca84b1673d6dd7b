"""CSV tables in and out."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.text import col, to_number
from tillwise.plans.scratch import save

# fixed values: texts that mean "missing"
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
    "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
TRUE_TEXT, FALSE_TEXT = ["True", "TRUE", "true"], ["False", "FALSE", "false"]
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"

FALLBACK_ENCODING = "ISO-8859-1"
MOMENT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


# holds what a line has beyond the header's fields
SURPLUS = "_surplus"


def _file_kinds(spark: SparkSession, path: str) -> dict[tuple[bool, bool], list[str]]:
    """Files by (all bytes are UTF-8, some quoted field spans lines); one short row per file reaches the driver."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    odd_quotes = F.pmod(F.regexp_count("value", F.lit('"')), F.lit(2)) == 1
    facts = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(odd_quotes).alias("spans"))
    kinds: dict[tuple[bool, bool], list[str]] = {}
    for row in facts.orderBy("file").collect():
        kinds.setdefault((row["utf8"] is not False, bool(row["spans"])), []).append(unquote(row["file"]))
    return kinds


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Every field as text. One pass over the lines settles, per file, the encoding (UTF-8, else Latin-1) and whether
    records may span lines; only such files are read whole instead of split. A line with more fields than the header
    is an error, as its surplus would be lost; one with fewer has missing values at its end."""
    kinds = _file_kinds(spark, path) or {(True, False): [path]}

    def read(utf8: bool, spans: bool, files: list[str]) -> DataFrame:
        encoding = "UTF-8" if utf8 else FALLBACK_ENCODING
        source = spark.read.options(header=True, quote='"', escape='"', multiLine=spans, encoding=encoding, mode="PERMISSIVE")
        files = [path] if len(kinds) == 1 else files
        fields = T.StructType([T.StructField(c, T.StringType()) for c in source.csv(files).columns])
        return source.schema(fields.add(SURPLUS, T.StringType())).csv(files)

    parts = [read(*kind, files) for kind, files in kinds.items()]
    table = reduce(DataFrame.unionByName, parts)
    extra = table.where(col(SURPLUS).isNotNull()).limit(1).collect()
    if extra:
        raise ValueError(f"{path}: a line has more fields than the {len(table.columns) - 1} of the header: {extra[0][:-1]!r}")
    return table.drop(SURPLUS)


def infer_types(df: DataFrame) -> DataFrame:
    """Missing tokens to NULL, then per column whole number, number, boolean or text.

    One aggregate counts for all columns what their values read as.
    """
    blanked = df.select(*[F.when(~col(c).isin(NA_TOKENS), col(c)).alias(c) for c in df.columns])

    def whole(c: str) -> Column:
        return F.when(col(c).rlike(WHOLE_NUMBER), F.trim(col(c)).try_cast("bigint"))

    def number(c: str) -> Column:
        infinite = F.lower(F.trim(col(c))).isin("inf", "-inf", "infinity", "-infinity")
        return F.when(infinite, col(c).try_cast("double")).otherwise(to_number(col(c)))

    def truth(c: str) -> Column:
        return F.when(col(c).isin(TRUE_TEXT), True).when(col(c).isin(FALSE_TEXT), False)

    kinds = {"present": col, "whole": whole, "number": number, "truth": truth}
    measures = [F.count(read(c)).alias(f"{kind}{i}") for i, c in enumerate(df.columns) for kind, read in kinds.items()]
    row = blanked.agg(*measures).first()
    typed = []
    for i, c in enumerate(df.columns):
        present = row[f"present{i}"]
        fits = [k for k in ("whole", "number", "truth") if row[f"{k}{i}"] == present]
        if present == 0:
            typed.append(col(c).cast("double").alias(c))
        elif fits:
            typed.append(kinds[fits[0]](c).alias(c))
        else:
            typed.append(col(c))
    return blanked.select(*typed)


def read_csv(spark: SparkSession, path: str, row_id: str | None = None) -> DataFrame:
    """Typed table from CSV files with a header; ``row_id`` names an added column in row order."""
    typed = infer_types(read_csv_text(spark, path))
    if row_id:
        # straight above the file scan, so it depends on the files alone
        typed = typed.withColumn(row_id, F.monotonically_increasing_id())
    # parsed for good; every later action reads the typed table
    return save(typed)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """One file per partition, with header; never gathers the table."""
    moments = {"timestampFormat": MOMENT, "timestampNTZFormat": MOMENT}
    df.write.mode(mode).options(header=True, quote='"', escape='"', **moments).csv(path)
    return path


def save_csv(df: DataFrame, path: str) -> DataFrame:
    """Write to a folder of its own and read that back, so the plan starts at the new files.

    The source being read is never overwritten.
    """
    return read_csv(df.sparkSession, write_csv(df, path))


def download_name(name: str) -> str:
    stem, dot, _ = name.rpartition(".")
    return f"{stem if dot else name}_preprocessed.csv"

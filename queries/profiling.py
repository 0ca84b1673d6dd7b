"""Profiles of columns and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import table
from tillwise.operators import profiling as p


def _shape(spark, folder):
    return p.shape(table(spark, folder, "lineitem"))


def _preview(spark, folder):
    orders = table(spark, folder, "orders")
    return p.preview(orders, ["o_orderkey"]).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


def _info(name):
    def run(spark, folder):
        return p.dataset_info(table(spark, folder, name))

    return run


def _info_sql(name, columns):
    """columns: (name, dtype, numeric?) as the engine calls them; text columns are categorical."""
    rows = []
    for i, (column, dtype, numeric) in enumerate(columns):
        category = "true" if dtype == "object" else f"count(DISTINCT {column}) < 20 AND count(*) > 0"
        rows.append(
            f"SELECT {i} AS position, '{column}' AS \"column\", count({column}) AS non_null, "
            f"count(*) - count({column}) AS null_count, '{dtype}' AS dtype, {str(numeric).lower()} AS is_numeric, "
            f"{category} AS is_categorical FROM {name}"
        )
    return " UNION ALL ".join(rows)


LINEITEM = [
    ("l_orderkey", "int64", True), ("l_partkey", "int64", True), ("l_suppkey", "int64", True),
    ("l_linenumber", "int32", True), ("l_quantity", "float64", True), ("l_extendedprice", "float64", True),
    ("l_discount", "float64", True), ("l_tax", "float64", True), ("l_returnflag", "object", False),
    ("l_linestatus", "object", False), ("l_shipdate", "datetime64[ns]", False),
]
EVENTS = [
    ("event_id", "int64", True), ("ts", "datetime64[ns]", False), ("user_id", "int64", True),
    ("event_type", "object", False), ("value", "float64", True), ("props", "object", False),
]


def _duplicates(spark, folder):
    return p.duplicate_rows(table(spark, folder, "lineitem"))


def _duplicate_visits(spark, folder):
    return p.duplicate_rows(table(spark, folder, "events").select("user_id", "event_type", "props"))


def _value_counts(spark, folder):
    return p.value_counts(table(spark, folder, "part"), "p_name")


def _value_counts_missing(spark, folder):
    orders = table(spark, folder, "orders")
    return p.value_counts(orders.select(F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority")), "priority")


def _uniqueness(spark, folder):
    orders = table(spark, folder, "orders")
    return p.uniqueness(orders.select(F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority")), "priority")


def _content(name, columns):
    def run(spark, folder):
        stats = p.content_stats(table(spark, folder, name), columns)
        measures = ["avg_words", "avg_len", "uniqueness", "non_null_ratio"]
        return stats.select("column", *[F.round(c, 6).alias(c) for c in measures])

    return run


def _content_sql(name, columns):
    rows = [
        f"SELECT '{c}' AS \"column\", "
        f"round(avg(len(regexp_extract_all({c}, '\\S+'))), 6) AS avg_words, "
        f"round(avg(length({c})), 6) AS avg_len, "
        f"round(count(DISTINCT {c})::DOUBLE / count({c}), 6) AS uniqueness, "
        f"round(count({c})::DOUBLE / count(*), 6) AS non_null_ratio FROM {name}"
        for c in columns
    ]
    return " UNION ALL ".join(rows)


def _numeric(spark, folder):
    # a text column that is a number for some rows only
    orders = table(spark, folder, "orders").select(
        "o_totalprice", "o_orderstatus", F.regexp_replace("o_orderpriority", "-LOW|-HIGH", "").alias("level")
    )
    ratios = p.numeric_ratio(orders, orders.columns)
    return ratios.select("column", F.round("valid_ratio", 6).alias("valid_ratio"))


def _date_like(spark, folder):
    orders = table(spark, folder, "orders").withColumn("day", F.date_format("o_orderdate", "M/d/yyyy"))
    parts = [
        p.looks_like_date(orders, c, ["o_orderkey"]).select(F.lit(c).alias("column"), "is_date")
        for c in ("day", "o_orderpriority", "o_orderdate")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {
    "table_shape": (_shape, "SELECT count(*) AS total_rows, 11 AS total_cols FROM lineitem"),
    "preview_rows": (
        _preview,
        "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 10",
    ),
    "dataset_info_lineitem": (_info("lineitem"), _info_sql("lineitem", LINEITEM)),
    "dataset_info_events": (_info("events"), _info_sql("events", EVENTS)),
    "duplicate_rows": (
        _duplicates,
        "SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) "
        "AS duplicates",
    ),
    "duplicate_visits": (
        _duplicate_visits,
        "SELECT (SELECT count(*) FROM events) - (SELECT count(*) FROM "
        "(SELECT DISTINCT user_id, event_type, props FROM events)) AS duplicates",
    ),
    "value_counts": (
        _value_counts,
        'SELECT p_name AS value, count(*) AS "count" FROM part GROUP BY p_name ORDER BY 2 DESC, 1 LIMIT 50',
    ),
    "value_counts_missing": (
        _value_counts_missing,
        "SELECT coalesce(nullif(o_orderpriority, '5-LOW'), 'nan') AS value, count(*) AS \"count\" "
        "FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    ),
    "uniqueness": (
        _uniqueness,
        "SELECT count(DISTINCT nullif(o_orderpriority, '5-LOW')) "
        "+ max(CASE WHEN nullif(o_orderpriority, '5-LOW') IS NULL THEN 1 ELSE 0 END) AS unique_count, "
        "count(*) AS total_rows FROM orders",
    ),
    "content_stats_documents": (
        _content("documents", ["text", "lang", "source"]),
        _content_sql("documents", ["text", "lang", "source"]),
    ),
    "content_stats_conversations": (
        _content("conversations", ["role", "text"]),
        _content_sql("conversations", ["role", "text"]),
    ),
    "numeric_ratio": (
        _numeric,
        "SELECT 'o_totalprice' AS \"column\", 1.0::DOUBLE AS valid_ratio UNION ALL "
        "SELECT 'o_orderstatus', round(avg(CASE WHEN try_cast(o_orderstatus AS DOUBLE) IS NULL THEN 0.0 ELSE 1.0 END), 6) "
        "FROM orders UNION ALL SELECT 'level', round(avg(CASE WHEN "
        "try_cast(regexp_replace(o_orderpriority, '-LOW|-HIGH', '') AS DOUBLE) IS NULL THEN 0.0 ELSE 1.0 END), 6) "
        "FROM orders",
    ),
    "date_like": (
        _date_like,
        "WITH head AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10) "
        "SELECT 'day' AS \"column\", bool_or(regexp_matches(strftime(o_orderdate, '%-m/%-d/%Y'), "
        "'\\d{2,4}[-/.]\\d{1,2}[-/.]\\d{1,2}')) AS is_date FROM head UNION ALL "
        "SELECT 'o_orderpriority', bool_or(regexp_matches(o_orderpriority, "
        "'\\d{2,4}[-/.]\\d{1,2}[-/.]\\d{1,2}')) FROM head UNION ALL SELECT 'o_orderdate', true",
    ),
}

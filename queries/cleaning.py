"""Cleaning and feature transforms.

The test tables hold no missing values. Where an operator needs some, values that a report
would call "not given" are read as missing on both sides: the lowest order priority, negative
balances, and event values under 100.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queries import table
from tillwise.operators import cleaning as c

PRIORITY = "nullif(o_orderpriority, '5-LOW')"
BALANCE = "CASE WHEN c_acctbal >= 0 THEN c_acctbal END"
VALUE = "CASE WHEN value >= 100 THEN value END"


def _orders(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", F.expr(PRIORITY).alias("priority"))


def _customers(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", F.expr(BALANCE).alias("balance"))


def _events(spark, folder):
    return table(spark, folder, "events").select("event_id", "ts", "user_id", F.expr(VALUE).alias("value"))


def _rounded(df, *columns, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in columns})


def _drop_column(spark, folder):
    return c.fill_missing(_orders(spark, folder), "drop_col", ["priority"])


def _drop_rows(spark, folder):
    return c.fill_missing(_orders(spark, folder), "drop", ["priority"])


def _mean(spark, folder):
    return _rounded(c.fill_missing(_customers(spark, folder), "mean", ["balance"]), "balance")


def _median(spark, folder):
    return _rounded(c.fill_missing(_customers(spark, folder), "median", ["balance"]), "balance")


def _mode(spark, folder):
    return c.fill_missing(_orders(spark, folder), "mode", ["priority"])


def _forward(spark, folder):
    return c.fill_missing(_events(spark, folder), "ffill", ["value"], ["ts", "event_id"]).select("event_id", "value")


def _backward(spark, folder):
    return c.fill_missing(_events(spark, folder), "bfill", ["value"], ["ts", "event_id"]).select("event_id", "value")


def _forward_per_user(spark, folder):
    filled = c.carry(_events(spark, folder), ["value"], ["ts", "event_id"], partition_by=["user_id"])
    return filled.select("event_id", "value")


def _whole_table(spark, folder):
    joined = table(spark, folder, "orders").select(
        "o_orderkey", F.expr(PRIORITY).alias("priority"),
        F.expr("CASE WHEN o_totalprice < 400000 THEN o_totalprice END").alias("price"),
    )
    return c.fill_missing(joined, "drop")


def _whole_table_mode(spark, folder):
    joined = table(spark, folder, "orders").select(
        "o_orderkey", F.expr(PRIORITY).alias("priority"),
        F.expr("nullif(o_orderstatus, 'P')").alias("status"),
    )
    return c.fill_missing(joined, "mode")


def _distinct(spark, folder):
    return c.drop_duplicates(table(spark, folder, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus"))


def _to_int(spark, folder):
    return c.change_type(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "int64")


def _to_date(spark, folder):
    text = table(spark, folder, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "M/d/yyyy H:mm").alias("placed")
    )
    dated = c.change_type(text, "placed", "datetime64[ns]")
    return dated.withColumn("placed", F.date_format("placed", "yyyy-MM-dd HH:mm:ss"))


def _to_float(spark, folder):
    text = table(spark, folder, "lineitem").select(F.col("l_quantity").cast("string").alias("quantity"))
    typed = c.change_type(text, "quantity", "float64")
    return typed.agg(F.sum("quantity").alias("total"), F.count("quantity").alias("present"))


def _replace(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_quantity")
    lines = c.replace_value(c.replace_value(lines, "l_quantity", "50", "0"), "l_returnflag", "N", "")
    return lines.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))


DATES = {
    "day first": "dd/MM/yyyy", "month name": "MMM d, yyyy", "day name": "d-MMM-yyyy", "am pm": "M/d/yyyy h:mm a",
    "compact": "yyyyMMdd", "short year": "MM/dd/yy", "iso": "yyyy-MM-dd'T'HH:mm:ss'Z'", "offset": "yyyy-MM-dd HH:mm:ss'+00:00'",
}


def _date_families(spark, folder):
    """The order dates written in eight ways and read back."""
    orders = table(spark, folder, "orders")
    parts = []
    for name, pattern in DATES.items():
        text = orders.select("o_orderkey", F.date_format("o_orderdate", pattern).alias("placed"))
        read = c.change_type(text, "placed", "datetime64[ns]")
        parts.append(read.groupBy(F.lit(name).alias("family")).agg(
            F.count("placed").alias("n"), F.sum(F.unix_date(F.col("placed").cast("date")).cast("long")).alias("days")
        ))
    return reduce(DataFrame.unionByName, parts)


def _texts_of_numbers(spark, folder):
    """Large and small doubles and truths as texts."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_totalprice") * 1000).alias("large"), (F.col("o_totalprice") / 1e10).alias("small"),
        (F.col("o_totalprice") > 1e5).alias("truth"),
    )
    for name in ("large", "small", "truth"):
        orders = c.change_type(orders, name, "object")
    return c.find_and_replace(orders, "truth", "True", "yes")


def _to_category(spark, folder):
    typed = c.change_type(table(spark, folder, "part").select("p_partkey", "p_size"), "p_size", "category")
    return typed.withColumn("marked", F.lit(typed.schema["p_size"].metadata.get("category", False)))


def _one_hot_sparse(spark, folder):
    return c.one_hot(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_name", "sparse")


def _iqr_documents(spark, folder):
    return c.trim_outliers(table(spark, folder, "documents").select("doc_id", "n_chars"), "n_chars")


def _whole_table_numbers(strategy):
    def run(spark, folder):
        orders = table(spark, folder, "orders").select(
            "o_orderkey", F.expr("CASE WHEN o_totalprice < 300000 THEN o_totalprice END").alias("price"),
            F.expr("CASE WHEN o_custkey % 3 > 0 THEN o_custkey / 4 END").alias("share"), F.expr(PRIORITY).alias("priority"),
        )
        return _rounded(c.fill_missing(orders, strategy), "price", "share")

    return run


def _whole_table_sql(measure):
    return (
        f"WITH t AS (SELECT o_orderkey, CASE WHEN o_totalprice < 300000 THEN o_totalprice END AS price, "
        f"CASE WHEN o_custkey % 3 > 0 THEN o_custkey / 4 END AS share, {PRIORITY} AS priority FROM orders) "
        f"SELECT o_orderkey, round(coalesce(price, (SELECT {measure}(price) FROM t)), 6) AS price, "
        f"round(coalesce(share, (SELECT {measure}(share) FROM t)), 6) AS share, priority FROM t"
    )


def _find_replace(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_size")
    return c.find_and_replace(parts, "p_size", "10", "ten")


def _labels(spark, folder):
    return c.label_encode(_orders(spark, folder), "priority")


def _labels_wide(spark, folder):
    return c.label_encode(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_name")


def _one_hot(spark, folder):
    return c.one_hot(table(spark, folder, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")


def _iqr(spark, folder):
    return c.trim_outliers(table(spark, folder, "lineitem").select("l_orderkey", "l_extendedprice"), "l_extendedprice")


def _minmax(spark, folder):
    return _rounded(c.scale(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "minmax"), "c_acctbal")


def _standard(spark, folder):
    return _rounded(c.scale(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal"), "c_acctbal")


def _clean_text(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return c.clean_text(documents, "text").select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("chars"))


def _derive(spark, folder):
    lines = table(spark, folder, "lineitem")
    made = c.derive(lines, "revenue", "l_extendedprice * (1 - l_discount) / l_quantity + 2 ** 3")
    return made.groupBy("l_returnflag").agg(F.round(F.sum("revenue"), 2).alias("revenue"))


def _names(spark, folder):
    supplier = table(spark, folder, "supplier").toDF(" S SuppKey", "S.Name ", "S Nation.Key", "S_AcctBal")
    return c.normalise_names(supplier)


def _aliases(spark, folder):
    reviews = table(spark, folder, "conversations").select("conv_id", F.col("turn").alias("Stars"), F.md5("text").alias("Text"))
    return c.standardise(reviews)


QUERIES = {
    "drop_column": (_drop_column, "SELECT o_orderkey FROM orders"),
    "drop_null_rows": (
        _drop_rows,
        f"SELECT o_orderkey, {PRIORITY} AS priority FROM orders WHERE {PRIORITY} IS NOT NULL",
    ),
    "fill_mean": (
        _mean,
        f"WITH t AS (SELECT c_custkey, {BALANCE} AS balance FROM customer) "
        "SELECT c_custkey, round(coalesce(balance, (SELECT avg(balance) FROM t)), 6) AS balance FROM t",
    ),
    "fill_median": (
        _median,
        f"WITH t AS (SELECT c_custkey, {BALANCE} AS balance FROM customer) "
        "SELECT c_custkey, round(coalesce(balance, (SELECT median(balance) FROM t)), 6) AS balance FROM t",
    ),
    "fill_mode": (
        _mode,
        f"WITH t AS (SELECT o_orderkey, {PRIORITY} AS priority FROM orders), "
        "m AS (SELECT priority FROM t WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1) "
        "SELECT o_orderkey, coalesce(priority, (SELECT priority FROM m)) AS priority FROM t",
    ),
    "fill_forward": (
        _forward,
        f"WITH t AS (SELECT event_id, ts, {VALUE} AS value FROM events) SELECT event_id, last_value(value IGNORE NULLS) "
        "OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM t",
    ),
    "fill_backward": (
        _backward,
        f"WITH t AS (SELECT event_id, ts, {VALUE} AS value FROM events) SELECT event_id, first_value(value IGNORE NULLS) "
        "OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM t",
    ),
    "fill_forward_per_user": (
        _forward_per_user,
        f"WITH t AS (SELECT event_id, ts, user_id, {VALUE} AS value FROM events) SELECT event_id, "
        "last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM t",
    ),
    "drop_null_rows_whole_table": (
        _whole_table,
        f"SELECT o_orderkey, {PRIORITY} AS priority, o_totalprice AS price FROM orders "
        f"WHERE {PRIORITY} IS NOT NULL AND o_totalprice < 400000",
    ),
    "fill_mode_whole_table": (
        _whole_table_mode,
        f"WITH t AS (SELECT o_orderkey, {PRIORITY} AS priority, nullif(o_orderstatus, 'P') AS status FROM orders), "
        "p AS (SELECT priority FROM t WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "
        "s AS (SELECT status FROM t WHERE status IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) "
        "SELECT o_orderkey, coalesce(priority, (SELECT priority FROM p)) AS priority, "
        "coalesce(status, (SELECT status FROM s)) AS status FROM t",
    ),
    "drop_duplicates": (_distinct, "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem"),
    "change_type_int": (_to_int, "SELECT c_custkey, trunc(c_acctbal)::BIGINT AS c_acctbal FROM customer"),
    "change_type_date": (
        _to_date,
        "SELECT o_orderkey, strftime(date_trunc('minute', o_orderdate), '%Y-%m-%d %H:%M:%S') AS placed FROM orders",
    ),
    "change_type_float": (_to_float, "SELECT sum(l_quantity) AS total, count(l_quantity) AS present FROM lineitem"),
    "replace_value": (
        _replace,
        "SELECT nullif(l_returnflag, 'N') AS l_returnflag, CASE WHEN l_quantity = 50 THEN 0 ELSE l_quantity END "
        "AS l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2",
    ),
    "find_and_replace": (
        _find_replace,
        "SELECT p_partkey, CASE WHEN p_size = 10 THEN 'ten' ELSE p_size::VARCHAR END AS p_size FROM part",
    ),
    "label_encode": (
        _labels,
        f"SELECT o_orderkey, dense_rank() OVER (ORDER BY coalesce({PRIORITY}, 'nan')) - 1 AS priority FROM orders",
    ),
    "label_encode_all_distinct": (
        _labels_wide,
        "SELECT c_custkey, dense_rank() OVER (ORDER BY c_name) - 1 AS c_name FROM customer",
    ),
    "one_hot": (
        _one_hot,
        "SELECT c_custkey, "
        + ", ".join(
            f"c_mktsegment = '{v}' AS \"c_mktsegment_{v}\"" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
        )
        + " FROM customer",
    ),
    "trim_outliers": (
        _iqr,
        "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b "
        "FROM lineitem) SELECT l_orderkey, l_extendedprice FROM lineitem, q "
        "WHERE l_extendedprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)",
    ),
    "scale_minmax": (
        _minmax,
        "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) "
        "AS c_acctbal FROM customer",
    ),
    "scale_standard": (
        _standard,
        "WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS d FROM customer) "
        "SELECT c_custkey, round((c_acctbal - m) / d, 6) AS c_acctbal FROM customer, s",
    ),
    "change_type_date_families": (
        _date_families,
        "SELECT family, count(*) AS n, sum(date_diff('day', DATE '1970-01-01', o_orderdate::DATE))::BIGINT AS days FROM orders, "
        f"(SELECT unnest({list(DATES)}) AS family) GROUP BY family",
    ),
    "numbers_as_text": (
        _texts_of_numbers,
        "SELECT o_orderkey, (o_totalprice * 1000)::VARCHAR AS large, (o_totalprice / 1e10)::VARCHAR AS small, "
        "CASE WHEN o_totalprice > 1e5 THEN 'yes' ELSE 'False' END AS truth FROM orders",
    ),
    "change_type_category": (_to_category, "SELECT p_partkey, p_size::VARCHAR AS p_size, true AS marked FROM part"),
    "one_hot_sparse": (
        _one_hot_sparse,
        "SELECT c_custkey, CASE WHEN c_name > (SELECT min(c_name) FROM customer) THEN 'c_name_' || c_name END AS c_name_set "
        "FROM customer",
    ),
    "trim_outliers_documents": (
        _iqr_documents,
        "WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents) "
        "SELECT doc_id, n_chars FROM documents, q WHERE n_chars BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)",
    ),
    "fill_mean_whole_table": (_whole_table_numbers("mean"), _whole_table_sql("avg")),
    "fill_median_whole_table": (_whole_table_numbers("median"), _whole_table_sql("median")),
    "clean_text": (
        _clean_text,
        "WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), "
        "'[^\\p{L}\\p{N}_\\s]', '', 'g') AS x FROM documents) SELECT doc_id, md5(x) AS digest, length(x) AS chars FROM t",
    ),
    "derive_column": (
        _derive,
        "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount) / l_quantity + 8), 2) AS revenue "
        "FROM lineitem GROUP BY l_returnflag",
    ),
    "normalise_names": (
        _names,
        "SELECT s_suppkey, s_name, s_nationkey AS s_nation_key, s_acctbal FROM supplier",
    ),
    "standardise_review_names": (
        _aliases,
        "SELECT conv_id, turn AS rating, md5(text) AS review_text FROM conversations",
    ),
}

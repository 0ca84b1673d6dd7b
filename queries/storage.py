"""CSV files, the run log and edit history, through the shared folder."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from queries import customers, reviews, table
from tillwise.operators import cleaning as c
from tillwise.operators import segments as sg
from tillwise.operators.history import EditHistory
from tillwise.operators.sentiment import scored_table
from tillwise.plans.scratch import shared_folder
from tillwise.sources.runlog import RunLog
from tillwise.sources.tables import read_csv, save_csv, write_csv


def _path(spark):
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _csv_table(spark, folder):
    return save_csv(table(spark, folder, "part"), _path(spark))


def _csv_texts(spark, folder):
    """Whole documents with their quotes and line breaks, out and back."""
    back = save_csv(table(spark, folder, "documents"), _path(spark))
    return back.select("doc_id", F.md5("text").alias("digest"), "lang", "source", "n_chars")


def _csv_types(spark, folder):
    """Dates stay text on reading, as no column is parsed as a date unasked."""
    back = save_csv(table(spark, folder, "orders"), _path(spark))
    spark_types = [(f.name, f.dataType.simpleString()) for f in back.schema]
    kinds = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(k).alias("type")) for n, k in spark_types])
    return back.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(kinds))


def _scored_export(spark, folder):
    path = write_csv(scored_table(reviews._documents(spark, folder), "text", *reviews.words(spark)), _path(spark))
    back = read_csv(spark, path)
    return back.select("doc_id", F.md5("text").alias("digest"), "source", "sentiment", "compound_score")


def _history(spark, folder):
    log = RunLog(spark, _path(spark))
    start = dt.datetime(2024, 1, 1, 9, 0)
    for i, name in enumerate(("orders", "lineitem", "documents", "events")):
        log.upload(name, f"{name}.csv", table(spark, folder, name), start + dt.timedelta(hours=i))
    orders = table(spark, folder, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    log.record("orders", "segmentation", orders, start + dt.timedelta(hours=5))
    log.opened("orders", start + dt.timedelta(hours=6))
    log.delete("documents", start + dt.timedelta(hours=7))
    return log.datasets()


def _restored(spark, folder):
    log = RunLog(spark, _path(spark))
    orders = table(spark, folder, "orders")
    log.upload("orders", "orders.csv", orders, dt.datetime(2024, 1, 1, 9, 0))
    old = orders.groupBy(F.col("o_orderstatus").alias("Segment")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("o_totalprice").alias("revenue")
    )
    summary = sg.segment_summary(sg.rfm_segments(*customers._orders(spark, folder), find_whales=False))
    log.record("orders", "segmentation", old, dt.datetime(2024, 1, 1, 10, 0))
    ordered = summary.orderBy(F.desc("customers"), "Segment")
    log.record("orders", "segmentation", ordered, dt.datetime(2024, 1, 1, 11, 0))
    return log.restore("orders", "segmentation", summary.schema)


def _edits(spark, folder):
    """Fill, encode, undo the encoding, derive, save to CSV and go on from there with the same types."""
    history = EditHistory(
        table(spark, folder, "orders").select(
            "o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"), "o_totalprice",
            F.col("o_orderdate").cast("timestamp").alias("placed"), F.lpad(F.col("o_custkey").cast("string"), 8, "0").alias("code"),
            F.when(F.col("o_orderstatus") == "F", "NA").otherwise(F.col("o_orderstatus")).alias("status"),
        )
    )
    history.apply(c.change_type, "status", "category")
    history.apply(c.fill_missing, "mode", ["priority"])
    history.apply(c.label_encode, "priority")
    history.undo()
    history.apply(c.derive, "tax", "o_totalprice * 0.25")
    history.save(_path(spark))
    done = history.apply(c.replace_value, "priority", "1-URGENT", "urgent")
    return done.withColumn("status_is_category", F.lit(done.schema["status"].metadata.get("category", False)))


PLAIN_SEGMENTS = f"{customers.PLAIN} {customers._segments_sql('o_custkey', 'calm')}"

QUERIES = {
    "csv_round_trip": (_csv_table, "SELECT * FROM part"),
    "csv_round_trip_texts": (_csv_texts, "SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents"),
    "csv_types": (
        _csv_types,
        "SELECT (SELECT count(*) FROM orders) AS rows, c AS \"column\", t AS type FROM (VALUES ('o_orderkey', 'bigint'), "
        "('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'), ('o_orderdate', 'string'), "
        "('o_orderpriority', 'string')) v(c, t)",
    ),
    "scored_export": (
        _scored_export,
        f"WITH {reviews.DOCUMENTS} SELECT doc_id, md5(body) AS digest, source, sentiment, compound_score FROM classed",
    ),
    "dataset_history": (
        _history,
        "SELECT * FROM (SELECT 'orders' AS dataset_id, 'orders.csv' AS display_name, count(*) AS total_rows, 6 AS total_cols, "
        "'Jan 01, 2024 09:00 AM' AS uploaded_at, 'Jan 01, 2024 03:00 PM' AS last_opened_at, true AS has_segmentation, "
        "false AS has_recommendation, false AS has_reviews FROM orders UNION ALL SELECT 'lineitem', 'lineitem.csv', count(*), 11, "
        "'Jan 01, 2024 10:00 AM', 'Jan 01, 2024 10:00 AM', false, false, false FROM lineitem UNION ALL "
        "SELECT 'events', 'events.csv', count(*), 6, 'Jan 01, 2024 12:00 PM', 'Jan 01, 2024 12:00 PM', false, false, false "
        "FROM events)",
    ),
    "restored_result": (
        _restored,
        f"WITH {customers.ORDERS}, {PLAIN_SEGMENTS} SELECT \"Segment\", count(*) AS customers, "
        'round(sum("Monetary"), 2) AS revenue, row_number() OVER (ORDER BY count(*) DESC, "Segment") AS position '
        'FROM segments GROUP BY "Segment"',
    ),
    "edit_history": (
        _edits,
        "WITH t AS (SELECT *, nullif(o_orderpriority, '5-LOW') AS p FROM orders), m AS (SELECT p FROM t WHERE p IS NOT NULL "
        "GROUP BY p ORDER BY count(*) DESC, p LIMIT 1), f AS (SELECT o_orderkey, coalesce(p, (SELECT p FROM m)) AS priority, "
        "o_totalprice, o_orderdate::TIMESTAMP AS placed, lpad(o_custkey::VARCHAR, 8, '0') AS code, "
        "CASE WHEN o_orderstatus = 'F' THEN 'NA' ELSE o_orderstatus END AS status FROM t) "
        "SELECT o_orderkey, CASE WHEN priority = '1-URGENT' THEN 'urgent' ELSE priority END AS priority, "
        "o_totalprice, o_totalprice * 0.25 AS tax, placed, code, status, true AS status_is_category FROM f",
    ),
}

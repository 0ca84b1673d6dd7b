"""Queries over the test tables with the SQL they are compared to.

Each module maps a name to (query, sql); sql is None where SQL cannot express the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def all_queries() -> dict[str, tuple[Query, str | None]]:
    from queries import cleaning, customers, products, profiling, reviews, roles, storage

    found: dict[str, tuple[Query, str | None]] = {}
    for module in (profiling, cleaning, customers, products, reviews, roles, storage):
        found.update(module.QUERIES)
    return found

"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import SparkSession

import tillwise


def send_code_to_workers() -> None:
    """Pickle this package's functions by value, so Python workers need not have it installed."""
    cloudpickle.register_pickle_by_value(tillwise)


def build_session(app_name: str = "tillwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC timestamps.

    On a cluster pass ``spark.checkpoint.dir`` (a folder every executor reaches) through
    ``conf`` or spark-defaults; multi-pass operators keep their intermediate tables there.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

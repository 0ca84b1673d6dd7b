"""Log of datasets and module results: an append-only Parquet table.

Nothing is updated in place; what holds now is an aggregate over the events of a dataset.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.plans.ordering import with_global_rank

SCHEMA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("event", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("total_rows", T.LongType()),
        T.StructField("total_cols", T.IntegerType()),
        T.StructField("module", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("place", T.LongType()),
        T.StructField("result", T.StringType()),
    ]
)
MODULES = ("segmentation", "recommendation", "reviews")
SHOWN_TIME = "MMM dd, yyyy hh:mm a"


@dataclass
class RunLog:
    spark: SparkSession
    path: str

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def _append(self, at: dt.datetime | None = None, **fields: object) -> None:
        row = Row(**{f.name: None for f in SCHEMA} | {"at": at or dt.datetime.now()} | fields)
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def upload(self, dataset_id: str, display_name: str, df: DataFrame, at: dt.datetime | None = None) -> None:
        self._append(
            at, dataset_id=dataset_id, event="upload", display_name=display_name,
            total_rows=df.count(), total_cols=len(df.columns),
        )

    def opened(self, dataset_id: str, at: dt.datetime | None = None) -> None:
        self._append(at, dataset_id=dataset_id, event="open")

    def delete(self, dataset_id: str, at: dt.datetime | None = None) -> None:
        self._append(at, dataset_id=dataset_id, event="delete")

    def record(self, dataset_id: str, module: str, result: DataFrame, at: dt.datetime | None = None) -> None:
        """Keep a module's report in its order: one event for the run, one JSON row for each row of the report."""
        at, run_id = at or dt.datetime.now(), uuid.uuid4().hex
        rows = result.select(
            F.lit(dataset_id).alias("dataset_id"), F.lit("row").alias("event"), F.lit(at).alias("at"),
            F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("long").alias("total_rows"),
            F.lit(None).cast("int").alias("total_cols"), F.lit(module).alias("module"), F.lit(run_id).alias("run_id"),
            # partitions of an ordered table are in its order, so these numbers are too
            F.monotonically_increasing_id().alias("place"), F.to_json(F.struct(*result.columns)).alias("result"),
        )
        rows.write.mode("append").parquet(self.path)
        # the run counts only once its rows are there
        self._append(at, dataset_id=dataset_id, event="result", module=module, run_id=run_id)

    def _current(self) -> DataFrame:
        """Events of datasets that are present: those since the last delete."""
        gone = self.events().where("event = 'delete'").groupBy("dataset_id").agg(F.max("at").alias("gone"))
        kept = self.events().join(gone, "dataset_id", "left").where("gone IS NULL OR at > gone")
        return kept.drop("gone")

    def datasets(self) -> DataFrame:
        """Present datasets, newest opened first, with display dates and has-result flags."""
        uploaded = F.col("event") == "upload"
        has = [
            F.bool_or(F.col("module").eqNullSafe(m)).alias(f"has_{m}") for m in MODULES
        ]
        latest = self._current().where("event <> 'row'").groupBy("dataset_id").agg(
            F.max_by("display_name", F.when(uploaded, F.col("at"))).alias("display_name"),
            F.max_by("total_rows", F.when(uploaded, F.col("at"))).alias("total_rows"),
            F.max_by("total_cols", F.when(uploaded, F.col("at"))).alias("total_cols"),
            F.min(F.when(uploaded, F.col("at"))).alias("_uploaded"),
            F.max(F.when(F.col("event").isin("upload", "open"), F.col("at"))).alias("_opened"),
            *has,
        )
        return latest.orderBy(F.desc("_opened"), "dataset_id").select(
            "dataset_id", "display_name", "total_rows", "total_cols",
            F.date_format("_uploaded", SHOWN_TIME).alias("uploaded_at"),
            F.date_format("_opened", SHOWN_TIME).alias("last_opened_at"),
            *[f"has_{m}" for m in MODULES],
        )

    def last_results(self) -> DataFrame:
        """(dataset_id, module, run_id): the newest run of every module."""
        results = self._current().where("event = 'result'")
        return results.groupBy("dataset_id", "module").agg(F.max_by("run_id", "at").alias("run_id"))

    def restore(self, dataset_id: str, module: str, schema: T.StructType) -> DataFrame:
        """The newest result of one module as a table again, with its row order in ``position`` from 1; empty without any."""
        mine = self.last_results().where((F.col("dataset_id") == dataset_id) & (F.col("module") == module))
        rows = self.events().where("event = 'row'").select("run_id", "place", "result")
        rows = rows.join(mine.select("run_id"), "run_id", "left_semi")
        placed = with_global_rank(rows.select("place", "result"), ["place"], "position")
        return placed.select(F.from_json("result", schema).alias("r"), "position").select("r.*", "position")

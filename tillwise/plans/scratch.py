"""Intermediate tables that outlive the executors that made them.

A multi-pass operator reads its intermediate result more than once. Writing it as Parquet to
the shared folder cuts the lineage, survives lost executors, keeps column pruning, and gives
Catalyst a true size to choose joins by.

A scope owns the tables written while it is open. ``temporary()`` drops its own on leaving, but for those handed over to the scope
around it, so an operator of many passes leaves only the table its lazy result reads. A caller does the same around a whole job:

    with temporary():
        operator(...).write.parquet(...)
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session; a private one only on a local master without any."""
    folder = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="tillwise-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Scope:
    """Tables that ``save`` wrote while the scope was open (a ``with`` block, more than once if need be); ``drop`` removes them."""

    def __init__(self) -> None:
        self.tables: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> Scope:
        _open.set((*_open.get(), self))
        return self

    def __exit__(self, *error: object) -> None:
        _open.set(_open.get()[:-1])

    def hand_over(self, df: DataFrame) -> DataFrame:
        """``df`` written as a table that the scope around this one owns, or nobody if there is none."""
        inside = _open.get()
        _open.set(inside[: inside.index(self)])
        try:
            return save(df)
        finally:
            _open.set(inside)

    def is_read_by(self, df: DataFrame) -> bool:
        return any(path in file for file in df.inputFiles() for _, path in self.tables)

    def drop(self) -> None:
        tables, self.tables = self.tables, []
        for spark, path in tables:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


# the scopes that are open, innermost last
_open: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=())


@contextlib.contextmanager
def temporary() -> Iterator[Scope]:
    """A scope whose tables are dropped on leaving it, by an error too. Frames that read them must not be used after that."""
    scope = Scope()
    try:
        with scope:
            yield scope
    finally:
        scope.drop()


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back; the innermost open scope owns it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tillwise-{uuid.uuid4().hex}"
    if scopes := _open.get():
        scopes[-1].tables.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

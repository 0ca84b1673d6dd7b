"""The corpus pipeline: five stages from raw documents to the mixed training set, each written before the next reads it."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillwise.functions.text import col
from tillwise.llm import decontaminate, mixing, odd_sketch, quality, toxicity
from tillwise.plans.scratch import Scope, save

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# tables that the result of the last stage reads
_last = Scope()


def _owning(stage: Stage) -> Stage:
    """``stage``, dropping the tables of the stage before it, whose result has been written when this one reads it again.

    Where ``docs`` still reads one of those tables they all stay.
    """

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not _last.is_read_by(docs):
            _last.drop()
        with _last:
            return stage(spark, docs, sf_dir)

    return run_stage


@_owning
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge(docs).where("kept").select(*map(col, docs.columns))


@_owning
def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(docs, labels).where("predicted = 0").select(*map(col, docs.columns))


@_owning
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return odd_sketch.drop_near_duplicates(docs)


@_owning
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_owning
def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy taken, with its shard and place there."""
    return mixing.draw(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing", mixed_sources),
]

# the toxicity model and the hashed order of the mix have no SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed documents of ``sf_dir``. Of the tables in between, those stay that the result reads."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scope()
    for _, stage in STAGES[:-1]:
        written = Scope()
        with written:
            docs = save(stage(spark, docs, sf_dir))
        before.drop()
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact duplicates with the heavy hitters split off.

A Misra-Gries summary of every task, summed over the tasks, names the few digests that may hold a large share of all rows.
An exact count verifies them, and the verified winners are broadcast, so rows of a huge group are settled where they are
read. The remaining digests, none of them large, go through one ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwise.functions.text import col
from tillwise.llm.common import lower_ascii, whole
from tillwise.plans.scratch import save

# a digest with more than one row in SHARE is split off; each task counts with COUNTERS counters
SHARE, COUNTERS = 1000, 4000
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def misra_gries(counts: dict[int, int], fresh: np.ndarray, counters: int = COUNTERS) -> dict[int, int]:
    """The summary after more hashes: at most ``counters`` of them, each counted too low by at most rows / (counters + 1)."""
    values, n = np.unique(fresh, return_counts=True)
    for value, more in zip(values.tolist(), n.tolist(), strict=True):
        counts[value] = counts.get(value, 0) + more
    if len(counts) <= counters:
        return counts
    sizes = np.fromiter(counts.values(), np.int64, len(counts))
    # the largest count that does not fit is taken off all of them
    less = int(np.partition(sizes, len(sizes) - counters - 1)[len(sizes) - counters - 1])
    return {value: size - less for value, size in counts.items() if size > less}


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for batch in batches:
            counts = misra_gries(counts, batch.column(0).to_numpy(zero_copy_only=False), counters)
        yield pa.RecordBatch.from_pydict({"h": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    return run


def heavy_hitters(digests: DataFrame, digest: str = "digest", share: int = SHARE, counters: int = COUNTERS) -> DataFrame:
    """(h): 64-bit hashes of all digests with more than one row in ``share``, and of some others; a bounded number.

    A summary misses at most rows / (counters + 1) of a digest, so the counts of one that is heavy add up to
    more than rows / share less that. Counts add up to the number of rows at most, which bounds the result.
    """
    rows = digests.count()
    least = max(1.0, rows / share - rows / (counters + 1))
    found = digests.select(F.xxhash64(digest).alias("h")).mapInArrow(_summaries(counters), "h long, n long")
    return found.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("h")


def _marked(docs: DataFrame, doc_id: str, text: str, keep: list[str]) -> DataFrame:
    """row (the kept columns), id, digest and n (a number for telling equal rows apart), saved so that n stays."""
    return save(docs.select(
        F.struct(*map(col, keep)).alias("row"), col(doc_id).alias("id"),
        F.unhex(F.sha2(lower_ascii(whole(col(text).cast("string"))).cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("n"),
    ))


def _settled(marked: DataFrame, share: int, counters: int) -> DataFrame:
    """``marked`` with best (id and n of the row that stays) and group_size."""
    # a missing id is less than any other in a maximum of structs
    best, size = F.max(F.struct("id", "n")), F.count(F.lit(1))
    candidates = heavy_hitters(marked, "digest", share, counters)
    # at most 1 / (1 / share - 1 / counters) hashes, whatever the input
    exact = marked.join(F.broadcast(candidates), F.xxhash64("digest") == F.col("h"), "left_semi")
    winners = save(exact.groupBy("digest").agg(best.alias("best"), size.alias("group_size")).where("group_size > 1"))
    hot = marked.join(F.broadcast(winners), "digest")
    rest = marked.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    group = Window.partitionBy("digest")
    rest = rest.withColumns({"best": best.over(group), "group_size": size.over(group)})
    return hot.unionByName(rest.select(*hot.columns))


def exact_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None,
    share: int = SHARE, counters: int = COUNTERS,
) -> DataFrame:
    """Columns ``keep`` (all by default) with keep_id, group_size, kept and text_sha256, one row per row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; a missing text is empty, and all empty texts are one group. The row
    with the largest doc_id stays, a missing doc_id being the least; of rows that repeat the id as well, exactly one. keep_id is
    missing where no row of the group has an id. Empty tables give empty results; columns named as results are replaced.
    ``keep`` travels through the shuffle: name few columns, or use ``drop_exact_duplicates`` for whole rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULTS]
    settled = _settled(_marked(docs, doc_id, text, keep), share, counters)
    return settled.select(
        *[F.col("row")[c].alias(c) for c in keep], F.col("best.id").alias("keep_id"), "group_size",
        (F.col("best.n") == F.col("n")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = SHARE, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, as they are: same columns, one row of each group (see ``exact_duplicates``).

    Whole rows are written once; only ids and digests are shuffled, and after them the numbers of the rows that go.
    """
    marked = _marked(docs, doc_id, text, docs.columns)
    gone = _settled(marked.select("id", "digest", "n"), share, counters).where(F.col("best.n") != F.col("n"))
    stay = marked.join(gone.select("n"), "n", "left_anti")
    return stay.select(*[F.col("row")[c].alias(c) for c in docs.columns])

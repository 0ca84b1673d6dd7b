"""Runs of words that repeat with a period, found by a sparse dynamic programme over diagonals.

Diagonal d compares every word with the one d words before it; a run of period d is a long match on it. To keep the diagonals
sparse, a place steps a diagonal only where a window of W words (1, 2, 4, ...) returns, and only the one of its nearest earlier
occurrence: inside a run of smallest period q, a window of q words or more last occurred exactly q words ago. So diagonals in
(W/2, W] are stepped by windows of W words, each step adds one to the match length of the active diagonal, and where a
diagonal is not stepped again it ends and, if long enough, emits its run. Windows that occur once are dropped, and with them all
longer ones that hold them, so ordinary text costs little and a word repeated a million times one step per word and width.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.text import col
from tillwise.llm.common import in_small_batches, whole

# fixed values: a run has at least LEAST words and PERIODS periods
LEAST, PERIODS = 6, 4
# words that are looked at together; one text may have more
TOGETHER = 500_000
RESULTS = ("n_words", "runs", "collapsed")
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def find_runs(ids: np.ndarray) -> np.ndarray:
    """(start, length, period) rows, by start and period, of all runs in a sequence of word numbers.

    Several texts may follow each other if their numbers differ: no window over a border returns.
    """
    found = []
    places = np.arange(len(ids), dtype=np.int64)
    rank = np.asarray(ids, np.int64)
    at = np.full(len(ids) + 1, -1, np.int64)
    width = 1
    while len(places):
        order = np.argsort(rank, kind="stable")
        ranked, placed = rank[order], places[order]
        again = ranked[1:] == ranked[:-1]
        lag = np.where(again, placed[1:] - placed[:-1], 0)
        steps = (lag > width // 2) & (lag <= width)
        found.append(_diagonals(placed[1:][steps], lag[steps], width))
        # a window of twice the width returns only if both of its halves do
        returns = np.r_[again, False] | np.r_[False, again]
        live = np.sort(placed[returns])
        at[places] = -1
        at[placed[returns]] = ranked[returns]
        first = live[live + width < len(ids)]
        second = at[first + width]
        places, second = first[second >= 0], second[second >= 0]
        pair = at[places] * (int(ranked[-1]) + 1) + second
        at[live] = -1
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64).ravel()
        width *= 2
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _diagonals(places: np.ndarray, lags: np.ndarray, width: int) -> np.ndarray:
    """Runs of the diagonals that windows of ``width`` words step at ``places``, one lag each."""
    order = np.argsort(places)
    places, lags = places[order], lags[order]
    if not len(places):
        return np.empty((0, 3), np.int64)
    # an active diagonal ends where the next place does not step it
    ends = np.flatnonzero(np.r_[(np.diff(places) != 1) | (np.diff(lags) != 0), True])
    begins = np.r_[0, ends[:-1] + 1]
    match, lag = ends - begins + width, lags[begins]
    runs = np.stack([places[begins] - lag, match + lag, lag], axis=1)
    return runs[runs[:, 1] >= np.maximum(LEAST, PERIODS * lag)]


def _looked_at(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and runs of each text; words are numbered apart for every text."""
    split, numbers, lengths = [], [], []

    def flush() -> Iterator[tuple[list[bytes], np.ndarray]]:
        ids = np.fromiter((n for part in numbers for n in part), np.int64, sum(lengths))
        runs = find_runs(ids)
        borders = np.r_[0, np.cumsum(lengths)]
        cuts = np.searchsorted(runs[:, 0], borders)
        for i, found in enumerate(split):
            own = runs[cuts[i] : cuts[i + 1]]
            yield found, own - np.array([borders[i], 0, 0])

    number = count()
    for text in texts:
        # bytes are split at blanks, tabs and line ends only
        found = text.split()
        known: dict[bytes, int] = defaultdict(number.__next__)
        split.append(found)
        numbers.append(list(map(known.__getitem__, found)))
        lengths.append(len(found))
        if sum(lengths) >= TOGETHER:
            yield from flush()
            split, numbers, lengths, number = [], [], [], count()
    if split:
        yield from flush()


def collapse(found: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by blanks, without those that a run holds after its first period."""
    if not len(runs):
        return b" ".join(found)
    steps = np.zeros(len(found) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    stays = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
    return b" ".join([found[i] for i in stays.tolist()])


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with n_words, runs (start, length, period by start and period) and the collapsed text.

    Words are maximal runs of anything but blanks, tabs and line ends, numbered from 0. A run is a stretch of words with
    smallest period q and at least max(6, 4 q) words that no neighbouring word extends; all of them are returned, and the
    collapsed text leaves out the words that a run holds after its first q. A missing or empty text has no words, no runs and
    an empty collapsed text. Rows pass one by one, so repeated rows and empty tables need no care; columns of the input
    named as results are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in RESULTS]
    taken = in_small_batches(docs).select(whole(col(text).cast("string")).cast("binary").alias("body"), F.struct(*map(col, keep)).alias("row"))
    schema = T.StructType([
        taken.schema["row"], T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few hundred texts at a time: words take several times the memory of their text
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                words, runs, texts, offsets = [], [], [], [0]
                for found, own in _looked_at(part.column(0).to_pylist()):
                    words.append(len(found))
                    runs.append(own)
                    texts.append(collapse(found, own))
                    offsets.append(offsets[-1] + len(own))
                flat = np.concatenate(runs)
                listed = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()),
                    pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], names=RUN.names),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(words, pa.int64()), listed, pa.array(texts, pa.binary()).cast(pa.string())],
                    names=schema.names,
                )

    out = taken.mapInArrow(run, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in keep], *RESULTS)

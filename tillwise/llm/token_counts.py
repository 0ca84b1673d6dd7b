"""Token counts under a byte-level pair-merge vocabulary, by rank-synchronous merging of whole batches.

Each distinct pre-token of a batch is a row of a ragged array of symbol ids. In every round each row finds its
lowest-ranked pair and merges all of that pair's places at once; rows with nothing left to merge retire.
What survives in a row is its token count. The same counts as the vocabulary's own library, checked in the tests.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.text import col
from tillwise.llm.common import in_small_batches, whole

# fixed value: the published pre-token pattern of byte-level vocabularies
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
REMEMBERED = 300_000
# longer pre-tokens would make their row's share of a batch too large; they are merged in batches of their own
BATCH_BYTES = 4 << 20


class MergeTable:
    """Pair -> (rank, merged id), as sorted arrays for looking up many pairs at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.byte_ids = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        self.width = len(vocab)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.merged = keys[order], order.astype(np.int64), merged[order]
        self.by_rank = merged
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], len(self.keys))


def merged_sizes(pieces: list[bytes], table: MergeTable) -> np.ndarray:
    """Symbols left of each piece once no pair of the table stands in it."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = table.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    row = np.repeat(np.arange(len(pieces)), sizes)
    out = sizes.copy()
    none = len(table.keys)
    while len(symbols) > 1:
        ranks = np.full(len(symbols), none, np.int64)
        inside = np.flatnonzero(row[1:] == row[:-1])
        ranks[inside] = table.rank(symbols[inside], symbols[inside + 1])
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        lengths = np.diff(np.r_[starts, len(row)])
        lowest = np.minimum.reduceat(ranks, starts)
        best = np.repeat(lowest, lengths)
        hit = (ranks == best) & (best < none)
        # of touching places (as in a run of one symbol) every second one merges, from the left
        where = np.flatnonzero(hit)
        if not len(where):
            break
        fresh = np.r_[True, np.diff(where) > 1]
        run_start = where[np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))]
        where = where[(where - run_start) % 2 == 0]
        symbols[where] = table.by_rank[ranks[where]]
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        # rows whose best pair is none are finished
        keep &= np.repeat(lowest < none, lengths)
        left = np.bincount(row, minlength=len(pieces))
        done = row[starts[lowest == none]]
        out[done] = left[done]
        symbols, row = symbols[keep], row[keep]
    left = np.bincount(row, minlength=len(pieces))
    rest = np.flatnonzero(left)
    out[rest] = left[rest]
    return out


class Counts:
    """Token counts of texts, remembering short pre-tokens seen before."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.pattern = regex.compile(PATTERN)
        special = "|".join(map(regex.escape, sorted(self.table.special, key=len, reverse=True)))
        self.special = regex.compile(special) if special else None
        self.known: dict[str, int] = {}

    def pretokens(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not self.special.search(text):
            return self.pattern.findall(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.pattern.findall(part)], len(parts) - 1

    def _learn(self, fresh: list[str]) -> dict[str, int]:
        found, batch, size = {}, [], 0
        for piece in [*fresh, None]:
            if batch and (piece is None or size + len(piece) > BATCH_BYTES):
                found.update(zip(batch, merged_sizes([p.encode("utf-8", "surrogatepass") for p in batch], self.table).tolist(), strict=True))
                batch, size = [], 0
            if piece is not None:
                batch.append(piece)
                size += len(piece)
        return found

    def count(self, texts: list[str]) -> list[int]:
        split = []
        for text in texts:
            pieces, special = self.pretokens(text)
            split.append((Counter(pieces), special))
        fresh = list({p for pieces, _ in split for p in pieces if p not in self.known})
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = list({p for pieces, _ in split for p in pieces})
        found = self._learn(fresh)
        self.known.update((p, n) for p, n in found.items() if len(p) <= 40)
        look = found if len(found) > len(self.known) else self.known
        other = self.known if look is found else found
        return [
            special + sum(n * (look[p] if p in look else other[p]) for p, n in pieces.items())
            for pieces, special in split
        ]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, limit: int = 1024) -> DataFrame:
    """Columns ``keep`` (all by default) with n_bytes, n_tokens and over_limit (n_tokens > limit) of the whole text.

    ``vocabulary`` is a tokenizer file that every executor has. A missing text is empty: 0 bytes, 0 tokens.
    Special strings inside a text count as one token each. Rows pass one by one, so repeated rows, ties and empty
    tables need no care; columns of the input with the names of results are replaced.
    """
    results = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in results]
    # the text travels beside the kept columns under a name of its own
    taken = in_small_batches(docs).select(whole(col(text)).alias("_text_"), *map(col, keep))

    sized = taken.withColumn("n_bytes", F.octet_length("_text_").cast("long"))
    schema = sized.drop("_text_").withColumn("n_tokens", F.lit(0).cast("long")).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(vocabulary)
        for batch in batches:
            texts, rest = batch.column(0), [batch.column(i) for i in range(1, batch.num_columns)]
            for at in range(0, batch.num_rows, 500):
                part = texts.slice(at, 500)
                n = pa.array(counts.count(part.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([c.slice(at, 500) for c in rest] + [n], names=names)

    counted = sized.mapInArrow(run, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

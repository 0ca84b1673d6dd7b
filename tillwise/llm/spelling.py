"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

One edit changes the letter counts of a word by a squared distance of at most two. Words lie in blocks of equal length and
equal counts in a few classes of letters, so a near word is in the same block or one a single move away: in a block of the same
length with one letter more of one class and one less of another, or in a block one letter longer. The products of two blocks'
count vectors (a Gram matrix) give all squared distances between them; pairs at most two apart are verified letter by letter.

Spark deals tiles: blocks of few coarse classes, with the words of the tiles one move away as visitors. Within a tile, classes
are finer. Moves go one way only, so each pair is met once. Tiles send counts and the best near word of each word, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.common import attach
from tillwise.plans.scratch import save

# a form is at least RATIO times as frequent as its variant
RATIO = 10
# a tile of more letters on either side is cut; sizes that the numbers of classes aim at
TILE_LETTERS = 1 << 20
TILE_WORDS, BLOCK_WORDS = 4000, 20
BINS = 64
# letters in order of their frequency in Latin script, dealt to the classes in turn
COMMON = "etaoinsrhldcumfpgwybvkxjqz"
HOME, SELF = -2, -1
# verified at once, at most
CANDIDATES = 1 << 18


def bins(codes: np.ndarray) -> np.ndarray:
    """The bin of each code point: a-z have one each, all others share the rest."""
    return np.where((codes >= 97) & (codes <= 122), codes - 97, 26 + codes % (BINS - 26))


def classes_of_bins(classes: int) -> np.ndarray:
    """The class of each bin: common letters in turn, the shared bins too."""
    out = np.arange(BINS) % classes
    for i, letter in enumerate(COMMON):
        turn, k = divmod(i, classes)
        out[ord(letter) - 97] = k if turn % 2 == 0 else classes - 1 - k
    return out


def class_numbers(words: int) -> tuple[int, int]:
    """Numbers of coarse and fine classes that keep tiles and blocks small for so many different words."""

    def least(low: int, high: int, size: int) -> int:
        # a quarter of all words has the most usual length, here nine letters
        return next((k for k in range(low, high) if words / (4 * math.comb(8 + k, k - 1)) <= size), high)

    coarse = least(3, 10, TILE_WORDS)
    return coarse, least(coarse, 16, BLOCK_WORDS)


def _marks(n: int) -> np.ndarray:
    """Fixed odd 64-bit numbers; a block's number is the sum of those of its letters' classes."""
    return np.random.default_rng(11).integers(1 << 62, size=n, dtype=np.int64) * 2 + 1


def codes_of(words: list[str], length: int) -> np.ndarray:
    """Code points, one row per word of ``length``."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat.reshape(len(words), length).astype(np.int64)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    rows = np.arange(len(codes))[:, None] * BINS
    return np.bincount((rows + bins(codes)).ravel(), minlength=len(codes) * BINS).reshape(len(codes), BINS)


def _coarse_moves(coarse: int) -> list[tuple[int, int]]:
    """(class gained, class lost) by a replaced letter, one way only, then (class gained, -1) by an added one."""
    return [*combinations(range(coarse), 2), *((k, -1) for k in range(coarse))]


def _visits(coarse: int, fine: int):
    """For each word its home tile, itself as a visitor there, and a visit to each tile one move away."""
    group = classes_of_bins(fine) * coarse // fine
    marks, moves = _marks(coarse), _coarse_moves(coarse)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            for size in np.unique(sizes).tolist():
                here = np.flatnonzero(sizes == size)
                for at in range(0, len(here), step := max(1, TILE_LETTERS // size)):
                    some = here[at : at + step]
                    own = marks[group[bins(codes_of(words[some].tolist(), size))]].sum(axis=1)
                    word, count = pa.array(words[some].tolist(), pa.string()), pa.array(n[some])
                    for kind in range(HOME, len(moves)):
                        length, tile = size, own
                        if kind >= 0:
                            gained, lost = moves[kind]
                            tile = own + marks[gained] - (marks[lost] if lost >= 0 else 0)
                            length += lost < 0
                        yield pa.RecordBatch.from_pydict({
                            "length": pa.array(np.full(len(some), length, np.int32)), "tile": pa.array(tile),
                            "kind": pa.array(np.full(len(some), kind, np.int16)), "word": word, "n": count,
                        })

    return run


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` become those of ``b``, as long or one code point longer, by one edit exactly."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate(a[:, ::-1] == b[:, :0:-1], axis=1).sum(axis=1)
    return front + back >= a.shape[1]


def near_pairs(
    homes: list[str], visitors: list[str], kinds: np.ndarray, length: int, coarse: int, fine: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (visitor, home) of all pairs one edit apart that the visitors' moves lead to, each once."""
    fine_class, marks, moves = classes_of_bins(fine), _marks(fine), _coarse_moves(coarse)
    group = np.arange(fine) * coarse // fine
    home_codes = codes_of(homes, length)
    home_counts = letter_counts(home_codes).astype(np.float32)
    home_keys = marks[fine_class[bins(home_codes)]].sum(axis=1)
    order = np.argsort(home_keys, kind="stable")
    keys, starts = np.unique(home_keys[order], return_index=True)
    ends = np.r_[starts[1:], len(order)]
    for kind in np.unique(kinds).tolist():
        who = np.flatnonzero(kinds == kind)
        gained, lost = (0, 0) if kind == SELF else moves[kind]
        codes = codes_of([visitors[i] for i in who.tolist()], length - (lost < 0))
        counts = letter_counts(codes).astype(np.float32)
        own = marks[fine_class[bins(codes)]].sum(axis=1)
        if kind == SELF:
            steps = [(0, True)] + [(marks[i] - marks[j], False) for i, j in combinations(range(fine), 2) if group[i] == group[j]]
        elif lost < 0:
            steps = [(marks[i], False) for i in range(fine) if group[i] == gained]
        else:
            steps = [(marks[i] - marks[j], False) for i in range(fine) for j in range(fine) if group[i] == gained and group[j] == lost]
        by_key = np.argsort(own, kind="stable")
        seen, begins = np.unique(own[by_key], return_index=True)
        stops = np.r_[begins[1:], len(by_key)]
        met, n_met = [], 0
        for step, same in steps:
            target = seen + step
            place = np.minimum(np.searchsorted(keys, target), len(keys) - 1)
            for b in np.flatnonzero(keys[place] == target).tolist():
                k = place[b]
                mine, theirs = by_key[begins[b] : stops[b]], order[starts[k] : ends[k]]
                for at in range(0, len(mine), wide := max(1, CANDIDATES // len(theirs))):
                    rows = mine[at : at + wide]
                    x, y = counts[rows], home_counts[theirs]
                    apart = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)
                    i, j = np.nonzero(apart <= 2)
                    if not len(i):
                        continue
                    i, j = rows[i], theirs[j]
                    met.append((i, j, np.full(len(i), same)))
                    n_met += len(i)
                    if n_met >= CANDIDATES:
                        yield from _verified(met, codes, home_codes, who, visitors, homes)
                        met, n_met = [], 0
        if met:
            yield from _verified(met, codes, home_codes, who, visitors, homes)


def _verified(
    met: list, codes: np.ndarray, home_codes: np.ndarray, who: np.ndarray, visitors: list[str], homes: list[str]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of ``met`` (rows of codes, rows of home_codes, whether of one block) that are one edit apart."""
    i, j, same = (np.concatenate(parts) for parts in zip(*met, strict=True))
    step = max(1, 4 * TILE_LETTERS // home_codes.shape[1])
    for at in range(0, len(i), step):
        a, b, once = i[at : at + step], j[at : at + step], same[at : at + step]
        near = one_edit(codes[a], home_codes[b])
        a, b, once = who[a[near]], b[near], once[near]
        # within one block both words visit each other: the smaller one counts
        counts = [not s or visitors[v] < homes[h] for v, h, s in zip(a.tolist(), b.tolist(), once.tolist(), strict=True)]
        yield a[np.array(counts, bool)], b[np.array(counts, bool)]


def _tile(coarse: int, fine: int):
    """Per word of a tile with a near one: number of them met here, and the best."""

    def run(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        words, n = np.array(table["word"].to_pylist(), object), table["n"].to_numpy()
        homes, guests = np.flatnonzero(kind == HOME), np.flatnonzero(kind != HOME)
        found = []
        if len(homes) and len(guests):
            pairs = near_pairs(words[homes].tolist(), words[guests].tolist(), kind[guests], table["length"][0].as_py(), coarse, fine)
            found = [(guests[v], homes[h]) for v, h in pairs]
        a = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        b = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
        one, other = np.r_[a, b], np.r_[b, a]
        # more frequent first, then the smaller word
        place = np.empty(len(words), np.int64)
        place[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
        by_place = np.argsort(place)
        best = np.full(len(words), len(words), np.int64)
        np.minimum.at(best, one, place[other])
        met = np.bincount(one, minlength=len(words))
        near = np.flatnonzero(met)
        top = by_place[best[near]]
        return pa.table({
            "word": pa.array(words[near].tolist(), pa.string()), "n_near": pa.array(met[near]),
            "form_n": pa.array(n[top]), "form": pa.array(words[top].tolist(), pa.string()),
        })

    return run


def _cut(visits: DataFrame, letters: int) -> DataFrame:
    """``visits`` with cell: tiles of more than ``letters`` on either side are cut, and every part of one side meets every part of
    the other."""
    home = F.col("kind") == HOME
    sizes = visits.groupBy("length", "tile").agg(
        (F.count_if(home) * F.col("length")).alias("home"), (F.count_if(~home) * F.col("length")).alias("guest"),
        F.count(F.lit(1)).alias("rows"),
    ).where("home > 0")
    parts = sizes.select(
        F.struct("length", "tile").alias("at"), F.ceil(F.col("home") / letters).cast("int").alias("homes"),
        F.ceil(F.col("guest") / letters).cast("int").alias("guests"), "rows",
    )
    placed = attach(visits.withColumn("at", F.struct("length", "tile")), save(parts), "at", "rows", ["word"]).where("homes IS NOT NULL")
    own, meets = F.when(home, F.col("homes")).otherwise(F.col("guests")), F.when(home, F.col("guests")).otherwise(F.col("homes"))
    part = F.pmod(F.xxhash64("word"), own)
    cell = F.transform(
        F.sequence(F.lit(0), meets - 1),
        lambda k: F.when(home, part * F.col("guests") + k).otherwise(k * F.col("guests") + part),
    )
    return placed.select("length", "tile", "kind", "word", "n", F.explode(cell).alias("cell"))


def near_words(vocabulary: DataFrame, letters: int = TILE_LETTERS) -> DataFrame:
    """(word, n_near, form_n, form) for the words of ``vocabulary`` (word, n; saved) that have a near one: how many, and the most
    frequent of them (ties: the smallest)."""
    coarse, fine = class_numbers(vocabulary.count())
    visits = vocabulary.select("word", F.col("n").cast("long").alias("n")).mapInArrow(
        _visits(coarse, fine), "length int, tile long, kind short, word string, n long"
    )
    tiles = _cut(save(visits), letters).groupBy("length", "tile", "cell")
    met = tiles.applyInArrow(_tile(coarse, fine), "word string, n_near long, form_n long, form string")
    best = F.min(F.struct(-F.col("form_n"), F.col("form")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.col1")).alias("form_n"), F.col("best.form").alias("form")
    )


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the end of the chain. Chains have no cycle, as counts grow along them; every
    round halves what is left of them."""
    going = save(forms.select("word", F.col("form").alias("root")))
    while True:
        nexts = going.select(F.col("word").alias("at"), F.col("root").alias("then"))
        ahead = save(going.join(nexts, F.col("root") == F.col("at"), "left").select("word", "root", "then"))
        if ahead.where("then IS NOT NULL").isEmpty():
            return ahead.select("word", "root")
        going = save(ahead.select("word", F.coalesce("then", "root").alias("root")))


def spelling_variants(vocabulary: DataFrame, ratio: int = RATIO, letters: int = TILE_LETTERS) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of ``vocabulary`` (word, n).

    Two words are near if one inserted, deleted or replaced code point makes one the other. n_near counts the near words; form is
    the one of largest n (ties: the smallest in code-point order) if that is at least ``ratio`` (over 1) times the word's n, else
    missing with form_n; root is where following forms ends, the word itself if it has none. Rows of the same word are added up,
    rows without a word or with an empty one or without n count for nothing; other columns are not returned.
    """
    if ratio <= 1:
        raise ValueError("ratio must be over 1, or forms could lead in a circle")
    known = vocabulary.where("word IS NOT NULL AND word <> '' AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    known = save(known)
    near = save(near_words(known, letters))
    joined = save(known.join(near, "word", "left"))
    has_form = F.col("form_n") >= ratio * F.col("n")
    forms = joined.where(has_form).select("word", "form", "form_n")
    roots = _roots(forms)
    found = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
    found = found.join(forms, "word", "left").join(roots, "word", "left")
    return found.withColumn("root", F.coalesce("root", "word"))

"""Near-duplicate documents: banded MinHash candidates, odd-sketch verification, exact confirmation.

1. Texts with the same words form a class, named by the digest of its words; the smallest doc_id stands for its
   members once links between classes are found.
2. Every class gets SAMPLES MinHash values. Runs of ROWS of them are band keys; classes with a common key are
   candidates. All samples are also folded into an odd sketch, a bitmap in which each sample flips one bit: the
   number of ones in the XOR of two sketches tells how many samples differ, precisely where similarity is high.
3. In a bucket the most central class is compared with all others first (a star, linear in the bucket). What that
   leaves apart is compared in blocks of bounded size, only between blocks that share such a bucket.
4. Within a comparison, pairs that are still apart and whose sketches do not rule them out are confirmed on their full
   shingle sets; only a spanning forest of the links leaves the task, so no list of pairs is ever written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.functions.text import col
from tillwise.llm.common import in_small_batches
from tillwise.plans.scratch import save, temporary

ROWS, BANDS = 4, 32
SAMPLES = ROWS * 64
SKETCH_BITS = 1024
# sketch estimates spread by about 0.03 around the truth; six times that is never ruled out
MARGIN = 0.18
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1_000_000
SLICE = 200

_SEED = np.random.default_rng(20240611)
_MULTIPLY = _SEED.integers(0, 1 << 62, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEED.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(text: str | None) -> list[bytes]:
    """Words of the whole text, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: list[list[bytes]], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each list of words."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.array([w for t in texts for w in t], dtype=object)
    if not len(flat):
        return [np.empty(0, np.uint64)] * len(texts)
    codes, distinct = pd.factorize(flat)
    hashed = pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)[codes]
    run = np.zeros(max(len(flat) - width + 1, 0), np.uint64)
    for k in range(width):
        run = _mix(run * np.uint64(3) + hashed[k : len(hashed) - width + 1 + k])
    out, at = [], 0
    for n in sizes.tolist():
        if n >= width:
            out.append(np.unique(run[at : at + n - width + 1]))
        elif n:
            whole = np.zeros(1, np.uint64)
            for h in hashed[at : at + n]:
                whole = _mix(whole * np.uint64(3) + h)
            # a whole sequence never equals a full-width shingle
            out.append(_mix(whole + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima of one set, in slices so that very long texts stay small in memory."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * _MULTIPLY[None, :]
        part += _ADD[None, :]
        np.minimum(least, part.min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as words of 64 bits."""
    place = _mix(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)
    bits = np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def estimate(flipped: np.ndarray) -> np.ndarray:
    """Similarity from the number of ones in the XOR of two sketches."""
    share = np.clip(1 - 2 * flipped / SKETCH_BITS, 1e-9, 1)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(share)


def fingerprints(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Per row: id, hash (of the text as it stands), key (digest of the word sequence, NULL without words), n, bands, sketch."""
    schema = "id long, hash long, key binary, n long, bands array<long>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows: dict[str, list] = {"id": part.column(0).to_pylist(), "hash": part.column(2).to_pylist(), "key": [], "n": [], "bands": [], "sketch": []}
                lists = [tokens(t) for t in part.column(1).to_pylist()]
                for listed, shingles in zip(lists, shingle_sets(lists, width), strict=True):
                    rows["n"].append(len(shingles))
                    if not listed:
                        for name in ("key", "bands", "sketch"):
                            rows[name].append(None)
                        continue
                    samples = minhashes(shingles)
                    key = np.arange(1, BANDS + 1, dtype=np.uint64)
                    for k in range(ROWS):
                        key = _mix(key + samples[k : BANDS * ROWS : ROWS])
                    rows["key"].append(hashlib.blake2b(b" ".join(listed), digest_size=16).digest())
                    rows["bands"].append(key.view(np.int64))
                    rows["sketch"].append(odd_sketch(samples).tobytes())
                yield pa.RecordBatch.from_pydict(rows, schema=pa_schema)

    pa_schema = pa.schema([
        ("id", pa.int64()), ("hash", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64())),
        ("sketch", pa.binary()),
    ])
    return docs.select(col(doc_id).cast("long"), col(text), F.xxhash64(col(text))).mapInArrow(run, schema)


def _sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, width: int) -> DataFrame:
    """key and its whole shingle set, for the classes in ``wanted`` (rep, hash, key): a member's id and text hash."""
    schema = "key binary, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lists = [tokens(t) for t in part.column(1).to_pylist()]
                keys = part.column(2).to_pylist()
                # texts with the same id and hash may still differ
                same = [i for i, w in enumerate(lists) if hashlib.blake2b(b" ".join(w), digest_size=16).digest() == keys[i]]
                sets = shingle_sets([lists[i] for i in same], width) if same else []
                yield pa.RecordBatch.from_pydict(
                    {"key": [keys[i] for i in same], "shingles": [s.tobytes() for s in sets]},
                    schema=pa.schema([("key", pa.binary()), ("shingles", pa.binary())]),
                )

    # copies of a row are read once
    texts = docs.select(col(doc_id).cast("long").alias("rep"), F.xxhash64(col(text)).alias("hash"), col(text).alias("text"))
    return texts.join(wanted, ["rep", "hash"]).select("rep", "text", "key").mapInArrow(run, schema).dropDuplicates(["key"])


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _confirm(similar: int):
    """Spanning links of one comparison: rows (item, side, key, group, rep, n, sketch, shingles)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "key"], kind="stable")
        keys, reps = rows["key"].to_numpy(), rows["rep"].to_numpy()
        side, n = rows["side"].to_numpy(), rows["n"].to_numpy()
        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        same, group = pd.factorize(rows["key"])[0], pd.factorize(rows["group"])[0]
        parent = np.arange(len(rows) + 1)
        a: list[int] = []
        b: list[int] = []
        left = np.flatnonzero(side == 0)
        for i in left.tolist():
            # one side only: compare within; two sides: across
            others = np.flatnonzero(side == 1) if (side == 1).any() else left[left > i]
            others = others[(same[others] != same[i]) & (group[others] != group[i])]
            small, large = np.minimum(n[others], n[i]), np.maximum(n[others], n[i])
            others = others[100 * small >= similar * large]
            if not len(others):
                continue
            flipped = np.bitwise_count(sketch[others] ^ sketch[i]).sum(axis=1)
            guess = estimate(flipped)
            near = guess >= similar / 100 - MARGIN
            for j in others[near][np.argsort(-guess[near], kind="stable")].tolist():
                x, y = _find(parent, group[i]), _find(parent, group[j])
                if x == y:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= similar * (n[i] + n[j] - common):
                    parent[max(x, y)] = min(x, y)
                    a.append(i)
                    b.append(j)
        at, to = np.array(a, np.int64), np.array(b, np.int64)
        ends = {"a": keys[at], "b": keys[to], "x": reps[at], "y": reps[to]}
        return pd.DataFrame(ends)

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for every node of ``edges`` (a, b), by alternating stars.

    Each step links neighbours to their smallest neighbour, first the larger then the smaller ones, until only stars
    remain (a logarithmic number of steps). Nothing but the edges is held, and each step is a written table.
    """
    edges = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # larger neighbours of every node hang under its smallest neighbour
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = save(small.unionByName(below.select("a", F.col("m").alias("b"))).distinct())
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    # a star's centre never hangs under another node
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _compare(work: DataFrame, classes: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Links (a, b) with their doc_ids (x, y) found in the comparisons ``work`` (item, side, key, group)."""
    full = work.join(classes.select("key", "rep", "n", "sketch"), "key").join(sets, "key")
    return full.groupBy("item").applyInPandas(_confirm(similar), "a binary, b binary, x long, y long")


def _labelled(frame: DataFrame, found: DataFrame, node: str, out: str) -> DataFrame:
    """``frame`` with the component of ``node``, or the node itself where it has no link."""
    named = found.select(F.col("node").alias(node), F.col("component").alias(out))
    return frame.join(named, node, "left").withColumn(out, F.coalesce(out, node))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similar: int = 75
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked where 100 * common >= similar * united over their sets of distinct ``width``-word shingles (fewer
    words: the whole sequence is one shingle). component_id is the smallest doc_id reachable through links, kept tells
    whether it is the row's own. Missing or empty texts link with nothing. Rows that share a doc_id are one node:
    they get one component whatever their texts, and all of them are kept if one is. A missing doc_id makes no node:
    component_id is NULL and the row is kept. Empty tables give empty results; other columns are not read.
    """
    # a row of four numbers per document is all that stays of the tables in between
    with temporary() as own:
        return own.hand_over(_grouped(in_small_batches(docs), doc_id, text, width, similar))


def _grouped(docs: DataFrame, doc_id: str, text: str, width: int, similar: int) -> DataFrame:
    prints = save(fingerprints(docs, doc_id, text, width))
    known = prints.where(F.col("id").isNotNull() & F.col("key").isNotNull())
    payload = [F.first(c).alias(c) for c in ("n", "bands", "sketch")]
    classes = known.groupBy("key").agg(F.min(F.struct("id", "hash")).alias("m"), F.count(F.lit(1)).alias("copies"), *payload)
    classes = save(classes.select("key", F.col("m.id").alias("rep"), F.col("m.hash").alias("hash"), "copies", "n", "bands", "sketch"))

    slots = classes.select("key", F.posexplode("bands").alias("band", "hash"))
    slots = slots.select("key", F.xxhash64("band", "hash").alias("bucket"))
    sizes = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = save(slots.join(sizes, "bucket"))
    # the hub of a bucket is the class with most company over all its bands
    company = member.groupBy("key").agg(F.sum("size").alias("company"))
    member = save(member.join(company, "key"))
    hubs = member.groupBy("bucket").agg(F.max(F.struct("company", "key"))["key"].alias("hub"))
    placed = save(member.join(hubs, "bucket").select("bucket", "key", "size", "hub"))

    wanted = placed.select("key").distinct().join(classes.select("key", "rep", "hash"), "key")
    sets = save(_sets(docs, doc_id, text, wanted, width))

    # stars: each hub with its members, in chunks of bounded size
    pairs = placed.where("key <> hub").select("hub", "key").distinct().join(classes.select("key", "n"), "key")
    load = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    chunks = F.ceil(F.greatest(F.col("c") / BLOCK_DOCS, F.col("s") / BLOCK_SHINGLES)).cast("long")
    chunk = F.pmod(F.xxhash64("key"), F.col("chunks"))
    spokes = save(pairs.join(load.select("hub", chunks.alias("chunks")), "hub").select("hub", "key", chunk.alias("chunk")))
    item = F.xxhash64("hub", "chunk").alias("item")
    spoke = spokes.select(item, F.lit(1).alias("side"), "key", F.col("key").alias("group"))
    centre = spokes.select(item, F.lit(0).alias("side"), F.col("hub").alias("key"), F.col("hub").alias("group")).distinct()
    links = save(_compare(spoke.unionByName(centre), classes, sets, similar))
    found = save(components(links))

    # what the stars left apart: members of one bucket in several components, its hub aside
    apart = save(_labelled(placed.where("key <> hub").select("bucket", "key", "hub"), found, "key", "group"))
    mixed = apart.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("group").alias("lo"), F.max("group").alias("hi"))
    apart = save(apart.join(mixed.where("lo <> hi").select("bucket", "size"), "bucket"))
    # a class is at home with the hub of its largest bucket, which the buckets of one dense group share
    home = apart.groupBy("key").agg(F.max(F.struct("size", "hub")).alias("h")).select("key", "h.hub")
    home = save(home.join(classes.select("key", "n"), "key"))
    load = home.groupBy("hub").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    home = home.join(load.select("hub", chunks.alias("chunks")), "hub")
    home = save(home.select("key", F.xxhash64("hub", chunk).alias("block")))
    touched = save(apart.join(home, "key").select("bucket", "block").distinct())
    left, right = touched.withColumnRenamed("block", "x"), touched.withColumnRenamed("block", "y")
    meetings = left.join(right, "bucket").where("x <= y").select("x", "y").distinct()
    work = meetings.select(F.xxhash64("x", "y").alias("item"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("x").alias("block")), F.struct(F.lit(1).alias("side"), F.col("y").alias("block")),
    )).alias("s"), (F.col("x") == F.col("y")).alias("own")).where("NOT own OR s.side = 0").select("item", "s.side", "s.block")
    work = _labelled(work.join(home, "block").select("item", "side", "key"), found, "key", "group")
    more = save(_compare(work, classes, sets, similar))

    # classes of copies, and rows that share an id, are links too
    rep = classes.where("copies > 1").select("key", "rep")
    copies = known.select("key", "id").join(rep, "key").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    shared = known.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    doubles = known.join(shared, "id").join(classes.select("key", "rep"), "key").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    # classes give way to the smallest doc_id that holds their text
    linked = links.unionByName(more).select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(doubles).unionByName(copies)
    found = components(linked)
    rows = _labelled(prints.select(F.col("id"), F.col("n").alias("n_shingles")), found, "id", "component_id")
    return rows.select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps; of rows that share a kept doc_id, one stays.

    Of such rows the first in the order of all columns, written as JSON, is the one that stays. Rows without a
    doc_id all stay.
    """
    found = near_duplicates(docs, doc_id, text)
    ids = save(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")))
    ids = ids.withColumnRenamed("doc_id", "_kept_id")
    joined = docs.join(ids, col(doc_id) == F.col("_kept_id"))
    single = joined.where("_rows = 1").select(*map(col, docs.columns))
    row = F.to_json(F.struct(*map(col, docs.columns)))
    several = joined.where("_rows > 1").groupBy("_kept_id").agg(F.min_by(F.struct(*map(col, docs.columns)), row).alias("r"))
    return single.unionByName(several.select("r.*")).unionByName(docs.where(col(doc_id).isNull()))

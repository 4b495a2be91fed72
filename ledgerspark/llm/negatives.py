"""Hard-negative mining with exact integer scores from float32 products in a residue number system.

Scores are inner products of integer vectors. Each block of rows is multiplied with the anchors modulo several primes
below 1024: centred residues are at most 510, so a float32 product over STEP = 64 dimensions stays below 2**24 and is
exact. The signed score comes back by Chinese remaindering in balanced mixed radix; the number of primes follows from
the block's norms (Cauchy-Schwarz), so scores of any size that a long holds are exact.

Anchors are packed in blocks of about BLOCK and broadcast at most HELD bytes at a time, whatever their number; each
turn is one pass over the rows, which are never shuffled. Two passes a turn: the first finds each anchor's positives,
the second its negatives in the windows of their scores. Every block of rows sends its best few a window, and a Spark
window picks the first ones of all.

Defined cases: rows with a null label, vector or vec_id, with a null, NaN or infinite component, or with a squared
norm of 2**62 or more (whose scores a long may not hold) take no part; short vectors count as filled with zeros; rows
with the anchor's vec_id are not its partners; an anchor row that repeats whole is one anchor, and other rows count as
often as they are there; unlike rows under one anchor id are anchors of their own, told apart by anchor_key; an anchor
without positives or a positive without negatives has no rows; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .vectors import matrix, whole, width

STEP = 64
#: The largest primes below 1024; their product exceeds twice any score that a long holds.
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)
BLOCK = 4096  # anchors
HELD = 64 << 20  # bytes of anchors that are broadcast at once
ROWS = 1 << 15  # rows multiplied at once
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = (3, 10), (9, 10)  # a negative's score lies between these shares of the positive's


class Residues:
    """A matrix of longs, the norm of its longest row, and its centred residues as float32, kept by prime."""

    def __init__(self, x: np.ndarray):
        self.x, self.kept = x, {}
        self.norm = math.sqrt(float((x.astype(float) ** 2).sum(1).max(initial=0.0)))

    def of(self, p: int) -> np.ndarray:
        if p not in self.kept:
            self.kept[p] = ((self.x + p // 2) % p - p // 2).astype(np.float32)
        return self.kept[p]


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p, nearest to 0; for whole doubles far below 2**52."""
    return x - p * np.rint(x / p)


def products(a: Residues, b: Residues, own: slice = slice(None)) -> np.ndarray:
    """Exact products of own rows of a with those of b, as longs, which the scores must fit."""
    most = a.norm * b.norm * (1 + 1e-9) + 1
    digits: list[tuple[int, np.ndarray]] = []  # the score is the sum of size * digit
    size = 1
    for p in PRIMES:
        ra, rb = a.of(p)[own], b.of(p)
        got = 0.0
        for k in range(0, a.x.shape[1], STEP):
            got = got + (ra[:, k : k + STEP] @ rb[:, k : k + STEP].T).astype(np.float64)  # each exact below 2**24
        for s, d in digits:
            got -= (s % p) * d
        if digits:
            got = centred(got, p) * pow(size, -1, p)
        digits.append((size, centred(got, p)))
        size *= p
        if size > 2 * most:
            break
    if size < 1 << 52:
        return sum(s * d for s, d in digits).astype(np.int64)
    return sum(np.uint64(s % (1 << 64)).astype(np.int64) * d.astype(np.int64) for s, d in digits)  # sums wrap around to the right long


def first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties by place."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        above = np.flatnonzero(score > kth)
        score_at = np.concatenate((above, np.flatnonzero(score == kth)[: k - len(above)]))
    else:
        score_at = np.arange(len(score))
    return score_at[np.lexsort((score_at, -score[score_at]))]


def shares(positive: int) -> tuple[int, int]:
    """The least and greatest whole score within the window of a positive's."""
    return -(-LOW[0] * positive // LOW[1]), HIGH[0] * positive // HIGH[1]


def taking_part(embeddings: DataFrame) -> DataFrame:
    """vec_id, label (changed where vec_id is divisible by 7), embedding of the rows that take part."""
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings.where(whole() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")


def vectors(b: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """vec_id, label and the vectors of longs of the batch's rows whose scores fit."""
    x = matrix(b.column(2), dims)
    fit = np.flatnonzero((x * x).sum(1) < 2.0**62)
    return b.column(0).to_numpy()[fit], b.column(1).to_numpy()[fit], x[fit].astype(np.int64)


def anchor_blocks(rows: DataFrame, is_anchor: Column, dims: int) -> tuple[DataFrame, int, int]:
    """a, key, vec_id, label, x: blocks of anchors as packed longs, how many there are and how many go out at once."""
    picked = rows.where(is_anchor).distinct()
    n = picked.count()
    count = max(1, math.ceil(n / BLOCK))
    picked = picked.withColumn("a", F.pmod(F.xxhash64("vec_id"), F.lit(count)))

    def packed(t: pa.Table) -> pa.Table:
        own = t.select(["vec_id", "label", "embedding"]).combine_chunks().to_batches()[0]
        i, y, x = vectors(own, dims)
        by = np.lexsort((*x.T[::-1], y, i))
        i, y, x = i[by], y[by], x[by]
        key = np.arange(len(i)) - np.searchsorted(i, i)  # numbers unlike rows under one id
        return pa.Table.from_pydict({"a": t.column("a")[:1], **{k: pa.array([np.ascontiguousarray(v, np.int64).tobytes()], pa.binary()) for k, v in (("key", key), ("vec_id", i), ("label", y), ("x", x))}})

    blocks = picked.groupBy("a").applyInArrow(packed, "a long, key binary, vec_id binary, label binary, x binary")
    each = BLOCK * 2 * (8 * (dims + 3 + POSITIVES))  # a block of twice the usual size is possible
    return written(blocks, "anchors"), count, max(1, HELD // each)


class Anchors:
    def __init__(self, rows: list, dims: int):
        join = lambda k: np.concatenate([np.frombuffer(r[k], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        self.key, self.id, self.label, self.x = join("key"), join("vec_id"), join("label"), Residues(join("x").reshape(-1, dims))


def gathered(batches, dims: int, most: int = ROWS):
    """Batches as vec_id, label, vectors of about most rows, in order of label, then vec_id."""
    held, n = [], 0
    for b in batches:
        held.append(vectors(b, dims))
        n += len(held[-1][0])
        if n >= most:
            yield _ordered(held)
            held, n = [], 0
    if n:
        yield _ordered(held)


def _ordered(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, y, x = (np.concatenate(c) for c in zip(*held))
    by = np.lexsort((i, y))
    return i[by], y[by], x[by]


def tiles(rows: tuple, anchors: Anchors, at_once: int = 64):
    """(anchor, its scores, where its label starts and ends) for all anchors, a tile of them at a time."""
    i, y, x = rows[0], rows[1], Residues(rows[2])
    for lo in range(0, len(anchors.id), at_once):
        own = slice(lo, lo + at_once)
        scores = products(anchors.x, x, own)
        starts, ends = np.searchsorted(y, anchors.label[own]), np.searchsorted(y, anchors.label[own], "right")
        for j, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            yield lo + j, scores[j], s, e


def batch_of(parts: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in (list(zip(*parts)) or [[]] * len(names))], names)


POSITIVE = "anchor_id long, anchor_key long, partner_id long, score long"
NEGATIVE = "anchor_id long, anchor_key long, positive_id long, nth long, positive_score long, negative_id long, negative_score long"


def positives_in(rows: DataFrame, shared, dims: int) -> DataFrame:
    def run(batches):
        anchors = shared.value
        for block in gathered(batches, dims):
            parts = []
            for j, score, s, e in tiles(block, anchors):
                own, at = score[s:e], block[0][s:e]
                if (near := at != anchors.id[j]).all():
                    best = first(own, POSITIVES)
                else:
                    others = np.flatnonzero(near)
                    best = others[first(own[others], POSITIVES)]
                parts.append((np.full(len(best), anchors.id[j]), np.full(len(best), anchors.key[j]), at[best], own[best]))
            yield batch_of(parts, [c.split()[0] for c in POSITIVE.split(", ")])

    return rows.mapInArrow(run, POSITIVE)


def negatives_in(rows: DataFrame, shared, found, dims: int) -> DataFrame:
    """found: each anchor's positives (id, nth, score), by its place."""

    def run(batches):
        anchors, positives = shared.value, found.value
        for block in gathered(batches, dims):
            parts = []
            for j, score, s, e in tiles(block, anchors):
                if not (own := positives.get((int(anchors.id[j]), int(anchors.key[j])))):
                    continue
                windows = [shares(p) for _, _, p in own]
                lo, hi = min(w[0] for w in windows), max(w[1] for w in windows)
                inside = (score >= lo) & (score <= hi)
                inside[s:e] = False
                inside = np.flatnonzero(inside)
                at = block[0][inside]
                if len(inside):
                    on = at != anchors.id[j]
                    order = np.lexsort((at[on], -score[inside[on]]))  # by score, then vec_id
                    ids, values = at[on][order], score[inside[on]][order]
                    for (pid, nth, p), (a, b) in zip(own, windows):
                        start = np.searchsorted(-values, -b)
                        end = min(np.searchsorted(-values, -a, "right"), start + NEGATIVES)
                        if end > start:
                            m = end - start
                            parts.append((*(np.full(m, v) for v in (anchors.id[j], anchors.key[j], pid, nth, p)), ids[start:end], values[start:end]))
            yield batch_of(parts, [c.split()[0] for c in NEGATIVE.split(", ")])

    return rows.mapInArrow(run, NEGATIVE)


def hard_negatives(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_key: for each anchor (vec_id divisible by every)
    and each of its first POSITIVES other rows of its label, the first NEGATIVES rows of other labels whose score lies in
    the window of the positive's."""
    rows, spark = taking_part(embeddings), embeddings.sparkSession
    dims = width(rows)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, anchor_key long"
    if not dims:
        return spark.createDataFrame([], schema)
    blocks, count, at_once = anchor_blocks(rows, F.pmod("vec_id", F.lit(every)) == 0, dims)
    by_score = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.desc("score"), "partner_id")
    parts = []
    for lo in range(0, count, at_once):
        shared = spark.sparkContext.broadcast(Anchors(blocks.where(F.col("a").between(lo, lo + at_once - 1)).orderBy("a").collect(), dims))  # at most HELD bytes
        near = positives_in(rows, shared, dims).withColumn("nth", F.row_number().over(by_score).cast("long")).where(F.col("nth") <= POSITIVES)
        found: dict[tuple, list] = {}
        for r in near.orderBy("anchor_id", "anchor_key", "nth").toLocalIterator():  # POSITIVES rows for each broadcast anchor
            found.setdefault((r["anchor_id"], r["anchor_key"]), []).append((r["partner_id"], r["nth"], r["score"]))
        parts.append(written(negatives_in(rows, shared, spark.sparkContext.broadcast(found), dims), "negatives"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("anchor_id", "anchor_key", "nth").orderBy(F.desc("negative_score"), "negative_id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "anchor_key")

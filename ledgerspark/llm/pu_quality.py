"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents with a quality label of 1; unlabelled text is every learning document, whatever its
label. A linear classifier minimises the non-negative unbiased risk (Kiryo and others, 2017) with the logistic loss:
prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)); where a batch's second part turns negative, the
step goes back up it. Labels of 0 are never read.

The class prior is estimated from the same two sets: a first classifier tells positives from unlabelled text; among
the rows that score highest, unlabelled text is all positive, so the prior is the least ratio of the two tails, over
the cuts that keep a TAIL of the positives at least. Each half of the shards is scored
by the other half's classifier, so no positive is scored by a model that saw it.

Features know no language: binned statistics of characters, words, lines and repeats, hashed shapes of word ends and
word heads, and hashed words of four bytes or fewer. Each document is featurised once, in a written table of a
few hundred bytes a row, which is scored too; shards of about SHARD rows descend from the mean weights of the round
before. All learning documents take part, whatever their number; the driver gets some sums of weights a round.

Defined cases: null text counts as empty and is scored; repeated rows are each scored and each learnt from; of labels
that repeat an id the greatest holds, and labels without an id or quality are left out; a null id counts as the text ''
in the fold rule and has no label; without positives every score is 0.5. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import fold_of, written

FOLDS, HELD = 5, 0
CUT = 0.3
SHARD = 8192  # rows of a shard, about
BINS, STATS, HASHED = 16, 15, 2048
WIDTH = STATS * BINS + 3 * HASHED
ROUNDS, STEPS, BATCH, RATE = 3, 300, 256, 1.0
TAIL = 0.5

CLASS = np.arange(256, dtype=np.uint8)
CLASS[97:123] = CLASS[128:] = ord("a")
CLASS[65:91] = ord("A")
CLASS[48:58] = ord("0")
SYMBOLS, STOPS = np.zeros(256, bool), np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>@^~_=+{}[]\\/"]] = True
STOPS[[ord(c) for c in ".,;:!?"]] = True


def shaped(t: tk.Texts) -> np.ndarray:
    """Prefix hashes of the bytes' classes."""
    p, _ = tk.powers(len(t.bytes) + 1)
    h = np.zeros(len(t.bytes) + 1, np.uint64)
    np.cumsum(tk.codes(False)[CLASS[t.bytes]] * p[: len(t.bytes)], out=h[1:])
    return h


def in_text(keys: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: how many distinct keys, how often the commonest is there, how many places hold a key that is there again."""
    _, at, count = np.unique(tk.mix(keys + text.astype(np.uint64) * tk.U(tk.BASE)), return_index=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, text[at], count)
    return np.bincount(text[at], minlength=n), most, np.bincount(text[at], np.where(count > 1, count, 0), minlength=n)


def features(t: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of each text, and the texts' ranges in them."""
    prefix, shapes = t.prefix(True), shaped(t)
    start, end, own = t.words()
    n, text = np.diff(own), tk.of_text(own)
    words = t.runs(prefix, start, end)
    of = lambda mask: tk.per_text_sum(mask[t.bytes], t.at)
    upper, lower, digit, symbol, stop = (of(m) for m in (CLASS == 65, CLASS == 97, CLASS == 48, SYMBOLS, STOPS))
    inked = np.maximum(t.lengths - of(tk.WHITE), 1)
    distinct, most, _ = in_text(words, text, t.n)
    three, own3 = tk.grams(words, own, 3)
    _, _, again = in_text(three, tk.of_text(own3), t.n)
    ls, le = t.spans(t.bytes != 10)
    lown = t.owner(ls)
    lines = np.diff(lown)
    kinds, _, _ = in_text(t.runs(prefix, ls, le), tk.of_text(lown), t.n)
    size = end - start
    some = np.maximum(n, 1)
    share = [upper / inked, lower / inked, digit / inked, symbol / inked, stop / inked, distinct / some, most / some, again / np.maximum(np.diff(own3), 1), 1 - kinds / np.maximum(lines, 1),
             tk.per_text_sum(size <= 3, own) / some, tk.per_text_sum(STOPS[t.bytes[end - 1]] if len(end) else size > 0, own) / some, tk.per_text_sum(SYMBOLS[t.bytes[end - 1]] if len(end) else size > 0, own) / some]
    rank = [np.floor(np.log2(n + 1)), tk.per_text_sum(size, own) / some, np.log2(1 + n / np.maximum(lines, 1)) * 1.5]
    bins = [np.minimum(np.sqrt(s) * BINS, BINS - 1) for s in share] + [np.minimum(r, BINS - 1) for r in rank]
    f = [b.astype(np.int64) + BINS * i for i, b in enumerate(bins)]
    d = [np.arange(t.n)] * STATS
    short = np.flatnonzero(size <= 4)
    for i, (h, who) in enumerate(((t.runs(shapes, np.maximum(end - 4, start), end), text), (t.runs(shapes, start, np.minimum(start + 2, end)), text), (words[short], text[short]))):
        pair = np.unique(who * np.int64(HASHED) + (h & tk.U(HASHED - 1)).astype(np.int64))
        f.append(pair % HASHED + STATS * BINS + i * HASHED)
        d.append(pair // HASHED)
    d, f = np.concatenate(d), np.concatenate(f)
    order = np.argsort(d, kind="stable")
    return f[order].astype(np.int16), np.searchsorted(d[order], np.arange(t.n + 1))


def values(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A statistic counts 1; all hashed features of a text together have length 1."""
    hashed = f >= STATS * BINS
    n = tk.per_text_sum(hashed.astype(float), at)
    return np.where(hashed, np.repeat(1 / np.sqrt(np.maximum(n, 1)), np.diff(at)), 1.0)


def logits(f: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
    return tk.per_text_sum(w[f] * values(f, at), at)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(rows), np.int16), np.concatenate(([0], np.cumsum([len(r) // 2 for r in rows])))


def descend(rows: list[bytes], positive: np.ndarray, w: np.ndarray, prior: float | None, seed: int, l2: float = 1e-4) -> np.ndarray:
    """Adagrad over STEPS batches of positives and of all rows, each taken in turn in a seeded order. prior: of the risk; None: tells
    positives from all rows, each set weighing the same."""
    w, g2, draw = w.copy(), np.full(WIDTH, 1e-3), np.random.default_rng(seed)
    pos = np.flatnonzero(positive)
    nu, np_ = min(BATCH, len(rows)), min(BATCH // 2, len(pos))
    turns = lambda of, n: np.concatenate([draw.permutation(of) for _ in range(math.ceil(STEPS * n / len(of)))])
    every, own = turns(np.arange(len(rows)), nu), turns(pos, np_)
    for k in range(STEPS):
        u, p = every[k * nu : (k + 1) * nu], own[k * np_ : (k + 1) * np_]
        f, at = unpacked([rows[i] for i in np.concatenate((p, u))])
        v = values(f, at)
        z = tk.per_text_sum(w[f] * v, at)
        s = sigmoid(z)
        if prior is None:
            d = np.concatenate(((s[:np_] - 1) / np_, s[np_:] / nu))
        else:
            loss = np.logaddexp(0, z)
            if loss[np_:].mean() >= prior * loss[:np_].mean():
                d = np.concatenate((np.full(np_, -prior / np_), s[np_:] / nu))
            else:
                d = np.concatenate((s[:np_] * prior / np_, -s[np_:] / nu))
        on, inv = np.unique(f, return_inverse=True)
        grad = np.bincount(inv, np.repeat(d, np.diff(at)) * v, len(on)) + l2 * w[on]
        g2[on] += grad * grad
        w[on] -= RATE * grad / np.sqrt(g2[on])
    return w


def one_round(train: DataFrame, w: dict[int, np.ndarray], prior: float | None, seed: int) -> dict[int, np.ndarray]:
    """Each half's mean of its shards' weights, from those of the round before; half -1: all shards. The sums are made in
    Spark, some tens of shards at a time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "f"])
        half, positive = int(pdf["half"].iloc[0]), pdf["positive"].to_numpy(bool)
        if not positive.any():
            return pd.DataFrame({"shard": pd.Series(dtype="int64"), "half": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "w": pd.Series(dtype="object")})
        got = descend(pdf["f"].tolist(), positive, w[half], prior, seed)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "half": [half], "n": [len(pdf)], "w": [(got * len(pdf)).tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "half": [int(pdf["half"].iloc[0])], "n": [int(pdf["n"].sum())], "w": [sum(np.frombuffer(x) for x in pdf["w"]).tobytes()]})

    schema = "shard long, half long, n long, w binary"
    got = train.groupBy("shard").applyInPandas(run, schema)
    got = got.groupBy("half", F.pmod("shard", F.lit(32)).alias("g")).applyInPandas(added, schema)
    total: dict[int, tuple[int, np.ndarray]] = {}
    for r in got.orderBy("half", "shard").collect():  # 64 rows at most
        n, s = total.get(r["half"], (0, 0.0))
        total[r["half"]] = n + r["n"], s + np.frombuffer(r["w"])
    return {h: s / n for h, (n, s) in total.items()}


def prior_of(counts: list[tuple[int, int, int]]) -> float:
    """counts: bin, positives, all rows. The ratio of the two tails above the cut where it is surely least: with its standard
    error, among the cuts that keep a TAIL of the positives."""
    p, u = (np.cumsum([r[k] for r in sorted(counts, reverse=True)]).astype(float) for k in (1, 2))
    if not len(p) or not p[-1]:
        return 0.5
    kept, share = p / p[-1], u / u[-1]
    on = kept >= TAIL
    kept, share = kept[on], share[on]
    noise = np.sqrt(kept * (1 - kept) / p[-1]) + np.sqrt(share * (1 - share) / u[-1])
    return float(np.clip((share / kept)[np.argmin((share + noise) / kept)], 0.05, 0.99))


def featurised(documents: DataFrame) -> DataFrame:
    """doc_id, f: every document's feature numbers, packed."""

    def rows(batches):
        for part, t in tk.pieces(batches, "text"):
            f, at = features(t)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tk.packed(f, at), pa.binary())], ["doc_id", "f"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, f binary")


def fit(rows: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Weights and the estimated prior, from the learning rows of featurised documents (a written table)."""
    learn = fold_of("doc_id", FOLDS) != HELD
    trusted = labels.where(learn & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q")).where("q = 1").select("doc_id", F.lit(True).alias("positive"))
    train = rows.where(learn).join(trusted, "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    n, found = train.agg(F.count("*"), F.count_if("positive")).first()
    if not found:
        return np.zeros(WIDTH), 0.5
    shards = 2 * max(1, math.ceil(n / (2 * SHARD)))
    train = written(train.withColumn("shard", F.pmod(F.xxhash64("doc_id", "f"), F.lit(shards))).withColumn("half", F.pmod("shard", F.lit(2))), "pu-train")
    zero = np.zeros(WIDTH)
    first = one_round(train, {0: zero, 1: zero}, None, 0)
    other = rows.sparkSession.sparkContext.broadcast({0: first.get(1, zero), 1: first.get(0, zero)})

    def histogram(batches):
        count = np.zeros((2, 4096), np.int64)
        for b in batches:
            f, at = unpacked(b.column(0).to_pylist())
            half, positive = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            z = np.where(half == 0, logits(f, at, other.value[0]), logits(f, at, other.value[1]))
            place = np.minimum((sigmoid(z) * 4096).astype(np.int64), 4095)
            count += np.stack((np.bincount(place[positive], minlength=4096), np.bincount(place, minlength=4096)))
        some = np.flatnonzero(count[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[0, some]), pa.array(count[1, some])], ["bin", "p", "u"])

    tails = train.select("f", "half", "positive").mapInArrow(histogram, "bin long, p long, u long").groupBy("bin").agg(F.sum("p"), F.sum("u")).collect()  # 4,096 bins at most
    prior = prior_of([tuple(r) for r in tails])
    w, whole = zero, train.withColumn("half", F.lit(-1).cast("long"))
    for k in range(ROUNDS):
        w = one_round(whole, {-1: w}, prior, k + 1)[-1]
    return w, prior


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score: one row per document."""
    featured = written(featurised(documents), "pu-rows")
    weights = documents.sparkSession.sparkContext.broadcast(fit(featured, labels)[0])

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(sigmoid(logits(*unpacked(b.column(1).to_pylist()), weights.value)), 9))], ["doc_id", "score"])

    out = featured.mapInArrow(rows, "doc_id long, score double")
    return out.select("doc_id", (fold_of("doc_id", FOLDS) == HELD).alias("held_out"), "score")

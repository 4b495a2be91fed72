"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio between trusted and raw text.

Words are hashed singly and in pairs into BUCKETS buckets. One multinomial is estimated from all documents
(raw), one from trusted documents (target), both with add-one smoothing. A document's score is the mean over
its n-grams of log(target / raw). It is kept if no base rule fails and score >= threshold.

Defined cases: a null or empty text has no words, fails the base rules and gets score 0; repeated rows are
each scored; rows with a null doc_id are scored and never trusted; with no trusted rows every ratio is 0; extra
columns of the inputs are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

BUCKETS = 1 << 14
MAX_TRUSTED = 20_000
THRESHOLD = -0.1
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def buckets(t: tk.Texts, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of single words and of pairs, then the texts' ranges and the word ranges."""
    start, end, own = t.words()
    words = t.runs(prefix, start, end)
    pairs, own2 = tk.grams(words, own, 2)
    both = np.concatenate((words, pairs)) & tk.U(BUCKETS - 1)
    return both.astype(np.int64), own, own2


def gram_counts(docs: DataFrame) -> DataFrame:
    """(bucket, raw, target) sums over all documents; docs: text, trusted."""

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part, t in tk.pieces(batches, "text"):
            b, own, own2 = buckets(t, t.prefix())
            raw += np.bincount(b, minlength=BUCKETS)
            good = np.asarray(part.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
            if good.any():
                inside = np.concatenate((np.repeat(good, np.diff(own)), np.repeat(good, np.diff(own2))))
                target += np.bincount(b[inside], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return docs.select("text", "trusted").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit_ratio(documents: DataFrame, trusted_ids: DataFrame, max_trusted: int = MAX_TRUSTED) -> np.ndarray:
    """log(target / raw) by bucket. The target is fitted on at most max_trusted trusted rows, those with the
    smallest hash of their id, so its ids can be broadcast; the raw counts cover all documents."""
    ids = trusted_ids.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted).withColumn("trusted", F.lit(True))
    rows = gram_counts(documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left")).collect()  # at most BUCKETS rows
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for b, r, t in rows:
        raw[b] += r
        target[b] += t
    if target.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def score_texts(t: tk.Texts, ratio: np.ndarray) -> list[np.ndarray]:
    """The columns of SCHEMA after doc_id."""
    prefix = t.prefix()
    b, own, own2 = buckets(t, prefix)
    n = np.diff(own)
    single, pair = ratio[b[: own[-1]]], ratio[b[own[-1] :]]
    count = n + np.diff(own2)
    score = np.round((tk.per_text_sum(single, own) + tk.per_text_sum(pair, own2)) / np.maximum(count, 1), 9)
    white = tk.WHITE[t.bytes]
    chars = tk.per_text_sum(~white & ((t.bytes & 0xC0) != 0x80), t.at)
    symbols = tk.per_text_sum(SYMBOLS[t.bytes], t.at)
    start, end, _ = t.words()
    three, own3 = tk.grams(t.runs(prefix, start, end), own, 3)
    where = tk.of_text(own3)
    key = tk.mix(three + where.astype(np.uint64) * tk.U(tk.BASE))
    order = np.argsort(key)
    ks = key[order]
    same = ks[1:] == ks[:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(own[-1] + 1, np.int64)
    at = (own[where] + np.arange(len(key)) - own3[where])[twice]
    np.add.at(covered, at, 1) if len(at) else None
    c = np.cumsum(covered)
    hit = c[:-1].copy()
    hit[3:] -= c[:-4] if len(c) > 4 else 0
    repeat = tk.per_text_sum(hit > 0, own)
    # lines: split at \n; a line counts if it has a word and equals an earlier line of its text
    ls, le = t.spans(t.bytes != 10)
    wc = np.searchsorted(start, le) - np.searchsorted(start, ls)
    ls, le = ls[wc > 0], le[wc > 0]
    lown = t.owner(ls)
    lw = tk.of_text(lown)
    lk = tk.mix(t.runs(prefix, ls, le) + lw.astype(np.uint64) * tk.U(tk.BASE))
    lo = np.argsort(lk, kind="stable")
    dup = np.zeros(len(lk), bool)
    dup[lo[1:][lk[lo][1:] == lk[lo][:-1]]] = True
    return [n, chars, symbols, tk.per_text_sum(dup, lown), repeat, score]


def quality(documents: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """One row per document: base measures, score, base_failed, kept."""
    ratio = documents.sparkSession.sparkContext.broadcast(fit_ratio(documents, trusted_ids, max_trusted))

    def rows(batches):
        for part, t in tk.pieces(batches, "text"):
            cols = score_texts(t, ratio.value)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c.astype(np.int64)) for c in cols[:-1]), pa.array(cols[-1])], [f.split()[0] for f in SCHEMA.split(", ")])

    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return documents.select("doc_id", "text").mapInArrow(rows, SCHEMA).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))

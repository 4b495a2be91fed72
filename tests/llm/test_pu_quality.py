"""The quality classifier: held-out labels of a given table, the prior, labels it must not see, and hard rows."""

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ledgerspark.llm import entries, pu_quality
from ledgerspark.llm import textkit as tk

SF = "/root/testdata/sf0.01"


def test_query_on_held_out_labels(spark):
    got = {r["doc_id"]: r for r in entries.QUERIES["op12_quality_classifier"](spark, SF).collect()}
    ids = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id"]).column(0).to_pylist()
    assert sorted(got) == sorted(ids)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    good, bad = ([r["score"] for i, r in got.items() if r["held_out"] and labels.get(i) == y] for y in (1, 0))
    assert np.mean([(x > y) + (x == y) / 2 for x in good for y in bad]) > 0.9
    assert np.mean(np.array(good) >= 0.3) > 0.97 and np.mean(np.array(bad) >= 0.3) < 0.5


def documents(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    plain = lambda: " ".join(rng.choice(words, 60)) + "."
    rows = [(i, plain() if i % 3 else plain().upper().replace(" ", "$$ "), 0, "x") for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, f int, score string").repartition(4).cache()


def test_zero_labels_and_held_out_labels_are_not_read(spark):
    docs = documents(spark)
    ones = [(i, 1) for i in range(0, 400) if i % 3 and i % 2]
    seen = lambda rows: {r["doc_id"]: r["score"] for r in pu_quality.quality_scores(docs, spark.createDataFrame(rows, "doc_id long, quality int")).collect()}
    first = seen(ones)
    again = seen([*ones, *((i, 0) for i in range(1, 400, 6)), *((i, 1) for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0), (None, 1), (3, None)])
    # a label of 0 beside a 1 of the same id loses; other zeros change nothing
    assert first == again
    good, bad = ([s for i, s in first.items() if (i % 3 > 0) == y] for y in (True, False))
    assert np.mean(np.array(good) > 0.3) > 0.95 and np.mean(np.array(bad) > 0.3) < 0.05


def test_hard_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "a b c"), (5, "lorem ipsum " * 60_000), (6, "ß é $$ 1"), (7, "x" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for labels in ([(4, 1), (6, 1), (7, 1), (1, 0)], []):
        got = pu_quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
        assert all(0 <= r["score"] <= 1 and (labels or r["score"] == 0.5) for r in got)
        assert len({r["score"] for r in got if r["doc_id"] in (1, 2)}) == 1
    none = docs.where("doc_id = 99")
    assert pu_quality.quality_scores(none, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_prior_of_separable_scores():
    rng = np.random.default_rng(0)
    pos, neg = np.clip(rng.normal(3000, 300, 20_000), 0, 4095).astype(int), np.clip(rng.normal(900, 400, 6_000), 0, 4095).astype(int)
    u = np.concatenate((np.clip(rng.normal(3000, 300, 14_000), 0, 4095).astype(int), neg))
    p, a = np.bincount(pos, minlength=4096), np.bincount(u, minlength=4096)
    assert pu_quality.prior_of([(i, int(p[i]), int(a[i])) for i in range(4096) if a[i]]) == pytest.approx(0.7, abs=0.02)


def test_descent_lowers_the_risk():
    """The risk of the weights, computed from its definition, falls, and its second part stays about 0 or above."""
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "DD", "EE!", "7"], 30, p=[0.4, 0.3, 0.2, 0.05, 0.03, 0.02] if i % 4 else [0.05, 0.05, 0.1, 0.3, 0.3, 0.2])) for i in range(400)]
    rows = tk.packed(*pu_quality.features(tk.Texts(pa.array(texts))))
    positive = np.array([i % 4 > 0 and i % 2 == 0 for i in range(400)])

    def risk(w, prior=0.75):
        z = pu_quality.logits(*pu_quality.unpacked(rows), w)
        soft = lambda x: np.log1p(np.exp(x))
        rest = soft(z).mean() - prior * soft(z[positive]).mean()
        return prior * soft(-z[positive]).mean() + max(0.0, rest), rest

    w = pu_quality.descend(rows, positive, np.zeros(pu_quality.WIDTH), 0.75, 1)
    assert risk(w)[0] < 0.5 * risk(np.zeros(pu_quality.WIDTH))[0] and risk(w)[1] > -0.05

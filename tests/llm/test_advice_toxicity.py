"""Pattern voters on texts that no lexicon word marks."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerspark.llm import textkit as tk
from ledgerspark.llm import toxicity


@pytest.mark.parametrize(("text", "voter"), [("please shut  up now", "go"), ("Go away!", "go"), ("get lost, drop dead", "go"), ("You are trashy", "address"), ("well, u r so dumbest of all", "address"), ("you see, she goes away", None), (None, None)])
def test_text_that_only_a_pattern_matches(text, voter):
    bits, _, _ = toxicity.votes_and_words(tk.Texts(pa.array(["clean words", text, "", "an idiot"], pa.string())), toxicity.lexicon())
    nothing = 1 << toxicity.VOTERS.index("nothing")
    assert bits[0] == bits[2] == nothing and bits[3] & toxicity.ANY
    assert bits[1] == (1 << toxicity.VOTERS.index(voter) if voter else nothing)


def corpus(n):
    """Abuse in words that no hand-written lexicon knows; ids held out among the rest; null and repeated ids."""
    common = [f"bel{i}on" for i in range(60)]
    rows = []
    for i in range(n):
        words = [common[(i * 7 + j * (i % 5 + 1)) % 60] for j in range(40)]
        if i % 4 == 0:
            words[3::9] = [f"grumz{(i + k) % 9}ak" for k in range(len(words[3::9]))]
        rows.append((i, " ".join(words), "x", i % 3))
    return [*rows, (None, rows[0][1], "x", 0), (None, None, "x", 0), (1, rows[4][1], "x", 0), (n, "", "x", 0)]


def test_unknown_words_are_learnt_and_held_out_rows_found(spark):
    rows = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, bits long").repartition(4)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(None, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(held) > 100 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 3 == 1) for r in got)
    assert sum((r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.7 for r in got)


def test_held_out_labels_change_nothing(spark):
    docs = spark.createDataFrame(corpus(200), "doc_id long, text string, lang string, bits long").coalesce(1)
    scores = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, 1, int(i % 4 == 0) ^ (flip if zlib.crc32(str(i).encode()) % 3 == 1 else 0)) for i in range(200)], "doc_id long, quality int, toxic int")
        scores.append(sorted((str(r["doc_id"]), r["score"]) for r in toxicity.toxicity(docs, labels).collect()))
    assert scores[0] == scores[1]


def test_label_model_tree_and_labels():
    v = {k: 1 << i for i, k in enumerate(toxicity.VOTERS)}
    bits = np.array([v["fool"] | v["dull"], v["fool"], v["nothing"], v["nothing"], v["dull"], v["fool"]])
    label = np.array([1, -1, 0, -1, -1, 1])
    m = toxicity.LabelModel().fit(bits, label, np.array([20, 30, 80, 300, 5, 10]))
    p = m.posterior(bits, label)
    assert p[0] > 0.95 and p[1] > 0.5 and p[2] < 0.05 and p[3] < 0.05
    assert sorted(set(range(len(toxicity.VOTERS))) - {0}) == sorted(i for i in range(len(toxicity.VOTERS)) if m.parent[i] != i)

"""Families of texts that share most shingles but rarely link: pairs are made about as often as they link."""

import random

import pytest
from test_contracts import components

from ledgerspark.llm import jaccard


def family(n, seed=5):
    """Texts of one hundred words, five of eight places changed to one of three words."""
    draw, made = random.Random(seed), {}
    for i in range(n):
        w = [f"w{k}" for k in range(100)]
        for k in draw.sample(range(8), 5):
            w[6 + 12 * k] = f"x{draw.randint(0, 2)}"
        made[i] = " ".join(w)
    return made


@pytest.mark.parametrize("n", [150, 600])
def test_pairs_made_follow_the_links(spark, monkeypatch, n):
    seen, real = {"near-pairs": 0, "near-links": 0}, jaccard.written

    def spy(df, name):
        out = real(df, name)
        if name in seen:
            seen[name] += out.count()
        return out

    monkeypatch.setattr(jaccard, "written", spy)
    texts = family(n)
    found = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == components(texts)
    assert seen["near-pairs"] <= 3 * seen["near-links"] + 30 * n, seen

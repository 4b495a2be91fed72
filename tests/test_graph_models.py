import numpy as np
import pytest

from ledgerspark.operators import models as m
from ledgerspark.operators import network as g


@pytest.fixture(scope="module")
def cards(spark):
    """A path 1-2-3-4, a lone card 5 and a square 10-11-13-12, by shared devices; card 1 and 13 have fraud."""
    pairs = [(1, 2), (2, 3), (3, 4), (10, 11), (11, 13), (10, 12), (12, 13)]
    rows = [(c, f"d{i}") for i, p in enumerate(pairs) for c in p] + [(5, None)]
    return spark.createDataFrame([(i, c, d, None, int(c in (1, 13))) for i, (c, d) in enumerate(rows)], "TransactionID long, card1 long, DeviceInfo string, addr1 long, isFraud int").cache()


def test_communities(cards):
    got = {r.card1: (r.community, r.size, r.fraud_rate) for r in g.community_stats(cards).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 4), (1, 4, 0.25)), 5: (5, 1, 0.0), **dict.fromkeys((10, 11, 12, 13), (10, 4, 0.25))}


def test_betweenness_of_all_sources(cards):
    got = {r.card1: r.betweenness for r in g.betweenness(cards).collect()}
    want = {1: 0, 2: 4, 3: 4, 4: 0, 5: 0, 10: 1, 11: 1, 12: 1, 13: 1}  # ordered pairs whose shortest paths pass
    assert got == {k: pytest.approx(v / 56) for k, v in want.items()}


def test_pagerank_sums_to_one(cards):
    got = {r.card1: r.pagerank for r in g.pagerank(cards, tolerance=1e-9).collect()}
    assert sum(got.values()) == pytest.approx(1) and got[2] == pytest.approx(got[3]) and got[2] > got[1] > got[5]


def test_graph_without_cards(cards):
    none = cards.where("card1 < 0")
    assert g.community_stats(none).count() == g.pagerank(none).count() == g.betweenness(none).count() == 0


def test_isotonic_is_monotone(spark):
    rng = np.random.default_rng(1)
    p = rng.random(400).round(2)
    df = spark.createDataFrame([(i, float(x), int(rng.random() < x**2)) for i, x in enumerate(p)], "TransactionID long, proba double, isFraud int")
    out = m.isotonic_calibration(df, df.TransactionID >= 0)
    c = [r.calibrated for r in out.orderBy("proba").collect()]
    b = m.brier(out).first()
    assert c == sorted(c) and b.brier_after < b.brier_before


def test_isolated_point_scores_most(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(300)] + [(999, 500.0, -500.0)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "TransactionID long, a double, b double, isFraud int")
    got = {r.TransactionID: r.iso_score for r in m.isolation_forest(df, ["a", "b"], 30, 64).collect()}
    assert max(got, key=got.get) == 999 and len(got) == 301

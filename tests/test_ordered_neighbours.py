"""Ranges and running sums, nearest neighbours, oversampling and modularity against plain Python."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import decide, models, modularity, neighbours, network, ordered, prepare
from ledgerspark.sources.views import txn_ord

SF = "/root/testdata/sf0.001"


def test_no_range_holds_more_than_its_share(spark):
    rows = spark.range(40_000).select((F.rand(1) ** 12).alias("x"))  # nearly all near 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = [r["count"] for r in ordered.ranged(rows, [F.asc("x")]).groupBy("_range").count().collect()]
    assert sum(counts) == 40_000 and max(counts) <= 2 * 40_000 / n


@pytest.mark.parametrize("down", [False, True])
def test_running_sums_of_any_range(spark, down):
    rng = np.random.default_rng(4)
    rows = [(int(k), float(x), int(v)) for k, x, v in zip(rng.integers(0, 3, 500), rng.normal(0, 1, 500) ** 9 * 1e6, rng.integers(-5, 9, 500))] + [(1, None, 4), (2, float("inf"), 1)]
    df = spark.createDataFrame(rows, "k long, x double, v long")
    key = lambda x: (x is not None, x) if x is not None else (False, 0.0)
    for keys in ((), ("k",)):
        got = {(r["k"], r["x"]): r["s"] for r in ordered.running(df, "x", {"v": "s"}, down, keys).collect()}
        for k, x, _ in rows:
            mates = [v for j, y, v in rows if (not keys or j == k) and (key(y) >= key(x) if down else key(y) <= key(x))]
            assert got[k, x] == sum(mates), (keys, k, x)
    assert ordered.running(df.where("k > 9"), "x", {"v": "s"}).count() == 0


def test_null_scores_keep_their_rows(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.5), (4, -7e9), (5, None)], "TransactionID long, proba double")
    assert {r[0]: r[1] for r in decide.rank_normalised(df).collect()} == {1: pytest.approx(2.5 / 3), 2: None, 3: pytest.approx(2.5 / 3), 4: pytest.approx(1 / 3), 5: None}


def brute(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("n, dims, least", [(400, 3, 1.0), (6000, 8, 0.9)])
def test_recall_of_neighbours(spark, n, dims, least):
    x = np.random.default_rng(7).normal(size=(n, dims))
    x[: n // 3] *= 0.05  # a dense cluster
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, x array<double>")
    got = {}
    for r in neighbours.nearest(points, 5).collect():
        got.setdefault(r["key"], []).append((r["place"], r["other"], r["distance"]))
    want = brute(x, 5)
    assert all([p for p, _, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values()) and len(got) == n
    assert np.mean([len({o for _, o, _ in got[i]} & set(want[i].tolist())) / 5 for i in range(n)]) >= least
    assert all(abs(d - np.linalg.norm(x[i] - x[o])) < 1e-9 for i in range(0, n, 97) for _, o, d in got[i])


def test_upper_levels_of_the_trees(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 64)
    x = np.random.default_rng(8).normal(size=(3000, 4))
    got = neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, x array<double>"), 5, 10).collect()
    want = brute(x, 5)
    assert np.mean([r["other"] in want[r["key"]] for r in got]) >= 0.9 and len(got) == 15_000


def test_made_rows_lie_between_neighbours(spark):
    rng = np.random.default_rng(9)
    pos = rng.normal(size=(30, 2)) * [1.0, 50.0]
    rows = [(i, 1, float(a), float(b)) for i, (a, b) in enumerate(pos)] + [(100 + i, 0, float(i), 0.0) for i in range(300)] + [(900, 1, float(pos[0, 0]), float(pos[0, 1])), (901, 1, 0.5, None)]
    out = prepare.oversampled(spark.createDataFrame(rows, "TransactionID long, isFraud int, a double, b double"), ("a", "b"), 0.4, 3)
    made = [(r["a"], r["b"]) for r in out.where("synthetic = 1").collect()]
    assert len(made) == int(300 * 0.4 / 0.6) - 32 and out.where("synthetic = 0").count() == len(rows)
    minority = np.array([(a, np.nan if b is None else b) for _, y, a, b in rows if y])
    places = np.unique(np.where(np.isnan(minority), np.nanmean(minority, 0), minority), axis=0)
    scale = np.nanstd(minority, 0)
    near = brute(places / scale, 3)

    def between(m):
        for i, j in itertools.product(range(len(places)), range(3)):
            p, q = places[i], places[near[i, j]]
            t = (m - p) @ ((q - p) / scale**2) / (((q - p) / scale) ** 2).sum()
            if -1e-6 <= t <= 1 + 1e-6 and np.abs((p + t * (q - p) - m) / scale).max() < 1e-6:
                return True
        return False

    whole = [m for m in made if m[1] is not None]
    assert sum(between(np.array(m)) for m in whole) >= len(whole) - 8  # rows beside the one whose b is null take its neighbour's
    assert sum(any(np.allclose(m, p) for p in places) for m in whole) <= 2


def test_minority_of_one_place_or_none(spark):
    df = spark.createDataFrame([(i, int(i < 3), 1.0) for i in range(40)], "TransactionID long, isFraud int, a double")
    assert [r["a"] for r in prepare.oversampled(df, ("a",), 0.5).where("synthetic = 1").collect()] == [1.0] * 34
    assert prepare.oversampled(df.where("isFraud = 0"), ("a",), 0.5).where("synthetic = 1").count() == 0


def test_folds_resample_only_what_they_fit_on(spark):
    rows = spark.range(400).select(F.col("id").alias("TransactionID"), (F.col("id") % 10 == 0).cast("int").alias("isFraud"), *((F.col("id") * (i + 1) % 37).cast("double").alias(c) for i, c in enumerate(models.FEATURES)))
    data = models.stratified_kfold(models.prepared(rows), 4).withColumn("is_test", F.lit(0))
    train = data.where("fold <> 0")
    got = models.resampled(train, 0.4)
    n = train.groupBy("isFraud").count().collect()
    neg = next(r["count"] for r in n if r["isFraud"] == 0)
    assert got.where("label = 1").count() == int(neg * 0.4 / 0.6) and got.where("label = 0").count() == neg
    ends = train.where("isFraud = 1").agg(F.min("TransactionAmt"), F.max("TransactionAmt")).first()
    assert got.where("label = 1").where((F.col("TransactionAmt") < ends[0]) | (F.col("TransactionAmt") > ends[1])).count() == 0
    long = models.oof_predictions(data, ("logistic",), 4, 0.4)
    assert long.count() == 400 and long.where("proba BETWEEN 0 AND 1").count() == 400 and long.select("TransactionID").distinct().count() == 400


def plain_modularity(edges, label):
    m2 = 2 * len(edges)
    k = {}
    for a, b in edges:
        k[a], k[b] = k.get(a, 0) + 1, k.get(b, 0) + 1
    inside = sum(2 for a, b in edges if label[a] == label[b]) / m2
    return inside - sum((sum(k[n] for n in k if label[n] == c) / m2) ** 2 for c in set(label.values()))


def test_louvain_of_small_graphs(spark):
    clique = lambda ns: list(itertools.combinations(ns, 2))
    edges = clique(range(0, 5)) + clique(range(10, 15)) + clique(range(20, 24)) + [(4, 10), (14, 20), (30, 31)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["label"] for r in modularity.louvain(df).collect()}
    assert got == {**dict.fromkeys(range(5), 0), **dict.fromkeys(range(10, 15), 10), **dict.fromkeys(range(20, 24), 20), 30: 30, 31: 30}
    one = {n: 30 if n >= 30 else 0 for n in got}  # components
    assert plain_modularity(edges, got) > plain_modularity(edges, one)
    whole = spark.createDataFrame(list(one.items()), "node long, label long")
    assert {r[0]: r[1] for r in modularity.better_split(df, whole, modularity.louvain(df)).collect()} == got
    labels = spark.createDataFrame(list(got.items()), "node long, label long")
    assert modularity.modularity(df, labels).first()[0] == pytest.approx(plain_modularity(edges, got))
    assert modularity.louvain(df.where("src > 99")).count() == 0 and modularity.modularity(df.where("src > 99"), labels).first()[0] == 0


def test_modular_communities_are_no_worse_than_components(spark):
    t = txn_ord(spark, SF).cache()
    edges = [(r["src"], r["dst"]) for r in network.graph_edges(t).collect()]
    whole = {r[0]: r[1] for r in network.communities(t).collect()}
    a, b = ({r["card1"]: r["community"] for r in network.modular_communities(t).collect()} for _ in range(2))
    assert a == b and set(a) == set(whole) and all(c == min(k for k, x in a.items() if x == c) for c in set(a.values()))
    assert all(whole[k] == whole[c] for k, c in a.items())  # communities lie within components
    assert plain_modularity(edges, a) >= plain_modularity(edges, whole) - 1e-12

"""Learned operators on planted signals and against numpy, in place of row counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import models as m
from ledgerspark.plans.registry import queries
from ledgerspark.sources.views import v_feat

SF = "/root/testdata/sf0.001"
VS = [f"V{j}" for j in range(1, 9)]


@pytest.fixture(scope="module")
def planted(spark):
    """600 rows whose label follows TransactionAmt and, less, hour; the other features are noise. TransactionDT goes with hour."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, len(m.FEATURES)))
    y = (2.5 * x[:, 0] + 1.0 * x[:, m.FEATURES.index("hour")] + rng.normal(0, 0.5, 600) > 1.5).astype(int)
    rows = [(i, int(y[i]), int(1000 * x[i, m.FEATURES.index("hour")]), *map(float, x[i])) for i in range(600)]
    return spark.createDataFrame(rows, "TransactionID long, isFraud int, TransactionDT long, " + ", ".join(f"{c} double" for c in m.FEATURES)).repartition(4).cache()


@pytest.mark.parametrize("kind", ["gbt", "gbt_shallow", "gbt_sampled", "forest", "perceptron", "logistic"])
def test_models_find_the_signal(planted, kind):
    out = m.trained(planted, kind)
    n = dict(planted.groupBy("isFraud").count().collect())
    assert out.count() == sum(-(-c // 5) for c in n.values()) and m.auc_of(out, "proba") > 0.85


def test_stacking_is_no_worse_than_its_parts(planted):
    out = m.oof_stacking(planted, ("gbt_shallow", "logistic"), 3)
    assert out.count() == out.select("TransactionID").distinct().count() and {"p_gbt_shallow", "p_logistic", "p_isolation", "proba"} <= set(out.columns)
    assert m.auc_of(out, "proba") > 0.85


def test_importances_and_selection(planted):
    got = {r["feature"]: r["importance"] for r in m.importances(planted, ("gbt_shallow", "forest")).collect()}
    assert sum(got.values()) == pytest.approx(1) and sorted(got, key=got.get)[-2:] == ["hour", "TransactionAmt"]
    kept = {r["feature"]: (r["importance"], r["kept"]) for r in m.selected_features(planted, 0.1).collect()}
    assert {c for c, (_, k) in kept.items() if k} <= {"TransactionAmt", "hour"} and kept["TransactionAmt"][1] == 1 and all((i >= 0.1) == bool(k) for i, k in kept.values())


def test_search_covers_the_grid(planted):
    got = m.tuned(planted, (2, 3), (0.1,), (1.0,), rounds=3).collect()
    assert [(r["max_depth"], r["step_size"], r["subsampling"]) for r in got] == [(2, 0.1, 1.0), (3, 0.1, 1.0)] and all(0.8 < r["auc"] <= 1 for r in got)


def test_shift_is_told_from_none(planted):
    late = m.adversarial_validation(planted, F.col("TransactionDT") > 500).collect()
    none = m.adversarial_validation(planted, F.pmod(F.xxhash64("TransactionID"), F.lit(2)) == 0).collect()
    assert late[0]["auc"] > 0.9 and late[0]["status"] == "severe" and late[0]["feature"] == "hour"
    assert abs(none[0]["auc"] - 0.5) < 0.1 and len(none) == 10


def filled(spark):
    rows = v_feat(spark, SF).orderBy("TransactionID").select("TransactionID", *VS).collect()
    x = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])
    return [r[0] for r in rows], np.where(np.isnan(x), np.nanmedian(x, 0), x)


def test_components_equal_numpy(spark):
    ids, x = filled(spark)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, u = np.linalg.eigh(np.cov(z.T))
    u = u[:, ::-1][:, :5]
    u = u * np.sign(u[np.abs(u).argmax(0), range(5)])
    got = {r[0]: tuple(r[1:]) for r in m.pca_v(v_feat(spark, SF), VS).collect()}
    assert all(got[i] == pytest.approx(tuple(v), abs=1e-6) for i, v in zip(ids, z @ u))


def test_reconstruction_errors_equal_numpy(spark):
    ids, x = filled(spark)
    df = v_feat(spark, SF).withColumn("isFraud", (F.col("TransactionID") % 9 == 0).cast("int"))
    own = np.array(ids) % 9 != 0
    med = np.array([[np.nan if v is None else v for v in r] for r in v_feat(spark, SF).orderBy("TransactionID").select(*VS).collect()])
    assert np.isnan(med).any()
    mean, std = x[own].mean(0), x[own].std(0, ddof=1)
    z = (x - mean) / std
    _, u = np.linalg.eigh(np.cov(z[own].T))
    u = u[:, ::-1][:, :3]
    want = ((z - z @ u @ u.T) ** 2).mean(1)
    got = {r["TransactionID"]: r for r in m.pca_anomaly(df, VS, 3).collect()}
    cut = np.percentile(want[own], 95)
    for i, e in zip(ids, want):
        assert got[i]["error"] == pytest.approx(e, abs=1e-6) and got[i]["threshold"] == pytest.approx(cut, abs=1e-6) and got[i]["is_anomaly"] == int(got[i]["error"] > got[i]["threshold"])


def test_saved_pipeline_scores_alike(spark):
    got = queries()["persist_pipeline"](spark, SF).collect()
    assert len(got) == 1000 and all(r["same"] == 1 and 0 <= r["proba"] <= 1 for r in got)

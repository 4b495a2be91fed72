from pyspark.sql import functions as F

from ledgerspark.operators import robust as r


def scores(spark, rows):
    return spark.createDataFrame(rows, "TransactionID long, isFraud int, proba double")


def test_quantiles_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 4.0), ("b", None), ("c", -3.0)], "k string, x double")
    got = {x.k: x.q for x in r.quantiles(df, "x", 0.75, ("k",)).collect()}
    assert got == {"a": 2.5, "c": -3.0}


def test_conformal_without_calibration_keeps_rows(spark):
    got = r.conformal_sets(scores(spark, [(1, 0, 0.2), (2, 1, 0.9)]), F.lit(False)).orderBy("TransactionID").collect()
    assert [(x.prediction_set, x.is_uncertain, x.confidence) for x in got] == [("0", 0, 0.8), ("1", 0, 0.9)]


def test_conformal_empty(spark):
    assert r.conformal_sets(scores(spark, []), F.lit(True)).collect() == []

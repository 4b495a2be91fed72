"""Every feature on rows that repeat an id or have none, and what the plan of all features costs."""

import re

from pyspark.sql import functions as F

from ledgerspark.operators import decide, features
from ledgerspark.plans.registry import REGISTERED
from ledgerspark.sources.views import _EV, _view, txn_ev
from ledgerspark.streaming import arrivals, handoff, streams

SF = "/root/testdata/sf0.001"


def test_repeated_and_null_ids_keep_their_rows(spark):
    t = txn_ev(spark, SF).withColumn("TransactionID", F.expr("CASE WHEN TransactionID % 10 = 0 THEN 7 WHEN TransactionID % 10 = 1 THEN NULL ELSE TransactionID END"))
    n = t.count()
    out = decide.scored(features.all_features(t))
    assert out.count() == n and out.where("TransactionID IS NULL").count() == t.where("TransactionID IS NULL").count() > 0
    assert out.where("risk_score IS NULL OR explanation IS NULL").count() == 0


def test_exchanges_of_all_features(spark):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = features.all_features(txn_ev(spark, SF))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    plain = [x for x in re.findall(r"\bExchange (\w+)", plan)]
    # one for the windows; two for each distinct count by a key; one for each other key; the rows themselves move once
    assert len(plain) <= 22 and plan.count("repartition") <= 1, plan
    assert "SortMergeJoin" not in plan and "get_json_object" not in plan


def test_stream_model_equals_batch(spark, tmp_path):
    fit, new = "TransactionID % 2 = 0", "TransactionID % 2 = 1"
    handoff.fit(txn_ev(spark, SF).where(fit), str(tmp_path), True)
    fitted = handoff.load(spark, str(tmp_path), True)
    batch = {r[0]: tuple(r[1:]) for r in handoff.scored(txn_ev(spark, SF).where(new), fitted).collect()}
    stream = streams.drained(handoff.scored(_view(spark, SF, _EV, events=streams.event_stream(spark, SF, False)).where(new), fitted), "append")
    got = {r[0]: tuple(r[1:]) for r in stream.collect()}
    assert got == batch and len(got) > 400 and len({p for p, _, _ in got.values()}) > 5


def test_late_rows_are_dropped_and_counted(spark):
    assert REGISTERED["stream_late_rows"][0](spark, SF).first()[0] > 0
    parts = arrivals.deliveries(spark, SF)
    assert len(parts) == 4 and sum(p.count() for p in parts) == 1050

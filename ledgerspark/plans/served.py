"""Queries of requests, result documents, streams over several deliveries and the hand-off to streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as doc
from ..operators import features as f
from ..operators import models as m
from ..operators import network as g
from ..operators import requests as req
from ..operators import robust as r
from ..sources import store
from ..sources.views import _EV, _view, duckdb_views, txn_ev, txn_ord
from ..streaming import arrivals, handoff, streams
from .more import AUC_OF, SECOND, T2, TIER
from .registry import CAL, CHECKS, CM, CONFORMAL, COST, DT, HOUR, ID, REGISTERED, A, CATCH, STABLE, SURE, d, graph, op

# --- Requests: the transactions as JSON texts, some of them broken in each way.
KIND = "TransactionID%20"
BODY = ("to_json(named_struct('TransactionAmt', CASE {K} WHEN 1 THEN NULL WHEN 2 THEN -TransactionAmt ELSE TransactionAmt END, 'hour_of_day', CASE {K} WHEN 3 THEN 24 WHEN 4 THEN NULL ELSE hour END, 'P_emaildomain', P_emaildomain, 'probas', map('first', CASE WHEN {K} IN (5, 6) THEN NULL ELSE proba END, 'second', CASE WHEN {K} IN (6, 7) THEN NULL ELSE other END)), map('ignoreNullFields', 'false'))")


def requests(t: DataFrame) -> DataFrame:
    """Each transaction's request as text: by its id amounts and hours are missing or out of bounds, or the text is cut or not there."""
    t = f.time_features(t).withColumn("other", F.expr(SECOND))
    body = F.expr(BODY.format(K=KIND))
    broken = F.when(F.expr(f"{KIND} = 8"), F.substring(body, 1, 30)).when(F.expr(f"{KIND} = 9"), F.lit(None)).when(F.expr(f"{KIND} = 10"), F.lit('{"TransactionAmt": "many"}')).otherwise(body)
    return t.select(ID, broken.alias("body"))


ERROR = f"CASE WHEN k=9 THEN 'request: missing' WHEN k IN (8,10) THEN 'request: not JSON of the declared fields' WHEN k=1 THEN 'TransactionAmt: missing' WHEN k=2 AND {A}>0 THEN 'TransactionAmt: below 0' WHEN k=3 THEN 'hour_of_day: not from 0 to 23' END"
RULES = [
    ("h<=6 OR h>=23", "'Transaction at unusual hour ('||h||':00)'"),
    (f"{A}=floor({A}) AND {A}>=500 AND h<=6", f"format('Perfectly round high-value amount (${{:,.0f}}) at night', {A})"),
    (f"{A}>1000", f"format('High-value transaction (${{:,.2f}})', {A})"),
    ("p>0.5", "'ML models flag high fraud probability ('||printf('%.1f', round(p*100,1))||'%)'"),
    ("P_emaildomain IN ('protonmail.com','anonymous.com')", "'High-risk email domain ('||P_emaildomain||')'"),
]
WHY = "coalesce(nullif(concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} THEN {x} END" for c, x in RULES) + "),''),'No specific risk factors identified')"
ASKED = f"SELECT *, {ERROR} AS error, CASE WHEN k=4 THEN 12 ELSE hour END AS h, CASE WHEN k NOT IN (5,6) THEN proba END AS p1, CASE WHEN k NOT IN (6,7) THEN other END AS p2 FROM (SELECT *, {KIND} AS k FROM t2)"
ANSWER = f"SELECT *, least(100.0, 70*p+CASE WHEN h<=6 OR h>=23 THEN 10 ELSE 0 END+CASE WHEN {A}=floor({A}) AND {A}>=500 AND h<=6 THEN 10 ELSE 0 END+CASE WHEN {A}>1000 THEN 10 ELSE 0 END) AS risk_score FROM (SELECT *, coalesce((coalesce(p1,0.0)+coalesce(p2,0.0))/nullif(CAST(p1 IS NOT NULL AS INT)+CAST(p2 IS NOT NULL AS INT),0),0.5) AS p FROM ({ASKED}))"
AUTH = "CASE risk_category " + " ".join(f"WHEN '{k}' THEN '{v.replace(' Explain reason.', '')}'" for k, v in d.AUTH.items()) + " END"
GOOD = lambda x, n: f"CASE WHEN error IS NULL THEN {x} END AS {n}"
op("request_scores", [requests, req.responses, lambda t: t.withColumns({"reasons": F.array_join("top_risk_factors", " | "), "n_models": F.size(F.map_keys("model_contributions")), "first": F.col("model_contributions")["first"], "second": F.col("model_contributions")["second"]}).withColumn("n_models", F.when(F.col("error").isNull(), F.col("n_models")))],
   "error risk_score:1 risk_category auth_recommendation fraud_probability:4 reasons n_models:i first:4 second:4",
   f"WITH {T2} SELECT TransactionID, error, {GOOD('round(CAST(risk_score AS DECIMAL(18,6)),1)', 'risk_score')}, {GOOD('risk_category', 'risk_category')}, {GOOD(AUTH, 'auth_recommendation')}, {GOOD('p', 'fraud_probability')}, {GOOD(WHY, 'reasons')}, {GOOD('CAST(p1 IS NOT NULL AS INT)+CAST(p2 IS NOT NULL AS INT)', 'n_models')}, {GOOD('p1', 'first')}, {GOOD('p2', 'second')} FROM (SELECT *, {TIER} AS risk_category FROM ({ANSWER}))")

# --- Result documents: written as nested JSON, read by their declared schemas, and flattened to compare.
TWO = [f.time_features, lambda t: t.withColumn("other", F.expr(SECOND))]
store_as = lambda schema, name: lambda t: doc.stored(t, store.new_path(t.sparkSession, name), schema)
CM2 = CM.replace("proba", "{c}").replace("FROM t", "FROM t2")
op("metrics_document", [*TWO, lambda t: doc.metrics_document(t, ("proba", "other")), store_as(doc.METRICS, "metrics"), lambda t: t.select(F.explode("model_metrics").alias("model", "m")).select("model", "m.*").withColumns({n: F.col("confusion_matrix")[i][j] for i, r in enumerate((("tn", "fp"), ("fn", "tp"))) for j, n in enumerate(r)})],
   "model auc:6 f1:6 precision:6 recall:6 tn:i fp:i fn:i tp:i", f"WITH {T2} " + " UNION ALL ".join(f"SELECT '{c}' AS model, {AUC_OF.format(c=c, v='t2')} AS auc, * FROM ({CM2.format(c=c)})" for c in ("proba", "other")), key="")
op("threshold_document", [doc.threshold_document, store_as(doc.THRESHOLD, "threshold"), lambda t: t.select("optimal_threshold", "optimal_cost", "default_cost", "confusion.*", F.explode("curve").alias("at")).select("*", "at.*")],
   "optimal_threshold:6 optimal_cost:2 default_cost:2 tp:i fp:i fn:i tn:i threshold:6 cost:2",
   f"SELECT b.threshold AS optimal_threshold, b.cost AS optimal_cost, (SELECT arg_min(cost, i) FROM ({COST}) WHERE threshold>=0.5) AS default_cost, b.tp, b.fp, b.fn, (SELECT count(*) FROM t)-b.tp-b.fp-b.fn AS tn, c.threshold, c.cost FROM (SELECT * FROM ({COST}) ORDER BY cost, i LIMIT 1) b, (SELECT * FROM ({COST}) WHERE i%10=0) c", key="")
QCUT = CONFORMAL[CONFORMAL.index("FROM t, (SELECT max") + len("FROM t, ") :]
op("conformal_document", [lambda t: doc.conformal_document(t, F.expr(CAL)), store_as(doc.CONFORMAL, "conformal"), lambda t: t.withColumns({c: F.col("shares")[c] for c in ("certain_fraud", "certain_legit", "uncertain")})],
   "alpha:4 threshold:6 n:i certain_fraud:6 certain_legit:6 uncertain:6 mean_confidence:6 coverage:6",
   f"SELECT 0.05 AS alpha, (SELECT q FROM {QCUT}) AS threshold, count(*) AS n, avg(CAST(prediction_set='1' AS INT)) AS certain_fraud, avg(CAST(prediction_set='0' AS INT)) AS certain_legit, avg(CAST(prediction_set='0,1' AS INT)) AS uncertain, avg(confidence) AS mean_confidence, avg(CAST(contains(prediction_set, CAST(isFraud AS VARCHAR)) AS INT)) AS coverage FROM ({CONFORMAL}) WHERE NOT ({CAL})", key="")
MARKS = [f.amount_features, f.time_features, f.sim_swap]
op("robustness_document", [*MARKS, doc.robustness_document, store_as(doc.ROBUST, "robustness"), lambda t: t.select("passed", "total", "overall_pct", F.explode("tests").alias("metric", "v")).select("metric", "v.value", "v.pass_above", F.col("v.passed").cast("int").alias("ok"), "passed", "total", "overall_pct")],
   "metric value:4 pass_above:2 ok:i passed:i total:i overall_pct:4", f"SELECT metric, value, pass_above, passed AS ok, sum(passed) OVER () AS passed, count(*) OVER () AS total, 100*avg(passed) OVER () AS overall_pct FROM ({CHECKS.format(q=f'{CATCH} UNION ALL {STABLE} UNION ALL {SURE}')})", key="")

# --- Noise on the inputs: the same draws in SQL.
EVEN = lambda salt: f"(CAST('0x'||substr(md5(CAST(TransactionID AS VARCHAR)||'{salt}'),1,8) AS BIGINT)/2147483648.0::DOUBLE-1)"
SC = f"least(100.0, 70*{{p}}+CASE WHEN {HOUR}<=6 OR {HOUR}>=23 THEN 10 ELSE 0 END+CASE WHEN {{a}}=floor({{a}}) AND {{a}}>=500 AND {HOUR}<=6 THEN 10 ELSE 0 END+CASE WHEN {{a}}>1000 THEN 10 ELSE 0 END)"
TI = TIER.replace("risk_score", "{s}")
op("perturbation_stability", [f.time_features, lambda t: r.perturbation(t, d.point_score)], "risk_category n:i changed:i changed_share:6 mean_shift:4 max_shift:4",
   f"SELECT c0 AS risk_category, count(*) AS n, sum(CAST(c1<>c0 AS INT)) AS changed, avg(CAST(c1<>c0 AS INT)) AS changed_share, avg(abs(r1-r0)) AS mean_shift, max(abs(r1-r0)) AS max_shift FROM (SELECT *, {TI.format(s='s0')} AS c0, {TI.format(s='s1')} AS c1, round(CAST(s0 AS DECIMAL(18,6)),1)::DOUBLE AS r0, round(CAST(s1 AS DECIMAL(18,6)),1)::DOUBLE AS r1 FROM (SELECT *, {SC.format(p='proba', a=A)} AS s0, {SC.format(p='p1', a='a1')} AS s1 FROM (SELECT *, {A}*(1+0.1::DOUBLE*{EVEN('amount')}) AS a1, least(greatest(proba+0.05::DOUBLE*{EVEN('proba')},0.0),1.0) AS p1 FROM t))) GROUP BY 1", key="")

# --- What follows learned models, on given values: the same steps in SQL.
WS = {A: 0.002, "hour": -0.03, "is_night": 0.4, "log_amount": 0.1, "is_weekend": -0.2, "month_approx": 0.5}
PARTS = [f.amount_features, f.time_features, lambda t: m.contributions(t, WS)]
LONG = "lw AS (" + " UNION ALL ".join(f"SELECT TransactionID, '{c}' AS name, (x-avg(x) OVER ())*{w}::DOUBLE AS v FROM (SELECT TransactionID, CAST({e} AS DOUBLE) AS x FROM t)" for (c, w), e in zip(WS.items(), (A, HOUR, f"{HOUR} BETWEEN 0 AND 6", f"ln(1+{A})", f"(CAST(floor({DT}/86400) AS BIGINT)%7)>=5", f"floor({DT}/2592000)"))) + "), ex AS (SELECT TransactionID, string_agg(CASE WHEN r<=5 THEN name||' '||CASE WHEN v>0 THEN 'increases' ELSE 'decreases' END||' fraud risk (SHAP='||printf('%.3f', round(v,3))||')' END, ' | ' ORDER BY r) AS reasons, max(v) FILTER (r=1) AS largest, avg(abs(v)) AS spread FROM (SELECT *, row_number() OVER (PARTITION BY TransactionID ORDER BY abs(v) DESC, name DESC) AS r FROM lw) GROUP BY 1)"
op("linear_contributions_given", [*PARTS, m.explained, lambda t: t.withColumn("n_reasons", F.size(F.split("reasons", r" \| ")))], "largest:6 spread:6 n_reasons:i", f"WITH {LONG} SELECT *, 5 AS n_reasons FROM ex")
op("mean_contributions_given", [*PARTS, m.mean_contributions], "feature mean_size:6", f"WITH {LONG} SELECT name AS feature, avg(abs(v)) AS mean_size FROM lw GROUP BY 1", key="")
op("most_explained_given", [*PARTS, m.most_explained], "reasons largest:6 spread:6", f"WITH {LONG} SELECT * FROM ex ORDER BY round(spread,9) DESC, TransactionID LIMIT 3")
op("isolation_normaliser_given", [lambda t: t.withColumn("raw", F.expr(f"1/(1+{A}/100)")), m.spread_out], "iso_score:6", f"SELECT TransactionID, (r-min(r) OVER ())/(max(r) OVER ()-min(r) OVER ()+1e-8) AS iso_score FROM (SELECT TransactionID, 1/(1+{A}/100) AS r FROM t)")
op("anomaly_scores_given", [lambda t: t.withColumn("error", F.expr(f"{A}*(1+proba)")), m.anomaly_scores], "error:6 threshold:6 score:6 is_anomaly:i", f"SELECT *, least(1.0, error/greatest(top,3*threshold)) AS score, CAST(error>threshold AS INT) AS is_anomaly FROM (SELECT TransactionID, {A}*(1+proba) AS error FROM t), (SELECT quantile_cont({A}*(1+proba),0.95) FILTER (isFraud=0) AS threshold, quantile_cont({A}*(1+proba),0.999) AS top FROM t)")
op("avg_importance_given", [lambda t: t.where("DeviceInfo IS NOT NULL").groupBy(F.col("ProductCD").alias("model"), F.col("card5").alias("fold"), F.col("DeviceInfo").alias("feature")).agg(F.sum(A).alias("importance")), lambda t: m.avg_importance(t, 20)], "feature importance:6", f"SELECT feature, avg(importance/total) AS importance FROM (SELECT *, sum(importance) OVER (PARTITION BY model, fold) AS total FROM (SELECT ProductCD AS model, card5 AS fold, DeviceInfo AS feature, sum({A}) AS importance FROM t WHERE DeviceInfo IS NOT NULL GROUP BY ALL)) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", key="")
op("brier_given", [lambda t: t.withColumns({"label": F.col("isFraud").cast("double"), "calibrated": F.expr("proba*proba")}), m.brier], "brier_before:9 brier_after:9", "SELECT avg((proba-isFraud)*(proba-isFraud)) AS brier_before, avg((proba*proba-isFraud)*(proba*proba-isFraud)) AS brier_after FROM t", key="")
op("bridge_flag_given", [lambda t: g.degree_centrality(t).select("card1", F.col("centrality").alias("betweenness")), g.bridge_flags], "card1:i betweenness:9 is_bridge:i", graph("SELECT *, CAST(betweenness>quantile_cont(betweenness,0.95) OVER () AS INT) AS is_bridge FROM (SELECT c.card1, coalesce(n,0)/((SELECT count(DISTINCT card1) FROM o)-1) AS betweenness FROM (SELECT DISTINCT card1 FROM o) c LEFT JOIN (SELECT src, count(*) AS n FROM w GROUP BY src) d ON c.card1=d.src)"), view=txn_ord, key="")

# --- Streams over several deliveries, with late and replayed rows; the watermark stands 5 days behind.
OWN = "CAST(floor((epoch(ts)-1704067200)/864000) AS INT)"
DV = f"dv AS (SELECT *, {OWN}+CAST(event_id%50=7 AS INT) AS due FROM events UNION ALL SELECT *, {OWN}+1 FROM events WHERE event_id%20=3), wm AS (SELECT k, (SELECT max(epoch(ts)) FROM dv WHERE due<k)-432000 AS w FROM range(1000) r(k) WHERE k<=(SELECT max(due)+1 FROM dv)), late AS (SELECT dv.*, w, coalesce(epoch(ts)<=w,false) AS is_late FROM dv JOIN wm ON k=due), fin AS (SELECT max(epoch(ts))-432000 AS w FROM dv)"
ONCE = "once AS (SELECT event_id, any_value(user_id) AS user_id, any_value(event_type) AS event_type, any_value(ts) AS ts, any_value(value) AS value FROM late WHERE NOT is_late GROUP BY event_id)"
FIVE = "5 days"


def batches(name: str, build, sql: str, mode: str = "append", show=lambda t: t) -> None:
    REGISTERED[name] = (lambda s, p: show(arrivals.delivered(arrivals.deliveries(s, p), build, mode)[0]), sql)


batches("stream_running_totals_batches", streams.running_totals, f"WITH {DV} SELECT event_type, count(*) AS n, round(sum(value),4) AS total FROM dv GROUP BY 1", "complete")
batches("stream_velocity_bins_batches", lambda e: streams.velocity_bins(e, "24 hours", FIVE), f"WITH {DV}, b AS (SELECT *, CAST(floor(epoch(ts)/86400)*86400 AS BIGINT) AS start FROM late) SELECT start, user_id, count(*) AS n, round(sum(value),4) AS total FROM b WHERE NOT coalesce(start+86400<=w,false) AND start+86400<=(SELECT w FROM fin) GROUP BY 1, 2", show=lambda t: t.select(F.unix_seconds("w.start").alias("start"), "user_id", "n", F.round("total", 4).alias("total")))
batches("stream_burst_sessions_batches", lambda e: streams.burst_sessions(e, "5 minutes", FIVE), f"WITH {DV}, g AS (SELECT *, CAST(coalesce(ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)>=INTERVAL 5 MINUTE, true) AS INT) AS new FROM late WHERE NOT coalesce(epoch(ts)+300<=w,false)) SELECT user_id, CAST(floor(min(epoch(ts))) AS BIGINT) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g) GROUP BY user_id, k HAVING max(epoch(ts))+300<=(SELECT w FROM fin)", show=lambda t: t.select("user_id", F.unix_seconds("session.start").alias("start"), "n"))
batches("stream_dedup_batches", lambda e: streams.deduplicated(e, FIVE).select("event_id", "user_id", "event_type"), f"WITH {DV}, {ONCE} SELECT event_id, user_id, event_type FROM once")
batches("stream_lag_batches", arrivals.lag_in_order, f"WITH {DV}, {ONCE} SELECT user_id, event_id, round(gap,3) AS gap, CAST(gap<300 AS BIGINT) AS is_rapid_fire, round(delta,4) AS delta FROM (SELECT *, coalesce((epoch_us(ts)-lag(epoch_us(ts)) OVER w)/1e6, 999999.0) AS gap, coalesce(value-lag(value) OVER w, 0.0) AS delta FROM once WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE epoch(ts)<(SELECT w FROM fin)", show=lambda t: t.select("user_id", "event_id", F.round("gap", 3).alias("gap"), F.col("is_rapid_fire").cast("long").alias("is_rapid_fire"), F.round("delta", 4).alias("delta")))


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows the deduplicating stream dropped as too late, over all its deliveries: one number of the stream's progress."""
    dropped = arrivals.delivered(arrivals.deliveries(spark, sf_dir), lambda e: streams.deduplicated(e, FIVE))[1]
    return spark.createDataFrame([(dropped,)], "dropped long")


REGISTERED["stream_late_rows"] = (late_rows, f"WITH {DV} SELECT count(*) AS dropped FROM late WHERE is_late")

# --- Hand-off: fitted on the even ids, the odd ones arrive as a stream.
FIT, NEW = "TransactionID % 2 = 0", "TransactionID % 2 = 1"


def handed_over(with_model: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Scores of the odd ids, as they arrive, by what the even ids fitted."""
        path = store.new_path(spark, "fitted")
        handoff.fit(txn_ev(spark, sf_dir).where(FIT), path, with_model)
        fitted = handoff.load(spark, path, with_model)
        arriving = _view(spark, sf_dir, _EV, events=streams.event_stream(spark, sf_dir, False)).where(NEW)
        got = streams.drained(handoff.scored(arriving, fitted), "append")
        return got.select(ID, F.round("proba", 6).alias("proba"), F.round("risk_score", 4).alias("risk_score"), "risk_category")

    return run


HAND = f"""WITH fi AS (SELECT * FROM t WHERE {FIT}), ca AS (SELECT card1, avg({A}) AS m, coalesce(stddev_samp({A}),1.0) AS s, count(*) AS n, count(DISTINCT ProductCD) AS k FROM fi GROUP BY 1),
 us AS (SELECT card1, DeviceInfo AS d FROM (SELECT card1, DeviceInfo, row_number() OVER (PARTITION BY card1 ORDER BY count(*) DESC, DeviceInfo) AS r FROM fi WHERE DeviceInfo IS NOT NULL GROUP BY 1, 2) WHERE r=1), pr AS (SELECT ProductCD, avg(isFraud) AS p FROM fi GROUP BY 1), de AS (SELECT DeviceInfo, count(DISTINCT card1) AS dc FROM fi WHERE DeviceInfo IS NOT NULL GROUP BY 1),
 ra AS (SELECT *, 30*proba+8*un+6*CAST(dc>2 AS INT)+4*CAST(n<5 AS INT)+7*CAST(n=1 AND {A}>500 AS INT)+4*su+3*p+3*su*un+2*CAST(k<=2 AND p>0.05 AS INT)+CAST({HOUR} BETWEEN 0 AND 6 AS INT)*least(greatest(CASE WHEN n>0 THEN ({A}-m)/greatest(s,1.0) ELSE 0.0 END,0.0),5.0)*2 AS raw
  FROM (SELECT t.*, coalesce(m,0.0) AS m, coalesce(s,1.0) AS s, coalesce(n,0) AS n, coalesce(k,0) AS k, coalesce(p,(SELECT avg(isFraud) FROM fi)) AS p, coalesce(dc,0) AS dc, CASE WHEN t.DeviceInfo<>d THEN 1 ELSE 0 END AS un, CAST({A}=floor({A}) AND {A}>=500 AS INT) AS su FROM t LEFT JOIN ca USING (card1) LEFT JOIN us USING (card1) LEFT JOIN pr USING (ProductCD) LEFT JOIN de USING (DeviceInfo)))
 SELECT TransactionID, round(proba,6) AS proba, round(risk_score,4) AS risk_score, {TIER} AS risk_category FROM (SELECT *, least(greatest(raw/(SELECT max(raw) FROM ra WHERE {FIT})*100,0.0),100.0) AS risk_score FROM ra WHERE {NEW})"""  # fmt: skip
REGISTERED["stream_risk_score"] = (handed_over(False), duckdb_views() + ", " + HAND.removeprefix("WITH "))
REGISTERED["stream_model_score"] = (handed_over(True), None)

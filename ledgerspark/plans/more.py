"""Queries of scores, reports, preparation, samples and streams, with their SQL; adds them to the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decide as d
from ..operators import features as f
from ..operators import models as m
from ..operators import network as g
from ..operators import prepare as pre
from ..operators import reports as rep
from ..sources import store
from ..sources.views import _EV, _view, duckdb_views, txn_ev, txn_ord
from ..streaming import streams
from .registry import DT, EDGES, HOUR, ID, PREPARED, REGISTERED, SEQ, USUAL, A, lk, op

FREE = ", ".join(f"'{x}'" for x in f.FREE_MAIL)
BIG = f"CAST({A}>500 AS INT)"
#: Every column that scores, reasons and interactions use, from the rows t.
FEAT = f"""SELECT t.*, ln(1+{A}) AS log_amount, {HOUR} AS hour, CAST({HOUR} BETWEEN 0 AND 6 AS INT) AS is_night, CAST((CAST(floor({DT}/86400) AS BIGINT)%7)>=5 AS INT) AS is_weekend,
 m AS user_avg_amt, ({A}-m)/greatest(coalesce(s,1.0),1.0) AS amount_zscore, {A}/greatest(m,0.01) AS amount_to_mean_ratio, CAST(n<5 AS INT) AS is_low_activity_user, CAST(n=1 AND {A}>500 AS INT) AS first_txn_high_value, CAST(n=1 AS INT) AS is_new_account,
 CAST({A}=floor({A}) AND {A}>=500 AS INT) AS is_suspicious_round, p AS product_fraud_rate, CAST(k<=2 AND p>0.05 AS INT) AS category_mismatch_risk, CASE WHEN DeviceInfo<>d THEN 1 ELSE 0 END AS is_unusual_device, CASE WHEN dc>2 THEN 1 ELSE 0 END AS is_shared_device,
 coalesce(ua,1) AS users_per_address, coalesce(fy,0) AS has_fraud_neighbor, CASE WHEN P_emaildomain IN ({FREE}) THEN 1 ELSE 0 END AS is_free_email, CAST(coalesce({DT}-lag({DT}) OVER (PARTITION BY card1 {SEQ}),999999)<300 AS INT) AS is_rapid_fire,
 {A}/greatest(avg({A}) OVER (PARTITION BY card1, CAST(floor({DT}/2592000) AS BIGINT)),0.01) AS amt_vs_seasonal, count(*) OVER (PARTITION BY card1 ORDER BY {DT} RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS txns_24h
 FROM t LEFT JOIN {lk('card1', f'avg({A}) AS m, stddev_samp({A}) AS s, count(*) AS n, count(DISTINCT ProductCD) AS k')} USING (card1) LEFT JOIN {lk('ProductCD', 'avg(isFraud) AS p')} USING (ProductCD)
 LEFT JOIN {USUAL} USING (card1) LEFT JOIN {lk('DeviceInfo', 'count(DISTINCT card1) AS dc')} USING (DeviceInfo) LEFT JOIN {lk('addr1', 'count(DISTINCT card1) AS ua, max(isFraud) AS fy')} USING (addr1)"""
#: The products of columns that FEAT has.
PRODUCTS = f"log_amount*is_night AS amount_x_night, log_amount*is_weekend AS amount_x_weekend, is_suspicious_round*is_night AS round_x_night, is_suspicious_round*is_unusual_device AS round_x_new_device, is_night*is_unusual_device AS night_x_unusual_device, is_low_activity_user*is_night AS dormant_x_night, first_txn_high_value*is_suspicious_round AS new_acct_x_round, is_rapid_fire*is_night AS rapid_fire_x_night, is_rapid_fire*{BIG} AS rapid_fire_x_high_amt, is_rapid_fire*is_unusual_device AS velocity_x_new_device, is_free_email*{BIG} AS free_email_x_high_amt, has_fraud_neighbor*is_night AS fraud_neighbor_x_night, is_shared_device*CAST(users_per_address>5 AS INT) AS shared_device_x_network"
WEIGHED = "+".join(f"{w}*coalesce({c},0)" for c, w in d.WEIGHTS.items() if not c.startswith(("graph_", "iso_")) and c != "round_x_new_device") + "+3*is_suspicious_round*is_unusual_device+is_night*least(greatest(amount_zscore,0.0),5.0)*2"
TIER = "CASE WHEN risk_score>=71 THEN 'RED' WHEN risk_score>=51 THEN 'ORANGE' WHEN risk_score>=31 THEN 'YELLOW' ELSE 'GREEN' END"
RULES = [
    ("amount_zscore>3", "'Amount is '||printf('%.1f', round(amount_to_mean_ratio,1))||'x above user average'"), ("is_night=1", "'Transaction at unusual hour ('||hour||':00)'"),
    ("is_unusual_device=1", "'New/unusual device detected - possible SIM swap or account takeover'"), ("is_shared_device=1", "'Device shared across multiple identities - possible mule network'"),
    ("first_txn_high_value=1", "'Brand-new account with unusually high first transaction'"), ("is_suspicious_round=1", "'Perfectly round high-value amount (common fraud pattern)'"),
    (f"is_low_activity_user=1 AND {A}>2*user_avg_amt", "'Dormant account suddenly active with high-value transaction'"), ("product_fraud_rate>0.05", "'High-risk merchant category (fraud rate: '||printf('%.1f', round(product_fraud_rate*100,1))||'%)'"),
    ("category_mismatch_risk=1", "'Transaction in unusual merchant category for this user'"), ("is_rapid_fire=1", "'Rapid-fire transactions detected (< 5 min apart)'"),
    ("amt_vs_seasonal>3", "'Amount is '||printf('%.1f', round(amt_vs_seasonal,1))||'x above seasonal baseline for this user'"),
]
WHY = "coalesce(nullif(concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in RULES) + "),''),'No specific risk factors identified')"
AUTHS = "CASE risk_category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in d.AUTH.items()) + " END"
RISK = f"SELECT *, {AUTHS} AS auth_recommendation FROM (SELECT *, {TIER} AS risk_category, {WHY} AS explanation FROM (SELECT *, least(greatest(raw/CASE WHEN max(raw) OVER ()>0 THEN max(raw) OVER () ELSE 1.0 END*100,0.0),100.0) AS risk_score FROM (SELECT *, {WEIGHED} AS raw FROM ({FEAT}))))"
op("risk_score", [f.all_features, d.scored], "risk_score:4 risk_category auth_recommendation explanation", RISK)
op("sink_scored", [f.all_features, d.scored, lambda t: store.sink_scored(t, store.new_path(t.sparkSession, "scored"))], "risk_score:4 risk_category", RISK)
op("tier_distribution", [f.all_features, d.scored, d.tier_distribution], "risk_category n:i pct:6", f"SELECT risk_category, count(*) AS n, 100.0*count(*)/(SELECT count(*) FROM t) AS pct FROM ({RISK}) GROUP BY 1", key="")


def full_scores(df: DataFrame) -> DataFrame:
    """Scores with every term: graph columns and the isolation score joined in from written tables."""
    cards = store.written(g.with_graph(df).groupBy("card1").agg(*(F.max(c).alias(c) for c in ("graph_community_fraud_rate", "graph_fraud_neighbor_ratio", "graph_is_bridge", "graph_betweenness"))), "graph-terms")
    lone = df
    for s in PREPARED:
        lone = s(lone)
    iso = store.written(m.isolation_forest(lone).select(ID, "iso_score"), "iso-terms")
    return d.scored(f.interactions(f.all_features(df).join(cards, "card1", "left").join(iso, ID, "left")))


#: Given values in place of sampled betweenness, from the degree, so that SQL can follow every graph term.
GIVEN = {"graph_betweenness": "CAST(graph_degree AS DOUBLE)/5000", "graph_is_bridge": "CAST(graph_degree >= 4 AS INT)"}
PROBA = "CAST(TransactionID % 97 AS DOUBLE)/97"


def graph_terms(df: DataFrame) -> DataFrame:
    """card1 and its graph columns, written: community and neighbour rates from the edges, betweenness as GIVEN."""
    rates = store.written(g.community_stats(df).select("card1", F.col("fraud_rate").alias("graph_community_fraud_rate")), "rates")
    near = g.fraud_neighbors(df).select("card1", F.col("fraud_neighbor_ratio").alias("graph_fraud_neighbor_ratio"))
    degree = g.degree_centrality(df).select("card1", F.col("degree").alias("graph_degree"))
    return store.written(rates.join(near, "card1", "left").join(degree, "card1", "left").fillna(0).withColumns({c: F.expr(e) for c, e in GIVEN.items()}), "graph-terms")


def graph_features(df: DataFrame) -> DataFrame:
    """Every feature with the graph's terms; products are made last."""
    cards = graph_terms(df)
    return f.interactions(f.all_features(df.withColumn("proba", F.expr(PROBA))).join(cards, "card1", "left"))


def crossed_features(df: DataFrame) -> DataFrame:
    """df's rows with every feature and all 17 products, those of the graph from the rows' own cards; rows without a card get 0."""
    cards = graph_terms(store.written(df.select("card1", "isFraud", *(r[0] for r in g.RELATIONS)), "links"))
    return f.interactions(f.all_features(df).join(cards, "card1", "left").fillna(0, list(f.GRAPH)))


GWEIGHED = WEIGHED + "".join(f"+{w}*coalesce({c},0)" for c, w in d.WEIGHTS.items() if c.startswith("graph_"))
GRULES = RULES + [
    ("graph_community_fraud_rate>0.3", "'User belongs to high-fraud network community ('||printf('%.0f', round(graph_community_fraud_rate*100))||'% fraud rate)'"),
    ("graph_fraud_neighbor_ratio>0.3", "'Connected to known fraudsters ('||printf('%.0f', round(graph_fraud_neighbor_ratio*100))||'% of connections)'"),
    ("graph_is_bridge=1", "'Network bridge node - potential money mule connecting fraud rings'"),
]
GWHY = "coalesce(nullif(concat_ws(' | ', " + ", ".join(f"CASE WHEN {c} THEN {t} END" for c, t in GRULES) + "),''),'No specific risk factors identified')"


#: A card's graph columns from the orders.
TERMS = "gr AS (SELECT cm.card1, fraud_rate AS graph_community_fraud_rate, coalesce(z,0.0) AS graph_fraud_neighbor_ratio, coalesce(n,0) AS graph_degree FROM cm JOIN st USING (community) LEFT JOIN (SELECT src AS card1, count(*) AS n, avg(bad) AS z FROM w JOIN (SELECT card1, max(isFraud) AS bad FROM o GROUP BY card1) b ON w.dst=b.card1 GROUP BY src) USING (card1))"
GIVEN_SQL = ", ".join(f"{e} AS {c}" for c, e in GIVEN.items())


def with_graph_sql(query: str) -> str:
    """query over gf: the orders' features with their graph columns."""
    return f"{COMM}, {TERMS}, t AS (SELECT *, {PROBA} AS proba FROM o), gf AS (SELECT * FROM ({FEAT}) JOIN (SELECT *, {GIVEN_SQL} FROM gr) USING (card1)) {query}"


def with_event_graph_sql(query: str) -> str:
    """query over gf: the events' features with the graph columns of their own cards, 0 for rows without a card."""
    zero = ", ".join(f"coalesce({c},0) AS {c}" for c in f.GRAPH)
    return f"{COMM}, {TERMS}".replace("FROM o ", "FROM t ") + f", gf AS (SELECT * REPLACE ({zero}) FROM ({FEAT}) LEFT JOIN (SELECT *, {GIVEN_SQL} FROM gr) USING (card1)) {query}"


op("risk_score_full", [full_scores], "risk_score:4 risk_category auth_recommendation explanation", None)
op("explanation_sampling", [f.all_features, d.risk_score, lambda t: t.withColumn("risk_category", d.tier()), lambda t: rep.explained_sample(t, 50)], "explanation",
   f"SELECT TransactionID, CASE WHEN r<=50 THEN explanation ELSE 'Risk Score: '||printf('%.0f', round(risk_score))||' | Category: '||risk_category END AS explanation FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(TransactionID AS VARCHAR)), TransactionID) AS r FROM ({RISK}))")
POINT = f"SELECT *, {TIER} AS risk_category FROM (SELECT *, {HOUR} AS hour, least(100.0, 70*proba+CASE WHEN {HOUR}<=6 OR {HOUR}>=23 THEN 10 ELSE 0 END+CASE WHEN {A}=floor({A}) AND {A}>=500 AND {HOUR}<=6 THEN 10 ELSE 0 END+CASE WHEN {A}>1000 THEN 10 ELSE 0 END) AS risk_score FROM t)"
POINT1 = f"SELECT * REPLACE (round(CAST(risk_score AS DECIMAL(18,6)),1)::DOUBLE AS risk_score) FROM ({POINT})"
SCORED = [f.time_features, d.point_score]
op("flagged_sample", [*SCORED, rep.flagged_sample], "risk_score:1 risk_category", f"SELECT * FROM ({POINT1}) WHERE risk_category IN ('RED','ORANGE') ORDER BY TransactionID LIMIT 50")
op("random_sample", [lambda t: rep.random_sample(t, 500)], f"{A}:4", "SELECT * FROM t ORDER BY md5(CAST(TransactionID AS VARCHAR)), TransactionID LIMIT 500")
PMAP = "CASE ProductCD " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in rep.PRODUCT_RISK.items()) + " ELSE 0.035::DOUBLE END"
Z = f"({A}-user_avg_amt)/greatest(user_avg_amt*0.5,1.0)"
ROUND = f"{A}=floor({A}) AND {A}>=500"
CONTEXT = f"SELECT *, CASE WHEN context_score>=71 THEN 'BLOCK' WHEN context_score>=51 THEN 'BIOMETRIC' WHEN context_score>=31 THEN 'PIN VERIFY' ELSE 'APPROVE' END AS context_tier FROM (SELECT *, least(greatest(least({Z},5.0)*8+12*is_night+15*is_unusual_device+12*is_shared_device+18*is_new_account+CASE WHEN {ROUND} THEN 8 ELSE 0 END+{PMAP}*100+least(txns_24h/10,1.0)*15+CASE WHEN {A}>1000 THEN 6 ELSE 0 END,0.0),100.0) AS context_score, coalesce(nullif(concat_ws(',', CASE WHEN {Z}>2 THEN 'AMT' END, CASE WHEN is_night=1 THEN 'HOUR' END, CASE WHEN is_unusual_device=1 THEN 'DEV' END, CASE WHEN is_shared_device=1 THEN 'SHR' END, CASE WHEN is_new_account=1 THEN 'NEW' END, CASE WHEN {ROUND} THEN 'RND' END, CASE WHEN {PMAP}>0.05 THEN 'CAT' END, CASE WHEN txns_24h>10 THEN 'VEL' END),''),'OK') AS context_reasons FROM ({FEAT}))"
op("context_score", [f.all_features, lambda t: f.trailing_velocity(t).withColumnRenamed("trailing_24h", "txns_24h"), rep.context_score], "context_score:4 context_tier context_reasons", CONTEXT)
op("tier_variants", [lambda t: t.withColumns({"s": 100 * F.col("proba")}), lambda t: t.withColumns({"feed": d.tier("s", (75, 55, 35), False), "mobile": d.tier("s", (85, 65, 40), False), "dashboard": d.tier("s", (70, 50, 30), False)})], "feed mobile dashboard",
   "SELECT TransactionID, " + ", ".join(f"CASE WHEN 100*proba>{a} THEN 'RED' WHEN 100*proba>{b} THEN 'ORANGE' WHEN 100*proba>{c} THEN 'YELLOW' ELSE 'GREEN' END AS {n}" for n, a, b, c in (("feed", 75, 55, 35), ("mobile", 85, 65, 40), ("dashboard", 70, 50, 30))) + " FROM t")
op("histogram", [lambda t: rep.histogram(t, A, 50)], "bin:i isFraud:i n:i density:9", f"SELECT b AS bin, isFraud, count(*) AS n, count(*)/(SELECT count(*) FROM t u WHERE u.isFraud=x.isFraud)/any_value(w) AS density FROM (SELECT *, least(floor(({A}-mn)/w),49) AS b FROM (SELECT t.*, mn, (mx-mn)/50 AS w FROM t, (SELECT min({A}) AS mn, max({A}) AS mx FROM t))) x GROUP BY b, isFraud", key="")
op("score_stats", [*SCORED, rep.score_stats], "mean:6 median:6 std:6 high_pct:6 low_pct:6 n:i", f"SELECT avg(risk_score) AS mean, median(risk_score) AS median, stddev_pop(risk_score) AS std, 100*avg(CAST(risk_score>70 AS INT)) AS high_pct, 100*avg(CAST(risk_score<=30 AS INT)) AS low_pct, count(*) AS n FROM ({POINT1})", key="")
BAND = "+".join(f"CAST({A}>={b} AS INT)" for b in rep.BANDS[1:])
HEAT = f"SELECT g.band, g.hour, coalesce(r,0.0) AS risk FROM (SELECT x.band, y.hour FROM (SELECT unnest(range(7)) AS band) x, (SELECT unnest(range(24)) AS hour) y) g LEFT JOIN (SELECT {BAND} AS band, hour, avg(risk_score) AS r FROM ({POINT1}) GROUP BY 1, 2) c ON g.band=c.band AND g.hour=c.hour"
op("risk_heatmap", [*SCORED, rep.risk_heatmap], "band:i hour:i risk:6 hottest:i coldest:i", f"SELECT *, CAST(row_number() OVER (ORDER BY round(risk,9) DESC, band, hour)=1 AS INT) AS hottest, CAST(row_number() OVER (ORDER BY round(risk,9), band, hour)=1 AS INT) AS coldest FROM ({HEAT})", key="")
op("network_bands", [*SCORED, rep.network_bands], "low:i medium:i high:i", f"SELECT count(*) FILTER (risk_score<=40) AS low, count(*) FILTER (risk_score>40 AND risk_score<=70) AS medium, count(*) FILTER (risk_score>70) AS high FROM ({POINT1})", key="")
#: A second score beside proba, for queries that compare scores.
SECOND = "CAST(round((card5*13 + hour*7 + 60*isFraud) % 200, 0) AS DOUBLE)/200"
TWO = [f.time_features, lambda t: t.withColumn("other", F.expr(SECOND))]
AUC_OF = "(SELECT sum(CASE WHEN a.s>b.s THEN a.n*b.n WHEN a.s=b.s THEN a.n*b.n/2.0 ELSE 0 END)/sum(a.n*b.n) FROM (SELECT round({c},12) AS s, count(*) AS n FROM {v} WHERE isFraud=1 GROUP BY 1) a, (SELECT round({c},12) AS s, count(*) AS n FROM {v} WHERE isFraud=0 GROUP BY 1) b)"
T2 = f"t2 AS (SELECT *, {SECOND} AS other FROM (SELECT *, {HOUR} AS hour FROM t))"
RNK = "(rank() OVER (ORDER BY {c})+(count(*) OVER (PARTITION BY {c})-1)/2.0)/(SELECT count(*) FROM t)"
W1, W2 = (f"power({AUC_OF.format(c=c, v='t2')},3)" for c in ("proba", "other"))
BLEND = f"bl AS (SELECT *, (a*r1+b*r2)/(a+b) AS blend FROM (SELECT *, {RNK.format(c='proba')} AS r1, {RNK.format(c='other')} AS r2 FROM t2), (SELECT {W1} AS a, {W2} AS b))"
op("rank_weighted_blend", [*TWO, lambda t: rep.rank_weighted_blend(t, ("proba", "other"))], "blend:6", f"WITH {T2}, {BLEND} SELECT * FROM bl")
op("better_of_blend_and_stack", [*TWO, lambda t: rep.rank_weighted_blend(t, ("proba", "other")).withColumn("blend", F.round("blend", 12)), lambda t: rep.better_of(t, "proba", "blend")], "auc_proba:6 auc_blend:6 winner", f"WITH {T2}, {BLEND} SELECT x AS auc_proba, y AS auc_blend, CASE WHEN y>x THEN 'blend' ELSE 'proba' END AS winner FROM (SELECT {AUC_OF.format(c='proba', v='bl')} AS x, {AUC_OF.format(c='blend', v='bl')} AS y)", key="")
op("best_f1_threshold", [rep.best_f1_threshold], "threshold:6 f1:6", "SELECT CASE WHEN f1>0 THEN c ELSE 0.5 END AS threshold, f1 FROM (SELECT i, c, coalesce(2.0*sum(CAST(proba>c AS INT)*isFraud)/nullif(sum(isFraud)+sum(CAST(proba>c AS INT)),0),0.0) AS f1 FROM t, (SELECT r AS i, CAST(30+r AS DOUBLE)/100 AS c FROM range(40) s(r)) GROUP BY i, c) ORDER BY f1 DESC, i LIMIT 1", key="")
LEAD = "UNION ALL".join(f" SELECT '{c}' AS model, {AUC_OF.format(c=c, v='t2')} AS auc, (SELECT 1000*avg(CAST({c}>0.5 AS INT)) FROM t2 WHERE isFraud=0) AS fp_per_1000, (SELECT 1-avg(CAST({c}>0.5 AS INT)) FROM t2 WHERE isFraud=0) AS specificity " for c in ("proba", "other"))
op("model_leaderboard", [*TWO, lambda t: rep.model_leaderboard(t, ("proba", "other"))], "model auc:6 fp_per_1000:6 specificity:6 is_best:i", f"WITH {T2} SELECT *, CAST(row_number() OVER (ORDER BY round(auc,9) DESC, model)=1 AS INT) AS is_best FROM ({LEAD})", key="")
PSI = f"WITH p AS (SELECT *, CAST(floor({DT}/604800) AS BIGINT) AS period FROM t), e AS (SELECT min({A}) AS mn, (max({A})-min({A}))/10 AS w FROM p WHERE period=(SELECT min(period) FROM p)), s AS (SELECT period, bin, greatest(coalesce(n,0)/t,1e-4) AS share FROM (SELECT period, count(*) AS t FROM p GROUP BY 1), (SELECT unnest(range(10)) AS bin) LEFT JOIN (SELECT period AS p2, CAST(least(greatest(floor(({A}-mn)/w),0),9) AS BIGINT) AS b2, count(*) AS n FROM p, e GROUP BY 1, 2) ON p2=period AND b2=bin), x AS (SELECT period, sum((share-base)*ln(share/base)) AS psi FROM s JOIN (SELECT bin, share AS base FROM s WHERE period=(SELECT min(period) FROM s)) USING (bin) GROUP BY 1), a AS (SELECT a.period, sum(CASE WHEN a.proba>b.proba THEN a.n*b.n WHEN a.proba=b.proba THEN a.n*b.n/2.0 ELSE 0 END)/sum(a.n*b.n) AS auc FROM (SELECT period, proba, count(*) AS n FROM p WHERE isFraud=1 GROUP BY 1, 2) a JOIN (SELECT period, proba, count(*) AS n FROM p WHERE isFraud=0 GROUP BY 1, 2) b USING (period) GROUP BY 1)"
op("drift_monitor", [rep.drift_monitor], "period:i auc:6 status psi:6", f"{PSI} SELECT period, auc, CASE WHEN auc IS NULL THEN 'unknown' WHEN auc<0.95 THEN 'critical' WHEN auc<0.97 THEN 'warning' ELSE 'ok' END AS status, psi FROM x LEFT JOIN a USING (period)", key="")

COMM = f"WITH RECURSIVE {EDGES}, reach(card1, lab) AS (SELECT DISTINCT card1, card1 FROM o UNION SELECT w.dst, reach.lab FROM reach JOIN w ON reach.card1=w.src WHERE reach.lab<w.dst), cm AS (SELECT card1, min(lab) AS community FROM reach GROUP BY 1), st AS (SELECT community, count(*) AS size, avg(bad) AS fraud_rate FROM cm JOIN (SELECT card1, max(isFraud) AS bad FROM o GROUP BY 1) USING (card1) GROUP BY 1)"
op("communities", [g.communities], "card1:i community:i", f"{COMM} SELECT * FROM cm", view=txn_ord, key="")
op("community_stats", [g.community_stats], "card1:i community:i size:i fraud_rate:6", f"{COMM} SELECT card1, community, size, fraud_rate FROM cm JOIN st USING (community)", view=txn_ord, key="")
op("community_modularity", [g.community_modularity], "communities:i modularity:9", f"{COMM}, kk AS (SELECT src AS card1, count(*) AS k FROM w GROUP BY 1), ins AS (SELECT a.community, count(*) AS n FROM w JOIN cm a ON a.card1=w.src JOIN cm b ON b.card1=w.dst WHERE a.community=b.community GROUP BY 1), tt AS (SELECT community, sum(k) AS k FROM kk JOIN cm USING (card1) GROUP BY 1) SELECT (SELECT count(DISTINCT community) FROM cm) AS communities, (SELECT sum(coalesce(n,0)/m-(k/m)*(k/m)) FROM tt LEFT JOIN ins USING (community), (SELECT CAST(count(*) AS DOUBLE) AS m FROM w)) AS modularity", view=txn_ord, key="")
op("modular_communities", [g.modular_communities], "card1:i community:i", None, view=txn_ord, key="")
op("modular_community_stats", [lambda t: g.community_stats(t, g.modular_communities)], "card1:i community:i size:i fraud_rate:6", None, view=txn_ord, key="")
op("risk_score_graph", [graph_features, d.scored], "risk_score:4 risk_category auth_recommendation explanation", with_graph_sql(f"SELECT *, {AUTHS} AS auth_recommendation FROM (SELECT *, {TIER} AS risk_category, {GWHY} AS explanation FROM (SELECT *, least(greatest(raw/CASE WHEN max(raw) OVER ()>0 THEN max(raw) OVER () ELSE 1.0 END*100,0.0),100.0) AS risk_score FROM (SELECT *, {GWEIGHED} AS raw FROM gf)))"), view=txn_ord)
op("graph_interactions", [graph_features], "graph_fraud_comm_x_night:6 graph_fraud_comm_x_high_amt:6 graph_bridge_x_unusual_device:i graph_fraud_neighbor_x_round:6 fraud_neighbor_x_night:i shared_device_x_network:i",
   with_graph_sql(f"SELECT *, graph_community_fraud_rate*is_night AS graph_fraud_comm_x_night, graph_community_fraud_rate*{BIG} AS graph_fraud_comm_x_high_amt, graph_is_bridge*is_unusual_device AS graph_bridge_x_unusual_device, graph_fraud_neighbor_ratio*is_suspicious_round AS graph_fraud_neighbor_x_round, has_fraud_neighbor*is_night AS fraud_neighbor_x_night, is_shared_device*CAST(users_per_address>5 AS INT) AS shared_device_x_network FROM gf"), view=txn_ord)
op("interaction_features", [crossed_features], "amount_x_night:6 amount_x_weekend:6 round_x_night:i round_x_new_device:i night_x_unusual_device:i dormant_x_night:i new_acct_x_round:i rapid_fire_x_night:i rapid_fire_x_high_amt:i velocity_x_new_device:i free_email_x_high_amt:i fraud_neighbor_x_night:i shared_device_x_network:i graph_fraud_comm_x_night:6 graph_fraud_comm_x_high_amt:6 graph_bridge_x_unusual_device:i graph_fraud_neighbor_x_round:6",
   with_event_graph_sql(f"SELECT *, {PRODUCTS}, graph_community_fraud_rate*is_night AS graph_fraud_comm_x_night, graph_community_fraud_rate*{BIG} AS graph_fraud_comm_x_high_amt, graph_is_bridge*is_unusual_device AS graph_bridge_x_unusual_device, graph_fraud_neighbor_ratio*is_suspicious_round AS graph_fraud_neighbor_x_round FROM gf"))
op("community_rate_per_card", [g.community_rates], "card1:i community_rate:6", f"{COMM} SELECT card1, fraud_rate AS community_rate FROM cm JOIN st USING (community) WHERE fraud_rate>0", view=txn_ord, key="")
op("sample_users_for_graph", [lambda t: g.chosen_cards(t, 400)], "card1:i", "WITH c AS (SELECT card1, max(isFraud) AS bad FROM o GROUP BY 1) SELECT card1 FROM c WHERE bad=1 UNION ALL SELECT card1 FROM (SELECT card1, row_number() OVER (ORDER BY md5(CAST(card1 AS VARCHAR)), card1) AS r FROM c WHERE bad=0) WHERE r<=greatest(400-(SELECT count(*) FROM c WHERE bad=1),0)", view=txn_ord, key="")
op("graph_user_set", [lambda t: t.select("card1").where("addr1 IS NOT NULL").intersect(t.select("card1").where("DeviceInfo IS NOT NULL")).subtract(t.where("isFraud = 1").select("card1"))], "card1:i", "(SELECT card1 FROM o WHERE addr1 IS NOT NULL INTERSECT SELECT card1 FROM o WHERE DeviceInfo IS NOT NULL) EXCEPT SELECT card1 FROM o WHERE isFraud=1", view=txn_ord, key="")
op("semi_flag_fraud_addr", [f.in_fraud_address], f"{A}:4", "SELECT * FROM o WHERE addr1 IN (SELECT addr1 FROM o WHERE isFraud=1 AND addr1 IS NOT NULL)", view=txn_ord)
op("anti_flag_fraud_addr", [lambda t: f.in_fraud_address(t, False)], f"{A}:4", "SELECT * FROM o WHERE addr1 IS NULL OR addr1 NOT IN (SELECT addr1 FROM o WHERE isFraud=1 AND addr1 IS NOT NULL)", view=txn_ord)

FREQ = ("card1", "card2", "addr1", "addr2", "P_emaildomain", "R_emaildomain", "DeviceInfo", "ProductCD")
op("frequency_encoding", [f.frequency_encoding], " ".join(f"{c}_freq:6 {c}_is_rare:i" for c in FREQ), "SELECT *, " + ", ".join(f"CAST({c}_freq<0.0001 AS INT) AS {c}_is_rare" for c in FREQ) + " FROM (SELECT *, " + ", ".join(f"CASE WHEN {c} IS NULL THEN 0.0 ELSE CAST(count(*) OVER (PARTITION BY {c}) AS DOUBLE)/(SELECT count({c}) FROM t) END AS {c}_freq" for c in FREQ) + " FROM t)")
ENC = ("card1", "card2", "addr1", "addr2", "P_emaildomain")
op("target_encoding", [f.target_encoding], " ".join(f"{c}_te:6" for c in ENC), "SELECT *, " + ", ".join(f"CASE WHEN {c} IS NULL THEN (SELECT avg(isFraud) FROM t) ELSE (sum(isFraud) OVER (PARTITION BY {c})+50*(SELECT avg(isFraud) FROM t))/(count(*) OVER (PARTITION BY {c})+50) END AS {c}_te" for c in ENC) + " FROM t")
#: Label statistics that leave the row's own fold out, and ones fitted on other rows: the same aggregates in SQL.
FOLD, IN_FIT = "TransactionID % 5", "TransactionID % 4 <> 0"
FOLDED = lambda t: t.withColumn("fold", F.expr(FOLD))
fitted_on = lambda t: t.where(IN_FIT)
FT = f"(SELECT *, (sum(isFraud) OVER ()-sum(isFraud) OVER (PARTITION BY fold))/(count(*) OVER ()-count(*) OVER (PARTITION BY fold)) AS g FROM (SELECT *, {FOLD} AS fold FROM t))"


def out_of_fold(keys: str, null_is_value: bool = False, weight: float | None = None, v: str = "") -> str:
    """SQL of a row's label statistic over the other folds' rows with its keys; weight: smoothed."""
    t, n = (f"({a} OVER (PARTITION BY {keys})-{a} OVER (PARTITION BY {keys}, fold))" for a in ("sum(isFraud)", "count(*)"))
    some = "" if null_is_value else f" WHEN {keys} IS NULL THEN g"
    return f"CASE{some} WHEN true THEN {f'({t}+{weight}*g)/({n}+{weight})' if weight else f'coalesce({t}/nullif({n},0),g)'} END"


def fitted_sql(keys: str, null_is_value: bool = False, weight: float | None = None) -> str:
    """SQL of the same over the rows IN_FIT."""
    same = " AND ".join(f"u.{k} IS NOT DISTINCT FROM t.{k}" if null_is_value else f"u.{k}=t.{k}" for k in keys.split(", "))
    t, n = (f"(SELECT {a} FROM t u WHERE {same} AND {IN_FIT.replace('T', 'u.T', 1)})" for a in ("coalesce(sum(isFraud),0)", "count(*)"))
    g = f"(SELECT avg(isFraud) FROM t WHERE {IN_FIT})"
    return f"({t}+{weight}*{g})/({n}+{weight})" if weight else f"coalesce({t}/nullif({n},0),{g})"


RATES = {
    "merchant_risk": (f.merchant_risk, {"product_fraud_rate": ("ProductCD", False, None), "addr_fraud_rate": ("addr1", False, None)}),
    "email_risk": (f.email_features, {"email_fraud_rate": ("P_emaildomain", False, None)}),
    "uid_fraud_history": (f.uid_fraud_history, {"uid_fraud_rate": ("card1, addr1", True, 50)}),
    "cross_fraud_rates": (f.cross_fraud_rates, {f"{a}_{b}_rate": (f"{a}, {b}", True, 30) for a, b in (("card1", "ProductCD"), ("card1", "addr1"), ("addr1", "P_emaildomain"), ("ProductCD", "P_emaildomain"))}),
    "target_encoding": (f.target_encoding, {f"{c}_te": (c, False, 50) for c in ENC}),
}
for name, (run, rates) in RATES.items():
    op(f"{name}_out_of_fold", [FOLDED, lambda t, run=run: run(t, fold="fold")], " ".join(f"{c}:6" for c in rates), "SELECT TransactionID, " + ", ".join(f"{out_of_fold(*r)} AS {c}" for c, r in rates.items()) + f" FROM {FT}")
    op(f"{name}_fitted", [lambda t, run=run: run(t, fit=fitted_on(t))], " ".join(f"{c}:6" for c in rates), "SELECT TransactionID, " + ", ".join(f"{fitted_sql(*r)} AS {c}" for c, r in rates.items()) + " FROM t")
op("community_rate_out_of_fold", [FOLDED, lambda t: g.fitted_community_rates(t, fold="fold")], "community:i community_rate:6",
   f"{COMM}, fd AS (SELECT card1, {FOLD} AS fold, max(isFraud) AS bad FROM o GROUP BY ALL) SELECT o.TransactionID, community, (SELECT count(DISTINCT fd.card1) FROM fd JOIN cm c2 USING (card1) WHERE c2.community=cm.community AND fd.bad=1 AND fd.fold<>o.{FOLD})/(SELECT size FROM st WHERE st.community=cm.community) AS community_rate FROM o JOIN cm USING (card1)", view=txn_ord)
op("community_rate_fitted", [lambda t: g.fitted_community_rates(t, fit=fitted_on(t))], "community:i community_rate:6",
   f"{COMM} SELECT TransactionID, community, (SELECT count(DISTINCT x.card1) FROM o x JOIN cm c2 ON c2.card1=x.card1 WHERE c2.community=cm.community AND x.isFraud=1 AND x.{IN_FIT})/(SELECT size FROM st WHERE st.community=cm.community) AS community_rate FROM o JOIN cm USING (card1)", view=txn_ord)
#: Scores of any range, some without a value.
WIDE = "CASE WHEN TransactionID%9=0 THEN NULL WHEN TransactionID%3=0 THEN proba*1e6 ELSE -proba/1e3 END"
op("rank_normalised_wide", [lambda t: t.withColumn("proba", F.expr(WIDE)), d.rank_normalised], "rank_norm:6", f"SELECT TransactionID, CASE WHEN p IS NOT NULL THEN (rank() OVER (ORDER BY p NULLS LAST)+(count(*) OVER (PARTITION BY p)-1)/2.0)/(SELECT count({WIDE}) FROM t) END AS rank_norm FROM (SELECT TransactionID, {WIDE} AS p FROM t)")
op("drift_monitor_without_fraud", [lambda t: t.withColumn("isFraud", F.expr(f"CASE WHEN floor({DT}/604800)%3=1 THEN 0 ELSE isFraud END")), rep.drift_monitor], "period:i auc:6 status psi:6",
   f"{PSI.replace('SELECT *, CAST(floor(', f'SELECT * REPLACE (CASE WHEN floor({DT}/604800)%3=1 THEN 0 ELSE isFraud END AS isFraud), CAST(floor(', 1)} SELECT period, auc, CASE WHEN auc IS NULL THEN 'unknown' WHEN auc<0.95 THEN 'critical' WHEN auc<0.97 THEN 'warning' ELSE 'ok' END AS status, psi FROM x LEFT JOIN a USING (period)", key="")
CATS = [c for c in f.CATEGORIES if c != "DeviceType"]
op("initial_clean", [lambda t: t.withColumn("card4", F.coalesce("card4", F.lit("nan"))), f.initial_clean], " ".join(CATS), "SELECT TransactionID, " + ", ".join(f"nullif(CAST({c} AS VARCHAR),'nan') AS {c}" for c in CATS) + " FROM t")
op("drop_high_missing_columns", [lambda t: t.withColumns({"sparse": F.expr("CASE WHEN TransactionID % 10 = 0 THEN 1 END"), "kept": F.expr("CASE WHEN TransactionID % 10 = 0 THEN 1 END"), "dist1": F.expr("CASE WHEN TransactionID % 10 = 0 THEN 1 END")}), lambda t: f.without_high_missing(t, (*f.ESSENTIAL, "kept")), lambda t: t.withColumn("n_columns", F.lit(len(t.columns)))], "n_columns:i kept:i", "SELECT TransactionID, 19 AS n_columns, CASE WHEN TransactionID%10=0 THEN 1 END AS kept FROM t")
ODD = f"CASE WHEN TransactionID%5=0 THEN CAST('Infinity' AS DOUBLE) WHEN TransactionID%7=0 THEN CAST('NaN' AS DOUBLE) WHEN TransactionID%11=0 THEN NULL ELSE {A} END"
op("finite_or_zero", [lambda t: t.withColumn("x", F.expr(ODD)), lambda t: pre.made_finite(t, ("x",))], "x:4", f"SELECT TransactionID, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0.0 ELSE x END AS x FROM (SELECT *, {ODD} AS x FROM t)")
CODES = ("card4", "card6", "ProductCD", "P_emaildomain")
op("label_encode", [lambda t: pre.label_encoded(t, CODES)], " ".join(f"{c}_code:i" for c in CODES), "SELECT TransactionID, " + ", ".join(f"dense_rank() OVER (ORDER BY coalesce({c},'MISSING'))-1 AS {c}_code" for c in CODES) + " FROM t")
op("median_impute", [lambda t: pre.median_imputed(t, ("D1", "dist1"))], "D1:6 dist1:6", "SELECT TransactionID, coalesce(D1,(SELECT median(D1) FROM t)) AS D1, coalesce(dist1,(SELECT median(dist1) FROM t)) AS dist1 FROM t")
op("standard_scale", [lambda t: pre.standard_scaled(t, (A, "D1"))], f"{A}_scaled:6 D1_scaled:6", "SELECT TransactionID, " + ", ".join(f"({c}-avg({c}) OVER ())/stddev_pop({c}) OVER () AS {c}_scaled" for c in (A, "D1")) + " FROM t")
op("smote_counts", [lambda t: pre.oversampled(t, (A, "D1", "dist1"), 0.5), lambda t: t.groupBy("synthetic", "isFraud").agg(F.count("*").alias("n"), F.min(A).alias("least"), F.max(A).alias("most")).where("n > 0").select("synthetic", "isFraud", "n")], "synthetic:i isFraud:i n:i",
   "SELECT * FROM (SELECT 0 AS synthetic, isFraud, count(*) AS n FROM t GROUP BY isFraud UNION ALL SELECT 1, 1, greatest(CAST(floor(sum(1-isFraud)*(0.5/(1-0.5))) AS BIGINT)-sum(isFraud),0) FROM t) WHERE n>0", key="")
op("smote", [lambda t: pre.oversampled(t, (A, "D1", "dist1"), 0.5)], f"synthetic:i isFraud:i {A}:6 D1:6 dist1:6", None, key="")
MD = lambda key, salt: f"CAST('0x'||substr(md5({key}||'{salt}'),1,8) AS BIGINT)"
OWN = MD("CAST(e.TransactionID AS VARCHAR)", "own")
op("device_imputation", [f.device_imputation], "DeviceInfo imputed:i",
   f"WITH kn AS (SELECT card1, DeviceInfo AS dv, row_number() OVER (PARTITION BY card1 ORDER BY DeviceInfo, TransactionID)-1 AS at, count(*) OVER (PARTITION BY card1) AS n FROM t WHERE DeviceInfo IS NOT NULL), bs AS (SELECT dv, sum(c) OVER (ORDER BY c DESC, dv)-c AS lo, sum(c) OVER (ORDER BY c DESC, dv) AS hi FROM (SELECT DeviceInfo AS dv, count(*) AS c FROM t WHERE DeviceInfo IS NOT NULL GROUP BY 1 ORDER BY c DESC, dv LIMIT 100)), em AS (SELECT e.TransactionID, e.card1, n, n IS NOT NULL AND {MD('CAST(e.TransactionID AS VARCHAR)', 'share')}<{int(0.92 * 2**32)} AS mine, {OWN}%n AS at, {MD('CAST(e.TransactionID AS VARCHAR)', 'other')}%(SELECT max(hi) FROM bs) AS u FROM t e LEFT JOIN (SELECT DISTINCT card1, n FROM kn) z ON e.card1=z.card1 WHERE e.DeviceInfo IS NULL) "
   "SELECT t.TransactionID, coalesce(t.DeviceInfo, CASE WHEN em.mine THEN kn.dv ELSE bs.dv END) AS DeviceInfo, CAST(t.DeviceInfo IS NULL AS INT) AS imputed FROM t LEFT JOIN em USING (TransactionID) LEFT JOIN kn ON em.mine AND kn.card1=em.card1 AND kn.at=em.at LEFT JOIN bs ON em.u>=bs.lo AND em.u<bs.hi")  # fmt: skip


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions written as CSV and read by their schema, joined with the identities."""
    t, path = txn_ev(spark, sf_dir), store.new_path(spark, "csv")
    t.write.option("header", True).csv(path)
    return store.scan_csv(spark, path, t.schema)


def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores written as documents of up to 1,000 rows and read back, a row an entry."""
    docs, path = store.as_documents(txn_ev(spark, sf_dir).select(ID, "isFraud", "proba")), store.new_path(spark, "json")
    docs.write.json(path)
    return store.scan_results_json(spark, path, docs.schema, [ID, "isFraud", "proba"])


ALL = "TransactionDT:i TransactionAmt:4 isFraud:i card1:i card4 ProductCD addr1:i P_emaildomain DeviceInfo proba:6"
op("scan_csv", [], ALL, "SELECT * FROM t", view=csv_scan)
op("scan_results_json", [], "isFraud:i proba:6", "SELECT * FROM t", view=json_scan)


def stream(name: str, run, sql: str) -> None:
    REGISTERED[name] = (run, sql)


def scored_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arriving transactions to score and tier, appended."""
    events = streams.event_stream(spark, sf_dir, False)
    return streams.drained(d.point_score(f.time_features(_view(spark, sf_dir, _EV, events=events))).select(ID, "risk_score", "risk_category"), "append")


stream("stream_score", scored_stream, f"{duckdb_views()} SELECT TransactionID, risk_score, risk_category FROM ({POINT1})")
SIZES = {"1 hour": 3600, "6 hours": 21600, "24 hours": 86400}
LAST = "(SELECT max(epoch(ts)) FROM events)-3600"


def velocity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums a user in tumbling windows of three sizes; windows that the watermark has closed."""
    every = None
    for size, seconds in SIZES.items():
        got = streams.drained(streams.velocity_bins(streams.event_stream(spark, sf_dir), size), "append")
        got = got.select(F.lit(seconds).cast("long").alias("seconds"), F.unix_seconds("w.start").alias("start"), "user_id", "n", F.round("total", 4).alias("total"))
        every = got if every is None else every.unionByName(got)
    return every


stream("stream_velocity_bins", velocity_stream, "SELECT * FROM (" + " UNION ALL ".join(f"SELECT CAST({s} AS BIGINT) AS seconds, CAST(floor(epoch(ts)/{s})*{s} AS BIGINT) AS start, user_id, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY ALL" for s in SIZES.values()) + f") WHERE start+seconds<={LAST}")
stream("stream_burst_sessions", lambda s, p: streams.drained(streams.burst_sessions(streams.event_stream(s, p)), "append").select("user_id", F.unix_seconds("session.start").alias("start"), "n"),
       f"SELECT user_id, CAST(floor(min(epoch(ts))) AS BIGINT) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, CAST(coalesce(ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)>INTERVAL 5 MINUTE, true) AS INT) AS new FROM events)) GROUP BY user_id, k HAVING max(epoch(ts))+300<={LAST}")


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events twice over, each id once."""
    e = streams.event_stream(spark, sf_dir)
    return streams.drained(streams.deduplicated(e.unionByName(streams.event_stream(spark, sf_dir))).select("event_id", "user_id", "event_type"), "append")


stream("stream_dedup", replayed, "SELECT event_id, user_id, event_type FROM events")


def enriched_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their user's profile, which two thirds of the users have."""
    profile = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 3 <> 0").groupBy("user_id").agg(F.avg("value").alias("usual"), F.count("*").alias("seen"))
    return streams.drained(streams.enriched(streams.event_stream(spark, sf_dir), profile), "append").select("event_id", F.round("usual", 4).alias("usual"), "seen")


stream("stream_enrich", enriched_stream, "SELECT event_id, round(coalesce(usual,0.0),4) AS usual, coalesce(seen,0) AS seen FROM events LEFT JOIN (SELECT user_id, avg(value) AS usual, count(*) AS seen FROM events WHERE user_id%3<>0 GROUP BY 1) USING (user_id)")

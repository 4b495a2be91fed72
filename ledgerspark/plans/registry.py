"""The registered queries of the transaction operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decide as d
from ..operators import features as f
from ..operators import models as m
from ..operators import network as g
from ..operators import robust as r
from ..sources import store
from ..sources.views import duckdb_views, ident_ev, txn_ev, txn_ord, v_feat
from ..streaming import streams

ID = "TransactionID"
REGISTERED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def shown(df: DataFrame, columns: dict[str, int | None]) -> DataFrame:
    """Columns by name; doubles rounded to the given places, counts as long."""
    return df.select(*((F.round(F.col(c).cast("double"), p) if p is not None else F.col(c)).alias(c) for c, p in columns.items()))


def op(name: str, steps, out: str, sql: str | None, view=txn_ev, key: str = ID) -> None:
    """out: 'col col:6'; a number after the colon rounds a double, i makes it long."""
    cols = [c.partition(":")[::2] for c in out.split()]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = view(spark, sf_dir)
        for s in steps:
            df = s(df)
        pick = {"": lambda c: F.col(c), "i": lambda c: F.col(c).cast("long")}
        return df.select(*((pick[k](c) if k in pick else F.round(F.col(c).cast("double"), int(k))).alias(c) for c, k in ([(key, "")] if key else []) + cols))

    if sql is not None:
        names = [key] * bool(key) + [c for c, _ in cols]
        kinds = [""] * bool(key) + [k for _, k in cols]
        wrap = ", ".join(c if k == "" else f"CAST({c} AS BIGINT) AS {c}" if k == "i" else f"round(CAST({c} AS DOUBLE), {k}) AS {c}" for c, k in zip(names, kinds))
        sql = f"{duckdb_views()} SELECT {wrap} FROM ({sql})"
    REGISTERED[name] = (run, sql)


UID = "PARTITION BY card1, addr1"
SEQ = "ORDER BY TransactionDT, TransactionID"
A, DT = "TransactionAmt", "TransactionDT"
HOUR = f"CAST(floor({DT} % 86400 / 3600) AS INT)"
lk = lambda keys, aggs: f"(SELECT {keys}, {aggs} FROM t GROUP BY {keys})"

op("scan_limited", [lambda t: t.orderBy(ID).limit(10_000)], f"{A}:4", f"SELECT * FROM t ORDER BY {ID} LIMIT 10000")
op("left_join_identity", [], "DeviceInfo DeviceType", "SELECT t.TransactionID, i.DeviceInfo, i.DeviceType FROM t LEFT JOIN i USING (TransactionID)", view=lambda s, p: f.left_join_identity(txn_ev(s, p).drop("DeviceInfo"), ident_ev(s, p)))
op("drop_high_missing", [f.null_shares], "name null_share:6", "SELECT name, null_share FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END) AS null_share FROM t" for c in "TransactionID TransactionDT TransactionAmt isFraud card1 card2 card4 card5 card6 ProductCD addr1 addr2 R_emaildomain P_emaildomain DeviceInfo D1 dist1 proba".split()) + ")", key="")
op("amount_features", [f.amount_features], "log_amount:6 sqrt_amount:6 amount_decimal:6 is_round_amount:i", f"SELECT *, ln(1+{A}) AS log_amount, sqrt({A}) AS sqrt_amount, {A}-floor({A}) AS amount_decimal, CASE WHEN {A}=floor({A}) THEN 1 ELSE 0 END AS is_round_amount FROM t")
op("time_features", [f.time_features], "hour:i is_night:i day_of_week:i is_weekend:i month_approx:i", f"SELECT *, {HOUR} AS hour, CASE WHEN {HOUR} BETWEEN 0 AND 6 THEN 1 ELSE 0 END AS is_night, CAST(floor({DT}/86400) AS BIGINT)%7 AS day_of_week, CASE WHEN CAST(floor({DT}/86400) AS BIGINT)%7>=5 THEN 1 ELSE 0 END AS is_weekend, floor({DT}/2592000) AS month_approx FROM t")
PROFILE = f"SELECT t.*, m AS user_avg_amt, coalesce(s,1.0) AS user_std_amt, n AS user_txn_count, k AS user_product_diversity, ({A}-m)/greatest(coalesce(s,1.0),1.0) AS amount_zscore, {A}/greatest(m,0.01) AS amount_to_mean_ratio FROM {{v}} t LEFT JOIN (SELECT card1, avg({A}) AS m, stddev_samp({A}) AS s, count(*) AS n, count(DISTINCT ProductCD) AS k FROM {{v}} GROUP BY card1) USING (card1)"
PCOLS = "user_avg_amt:6 user_std_amt:6 user_txn_count:i user_product_diversity:i amount_zscore:6 amount_to_mean_ratio:6"
op("behavioral_profile", [f.behavioral_profile], PCOLS, PROFILE.format(v="t"))
op("behavioral_profile_orders", [f.behavioral_profile], PCOLS, PROFILE.format(v="o"), view=txn_ord)
op("account_flags", [f.amount_features, f.behavioral_profile, f.account_flags], "is_low_activity_user:i dormant_high_value:i is_new_account:i first_txn_high_value:i is_suspicious_round:i",
   f"SELECT TransactionID, CAST(n<5 AS INT) AS is_low_activity_user, CAST(n<5 AND {A}>2*m AS INT) AS dormant_high_value, CAST(n=1 AS INT) AS is_new_account, CAST(n=1 AND {A}>500 AS INT) AS first_txn_high_value, CAST({A}=floor({A}) AND {A}>=500 AS INT) AS is_suspicious_round FROM o LEFT JOIN (SELECT card1, avg({A}) AS m, count(*) AS n FROM o GROUP BY card1) USING (card1)", view=txn_ord)
op("sim_swap", [f.sim_swap], "user_device_count:i usual_device is_unusual_device:i", "SELECT t.*, coalesce(c,0) AS user_device_count, d AS usual_device, CASE WHEN DeviceInfo<>d THEN 1 ELSE 0 END AS is_unusual_device FROM t LEFT JOIN (SELECT card1, count(DISTINCT DeviceInfo) AS c FROM t GROUP BY card1) USING (card1) LEFT JOIN (SELECT card1, DeviceInfo AS d FROM (SELECT card1, DeviceInfo, row_number() OVER (PARTITION BY card1 ORDER BY count(*) DESC, DeviceInfo) AS r FROM t WHERE DeviceInfo IS NOT NULL GROUP BY card1, DeviceInfo) WHERE r=1) USING (card1)")
op("seasonal_baseline", [f.time_features, f.seasonal_baseline], "seasonal_avg:6 amt_vs_seasonal:6", f"SELECT *, avg({A}) OVER w AS seasonal_avg, {A}/greatest(avg({A}) OVER w,0.01) AS amt_vs_seasonal FROM t WINDOW w AS (PARTITION BY card1, CAST(floor({DT}/2592000) AS BIGINT))")
op("merchant_risk", [f.merchant_risk], "product_fraud_rate:6 addr_fraud_rate:6", f"SELECT t.*, p AS product_fraud_rate, coalesce(q,(SELECT avg(isFraud) FROM t)) AS addr_fraud_rate FROM t LEFT JOIN {lk('ProductCD','avg(isFraud) AS p')} USING (ProductCD) LEFT JOIN {lk('addr1','avg(isFraud) AS q')} USING (addr1)")
op("category_mismatch", [f.behavioral_profile, f.merchant_risk, f.category_mismatch], "category_mismatch_risk:i", "SELECT o.TransactionID, CASE WHEN k<=2 AND p>0.05 THEN 1 ELSE 0 END AS category_mismatch_risk FROM o LEFT JOIN (SELECT ProductCD, avg(isFraud) AS p FROM o GROUP BY ProductCD) USING (ProductCD) LEFT JOIN (SELECT card1, count(DISTINCT ProductCD) AS k FROM o GROUP BY card1) USING (card1)", view=txn_ord)
op("shared_device", [f.shared_device], "device_user_count:i device_email_count:i is_shared_device:i", f"SELECT t.*, coalesce(c,0) AS device_user_count, coalesce(e,0) AS device_email_count, CASE WHEN c>2 THEN 1 ELSE 0 END AS is_shared_device FROM t LEFT JOIN {lk('DeviceInfo','count(DISTINCT card1) AS c, count(DISTINCT P_emaildomain) AS e')} USING (DeviceInfo)")
FREE = ", ".join(f"'{x}'" for x in f.FREE_MAIL)
op("email_risk", [f.email_features], "email_fraud_rate:6 email_user_count:i is_free_email:i is_corporate_email:i", f"SELECT t.*, coalesce(p,(SELECT avg(isFraud) FROM t)) AS email_fraud_rate, coalesce(c,0) AS email_user_count, CASE WHEN P_emaildomain IN ({FREE}) THEN 1 ELSE 0 END AS is_free_email, CASE WHEN P_emaildomain NOT IN ({FREE}) THEN 1 ELSE 0 END AS is_corporate_email FROM t LEFT JOIN {lk('P_emaildomain','avg(isFraud) AS p, count(DISTINCT card1) AS c')} USING (P_emaildomain)")
op("network_lite", [f.time_features, f.network_lite], "users_per_address:i has_fraud_neighbor:i users_per_card_combo:i txns_per_addr_hour:i", f"SELECT t.*, coalesce(c,1) AS users_per_address, coalesce(y,0) AS has_fraud_neighbor, (SELECT count(DISTINCT card1) FROM t u WHERE u.card4 IS NOT DISTINCT FROM t.card4 AND u.card5=t.card5 AND u.card6=t.card6) AS users_per_card_combo, count(*) OVER (PARTITION BY addr1, {HOUR}) AS txns_per_addr_hour FROM t LEFT JOIN {lk('addr1','count(DISTINCT card1) AS c, max(isFraud) AS y')} USING (addr1)")
op("uid_profile", [f.uid_profile], "uid_mean:6 uid_std:6 uid_max:6 uid_min:6 uid_count:i uid_range:6 uid_zscore:6 uid_ratio:6 uid_is_max:i uid_fraud_count:i uid_fraud_rate:6",
   f"SELECT *, uid_max-uid_min AS uid_range, ({A}-uid_mean)/greatest(uid_std,1.0) AS uid_zscore, {A}/greatest(uid_mean,0.01) AS uid_ratio, CASE WHEN {A}>=0.99::DOUBLE*uid_max THEN 1 ELSE 0 END AS uid_is_max, (uid_fraud_count+50*(SELECT avg(isFraud) FROM t))/(uid_count+50) AS uid_fraud_rate FROM (SELECT *, avg({A}) OVER w AS uid_mean, coalesce(stddev_samp({A}) OVER w,0.0) AS uid_std, max({A}) OVER w AS uid_max, min({A}) OVER w AS uid_min, count(*) OVER w AS uid_count, sum(isFraud) OVER w AS uid_fraud_count FROM t WINDOW w AS ({UID}))")
op("uid_diversity", [f.uid_diversity], "uid_device_count:i uid_email_count:i uid_product_count:i", "SELECT t.TransactionID, uid_device_count, uid_email_count, uid_product_count FROM t JOIN (SELECT card1, addr1, count(DISTINCT DeviceInfo) AS uid_device_count, count(DISTINCT P_emaildomain) AS uid_email_count, count(DISTINCT ProductCD) AS uid_product_count FROM t GROUP BY card1, addr1) u ON t.card1=u.card1 AND t.addr1 IS NOT DISTINCT FROM u.addr1")
op("uid2_profile", [f.uid2_profile], "uid2_count:i uid2_mean:6", f"SELECT *, count(*) OVER w AS uid2_count, avg({A}) OVER w AS uid2_mean FROM t WINDOW w AS (PARTITION BY card1, addr1, coalesce(D1,-1))")
op("uid_time_bins", [f.uid_time_bins], "uid_count_1h:i uid_sum_1h:4 uid_count_6h:i uid_sum_6h:4 uid_count_24h:i uid_sum_24h:4 uid_spike_1h:i uid_spike_24h:i uid_amount_spike:i uid_peak_hourly:i",
   f"SELECT *, CAST(uid_count_1h>=3 AS INT) AS uid_spike_1h, CAST(uid_count_24h>=10 AS INT) AS uid_spike_24h, CAST(uid_sum_24h>3*avg({A}) OVER ({UID}) AS INT) AS uid_amount_spike, max(uid_count_1h) OVER ({UID}) AS uid_peak_hourly FROM (SELECT *, count(*) OVER ({UID}, {DT}//3600) AS uid_count_1h, sum({A}) OVER ({UID}, {DT}//21600) AS uid_sum_6h, count(*) OVER ({UID}, {DT}//86400) AS uid_count_24h, sum({A}) OVER ({UID}, {DT}//86400) AS uid_sum_24h, sum({A}) OVER ({UID}, {DT}//3600) AS uid_sum_1h, count(*) OVER ({UID}, {DT}//21600) AS uid_count_6h FROM t)")
PEER = lambda c: f"CASE WHEN {c} IS NOT NULL THEN ({A}-avg({A}) OVER (PARTITION BY {c}))/(coalesce(stddev_samp({A}) OVER (PARTITION BY {c}),1.0)+1) END"
op("peer_deviation", [f.peer_deviation], "peer_deviation:6 is_peer_outlier:i", f"SELECT *, CASE WHEN peer_deviation>2 THEN 1 ELSE 0 END AS is_peer_outlier FROM (SELECT *, coalesce(list_avg(list_filter([abs(a),abs(b),abs(c)], lambda x: x IS NOT NULL)),0.0) AS peer_deviation FROM (SELECT TransactionID, {PEER('ProductCD')} AS a, {PEER('card4')} AS b, {PEER('addr1')} AS c FROM t))")
op("cross_fraud_rates", [f.cross_fraud_rates], "card1_ProductCD_rate:6 card1_addr1_rate:6 addr1_P_emaildomain_rate:6 ProductCD_P_emaildomain_rate:6", "SELECT *, " + ", ".join(f"(sum(isFraud) OVER (PARTITION BY {a}, {b})+30*(SELECT avg(isFraud) FROM t))/(count(*) OVER (PARTITION BY {a}, {b})+30) AS {a}_{b}_rate" for a, b in (("card1", "ProductCD"), ("card1", "addr1"), ("addr1", "P_emaildomain"), ("ProductCD", "P_emaildomain"))) + " FROM t")
CODE = f"CASE WHEN mx>mn THEN CAST(greatest(ceil(({A}-mn)/((mx-mn)/10)),1)-1 AS BIGINT) ELSE 0 END"  # right-closed bins of equal width
op("entropy_diversity", [f.time_features, f.entropy_diversity], "amount_diversity:i product_diversity:i hour_diversity:i is_high_diversity:i",
   f"SELECT *, CAST(amount_diversity>2*median(amount_diversity) OVER () AS INT) AS is_high_diversity FROM (SELECT t.TransactionID, a AS amount_diversity, p AS product_diversity, h AS hour_diversity FROM t JOIN (SELECT card1, addr1, count(DISTINCT {CODE}) AS a, count(DISTINCT ProductCD) AS p, count(DISTINCT {HOUR}) AS h FROM t, (SELECT min({A}) AS mn, max({A}) AS mx FROM t) GROUP BY card1, addr1) u ON t.card1=u.card1 AND t.addr1 IS NOT DISTINCT FROM u.addr1)")
op("velocity", [f.velocity], "time_since_last:i hours_since_last:6 is_rapid_fire:i txn_count_30min:i rolling_sum_3:4 amount_acceleration:6",
   f"SELECT *, time_since_last/3600 AS hours_since_last, CAST(time_since_last<300 AS INT) AS is_rapid_fire FROM (SELECT *, coalesce({DT}-lag({DT}) OVER w,999999) AS time_since_last, 1+coalesce(CAST({DT}-lag({DT}) OVER w<1800 AS INT),0)+coalesce(CAST({DT}-lag({DT},2) OVER w<1800 AS INT),0) AS txn_count_30min, sum({A}) OVER (PARTITION BY card1 {SEQ} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rolling_sum_3, least({A}/greatest(coalesce(lag({A}) OVER w,0.0),0.01),100.0) AS amount_acceleration FROM t WINDOW w AS (PARTITION BY card1 {SEQ}))")
op("uid_time_gap", [f.uid_time_gap], "uid_gap:i uid_repeat_60:i uid_burst_300:i", f"SELECT *, CAST(uid_gap BETWEEN 0 AND 60 AS INT) AS uid_repeat_60, CAST(uid_gap BETWEEN 0 AND 300 AS INT) AS uid_burst_300 FROM (SELECT *, coalesce({DT}-lag({DT}) OVER ({UID} {SEQ}),-1) AS uid_gap FROM t)")
op("lag_features", [f.lag_features], "prev_amount:6 amount_delta:6 amount_ratio_prev:6 time_since_prev:i uid_rank:i", f"SELECT *, {A}-prev_amount AS amount_delta, {A}/(prev_amount+1) AS amount_ratio_prev FROM (SELECT *, coalesce(lag({A}) OVER w,{A}) AS prev_amount, coalesce({DT}-lag({DT}) OVER w,0) AS time_since_prev, row_number() OVER w-1 AS uid_rank FROM t WINDOW w AS ({UID} {SEQ}))")
op("true_range_velocity", [f.trailing_velocity], "trailing_1h:i trailing_6h:i trailing_24h:i", "SELECT *, " + ", ".join(f"count(*) OVER (PARTITION BY card1 ORDER BY {DT} RANGE BETWEEN {s - 1} PRECEDING AND CURRENT ROW) AS trailing_{n}" for n, s in (("1h", 3600), ("6h", 21600), ("24h", 86400))) + " FROM t")
op("missing_indicators", [f.missing_indicators], "card2_missing:i addr1_missing:i dist1_missing:i P_emaildomain_missing:i", "SELECT *, " + ", ".join(f"CAST({c} IS NULL AS INT) AS {c}_missing" for c in ("card2", "addr1", "dist1", "P_emaildomain")) + " FROM t")
op("point_score", [f.time_features, d.point_score], "risk_score:1 risk_category", f"SELECT TransactionID, round(CAST(s AS DECIMAL(18,6)),1) AS risk_score, CASE WHEN s>=71 THEN 'RED' WHEN s>=51 THEN 'ORANGE' WHEN s>=31 THEN 'YELLOW' ELSE 'GREEN' END AS risk_category FROM (SELECT *, least(100.0, 70*proba+CASE WHEN {HOUR}<=6 OR {HOUR}>=23 THEN 10 ELSE 0 END+CASE WHEN {A}=floor({A}) AND {A}>=500 AND {HOUR}<=6 THEN 10 ELSE 0 END+CASE WHEN {A}>1000 THEN 10 ELSE 0 END) AS s FROM t)")
op("feed_rule_score", [f.time_features, d.feed_score], "feed_score:i feed_tier", f"SELECT *, CASE WHEN feed_score>75 THEN 'RED' WHEN feed_score>55 THEN 'ORANGE' WHEN feed_score>35 THEN 'YELLOW' ELSE 'GREEN' END AS feed_tier FROM (SELECT *, least(greatest(10+CASE WHEN {A}>5000 THEN 25 WHEN {A}>1000 THEN 12 ELSE 0 END+CASE WHEN {HOUR}<=5 OR {HOUR}>=23 THEN 18 ELSE 0 END+CASE WHEN ({DT}//86400)%7>=5 AND {HOUR}<=5 THEN 10 ELSE 0 END+CASE WHEN ProductCD='W' AND {A}>3000 THEN 15 ELSE 0 END+CASE WHEN P_emaildomain='protonmail.com' THEN 12 ELSE 0 END,0),100) AS feed_score FROM t)")
CM = "SELECT *, coalesce(tp/nullif(tp+fp,0),0.0) AS precision, coalesce(tp/nullif(tp+fn,0),0.0) AS recall, coalesce(2.0*tp/nullif(2*tp+fp+fn,0),0.0) AS f1 FROM (SELECT count(*) FILTER (isFraud=1 AND proba>0.5) AS tp, count(*) FILTER (isFraud=0 AND proba>0.5) AS fp, count(*) FILTER (isFraud=1 AND proba<=0.5) AS fn, count(*) FILTER (isFraud=0 AND proba<=0.5) AS tn FROM t)"
op("binary_metrics", [d.confusion], "tp:i fp:i fn:i tn:i precision:6 recall:6 f1:6", CM, key="")
op("roc_curve", [d.roc_curve], "proba:6 fpr:6 tpr:6", "SELECT proba, sum(sum(1-isFraud)) OVER (ORDER BY proba DESC)/(SELECT sum(1-isFraud) FROM t) AS fpr, sum(sum(isFraud)) OVER (ORDER BY proba DESC)/(SELECT sum(isFraud) FROM t) AS tpr FROM t GROUP BY proba", key="")
op("auc", [d.auc], "auc:6", "SELECT sum(CASE WHEN a.proba>b.proba THEN a.n*b.n WHEN a.proba=b.proba THEN a.n*b.n/2.0 ELSE 0 END)/sum(a.n*b.n) AS auc FROM (SELECT proba, count(*) AS n FROM t WHERE isFraud=1 GROUP BY proba) a, (SELECT proba, count(*) AS n FROM t WHERE isFraud=0 GROUP BY proba) b", key="")
op("rank_normalised", [d.rank_normalised], "rank_norm:6", "SELECT TransactionID, (rank() OVER (ORDER BY proba)+(count(*) OVER (PARTITION BY proba)-1)/2.0)/(SELECT count(*) FROM t) AS rank_norm FROM t")
COST = "SELECT i, 0.01::DOUBLE+i*0.98::DOUBLE/999 AS threshold, tp, fp, fn, fn*850.0+fp*25.0+(tp+fp)*15.0 AS cost FROM (SELECT i, sum(y*n) FILTER (proba>=0.01::DOUBLE+i*0.98::DOUBLE/999-1e-12) AS tp, sum((1-y)*n) FILTER (proba>=0.01::DOUBLE+i*0.98::DOUBLE/999-1e-12) AS fp, sum(y*n) FILTER (proba<0.01::DOUBLE+i*0.98::DOUBLE/999-1e-12) AS fn FROM (SELECT proba, isFraud AS y, count(*) AS n FROM t GROUP BY ALL), range(1000) r(i) GROUP BY i)"
COST = "SELECT i, threshold, coalesce(tp,0) AS tp, coalesce(fp,0) AS fp, coalesce(fn,0) AS fn, coalesce(fn,0)*850.0+coalesce(fp,0)*25.0+(coalesce(tp,0)+coalesce(fp,0))*15.0 AS cost FROM (" + COST + ")"
op("cost_threshold", [d.cost_threshold], "i:i tp:i fp:i fn:i cost:2", COST, key="")
op("threshold_curve", [d.cost_threshold, lambda t: t.where("i % 10 = 0")], "i:i threshold:6 cost:2", f"SELECT * FROM ({COST}) WHERE i%10=0", key="")
op("best_cost_threshold", [d.best_threshold], "threshold:6 cost:2", f"SELECT threshold, cost FROM ({COST}) ORDER BY cost, i LIMIT 1", key="")
op("roi", [d.roi], "savings:0 roi:6", f"SELECT b-c AS savings, (b-c)/b AS roi FROM (SELECT 50e6*0.035*0.7*850+50e6*0.965*0.05*25 AS b, 50e6*0.035*(1-recall)*850+(fl-50e6*0.035*recall)*25+fl*15 AS c FROM (SELECT recall, 50e6*0.035*recall/greatest(precision,0.01) AS fl FROM ({CM})))", key="")
op("fraud_by_hour", [f.time_features, lambda t: d.rate_by(t, "hour")], "hour:i fraud_pct:6 n:i", f"SELECT {HOUR} AS hour, 100*avg(isFraud) AS fraud_pct, count(*) AS n FROM t GROUP BY 1", key="")
op("fraud_by_product", [lambda t: d.rate_by(t, "ProductCD")], "ProductCD fraud_pct:6 n:i", "SELECT ProductCD, 100*avg(isFraud) AS fraud_pct, count(*) AS n FROM t GROUP BY 1", key="")
op("group_fairness", [lambda t: d.rate_by(t, "card4", "ProductCD")], "card4 ProductCD fraud_pct:6 n:i", "SELECT card4, ProductCD, 100*avg(isFraud) AS fraud_pct, count(*) AS n FROM t GROUP BY 1, 2", key="")
op("report_rollup", [f.time_features, d.report_rollup], "ProductCD hour:i fraud_rate:6 n:i level:i", f"SELECT ProductCD, hour, avg(isFraud) AS fraud_rate, count(*) AS n, grouping(ProductCD, hour) AS level FROM (SELECT *, {HOUR} AS hour FROM t) GROUP BY ROLLUP (ProductCD, hour)", key="")
EDGES = "e AS (SELECT src, dst, arg_min(rel, p) AS relation FROM (" + " UNION ALL ".join(f"SELECT a.card1 AS src, b.card1 AS dst, '{r}' AS rel, {p} AS p FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY card1) AS r, count(*) OVER (PARTITION BY k) AS n FROM (SELECT DISTINCT {k} AS k, card1 FROM o WHERE {k} IS NOT NULL)) a JOIN (SELECT *, row_number() OVER (PARTITION BY k ORDER BY card1) AS r FROM (SELECT DISTINCT {k} AS k, card1 FROM o WHERE {k} IS NOT NULL)) b ON a.k=b.k AND b.r-a.r BETWEEN 1 AND {reach} AND a.n BETWEEN 2 AND {m}{more}" for k, r, p, m, reach, more in (("DeviceInfo", "shared_device", 1, 20, 4, ""), ("addr1", "shared_address", 2, 15, 4, ""), ("P_emaildomain", "shared_email", 3, 10, 2, " AND a.k IN (SELECT P_emaildomain FROM o GROUP BY P_emaildomain HAVING count(*) BETWEEN 2 AND 100)"))) + ") GROUP BY src, dst), w AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"
graph = lambda q: f"WITH {EDGES} {q}"
op("graph_edges", [g.graph_edges], "src:i dst:i relation", graph("SELECT * FROM e"), view=txn_ord, key="")
op("degree_centrality", [g.degree_centrality], "card1:i degree:i centrality:9", graph("SELECT c.card1, coalesce(n,0) AS degree, coalesce(n,0)/((SELECT count(DISTINCT card1) FROM o)-1) AS centrality FROM (SELECT DISTINCT card1 FROM o) c LEFT JOIN (SELECT src, count(*) AS n FROM w GROUP BY src) d ON c.card1=d.src"), view=txn_ord, key="")
op("fraud_neighbors", [g.fraud_neighbors], "card1:i fraud_neighbors:i fraud_neighbor_ratio:6", graph("SELECT src AS card1, sum(bad) AS fraud_neighbors, avg(bad) AS fraud_neighbor_ratio FROM w JOIN (SELECT card1, max(isFraud) AS bad FROM o GROUP BY card1) b ON w.dst=b.card1 GROUP BY src"), view=txn_ord, key="")
op("clustering_coeff", [g.clustering], "card1:i clustering:6", graph("SELECT d.src AS card1, coalesce(2.0*t/nullif(n*(n-1),0),0.0) AS clustering FROM (SELECT src, count(*) AS n FROM w GROUP BY src) d LEFT JOIN (SELECT a.src, count(*)/2 AS t FROM w a JOIN w b ON a.src=b.src JOIN w c ON a.dst=c.src AND b.dst=c.dst GROUP BY a.src) x ON d.src=x.src"), view=txn_ord, key="")

CAL = "TransactionID % 2 = 0"
CONFORMAL = f"SELECT t.*, CASE WHEN 1-proba<=q AND proba<=q THEN '0,1' WHEN 1-proba<=q THEN '1' WHEN proba<=q THEN '0' WHEN proba>0.5 THEN '1' ELSE '0' END AS prediction_set, CAST(1-proba<=q AND proba<=q AS INT) AS is_uncertain, CASE WHEN 1-proba<=q AND proba>q THEN proba WHEN proba<=q AND 1-proba>q THEN 1-proba ELSE greatest(proba,1-proba) END AS confidence FROM t, (SELECT max(s) FILTER (k=floor(h))+(max(s) FILTER (k=ceil(h))-max(s) FILTER (k=floor(h)))*(max(h)-floor(max(h))) AS q FROM (SELECT *, (n-1)*least(ceil((n+1)*0.95::DOUBLE)/n,1.0) AS h FROM (SELECT CASE WHEN isFraud=1 THEN 1-proba ELSE proba END AS s, row_number() OVER (ORDER BY CASE WHEN isFraud=1 THEN 1-proba ELSE proba END)-1 AS k, count(*) OVER () AS n FROM t WHERE {CAL})))"
op("conformal_sets", [lambda t: r.conformal_sets(t, F.expr(CAL))], "prediction_set is_uncertain:i confidence:6", CONFORMAL)
op("conformal_summary", [lambda t: r.conformal_sets(t, F.expr(CAL)), r.conformal_summary], "certain_fraud:6 certain_legit:6 uncertain:6 mean_confidence:6", f"SELECT avg(CAST(prediction_set='1' AS INT)) AS certain_fraud, avg(CAST(prediction_set='0' AS INT)) AS certain_legit, avg(CAST(prediction_set='0,1' AS INT)) AS uncertain, avg(confidence) AS mean_confidence FROM ({CONFORMAL})", key="")
USUAL = "(SELECT card1, DeviceInfo AS d FROM (SELECT card1, DeviceInfo, row_number() OVER (PARTITION BY card1 ORDER BY count(*) DESC, DeviceInfo) AS r FROM t WHERE DeviceInfo IS NOT NULL GROUP BY card1, DeviceInfo) WHERE r=1)"
HIT = "coalesce(avg(CAST(proba>0.5 AS INT)) FILTER ({c}),0.0)"
CATCH = f"SELECT 'low_amount_fraud_catch_rate' AS metric, {HIT.format(c=A + '<=m')} AS value, 0.4 AS pass_above FROM fr UNION ALL SELECT 'daytime_fraud_catch_rate', {HIT.format(c=HOUR + '>6')}, 0.4 FROM fr UNION ALL SELECT 'normal_device_fraud_catch_rate', {HIT.format(c='DeviceInfo IS NULL OR d IS NULL OR DeviceInfo=d')}, 0.35 FROM fr"
STABLE = "SELECT 'threshold_stability' AS metric, (SELECT min(f1) FROM f1s WHERE abs(i-(SELECT arg_min(i, (-f1, i)) FROM f1s))<=2)/greatest((SELECT max(f1) FROM f1s),0.001) AS value, 0.7 AS pass_above"
SURE = "SELECT 'confidence_rate' AS metric, coalesce(avg(CAST(proba>0.6::DOUBLE OR proba<0.4::DOUBLE AS INT)),0.0) AS value, 0.6 AS pass_above FROM fr"
CHECKS = f"WITH fr AS (SELECT t.*, d, median({A}) OVER () AS m FROM t LEFT JOIN {USUAL} USING (card1) WHERE isFraud=1), f1s AS (SELECT i, coalesce(2.0*sum(CAST(proba>c AS INT)*isFraud)/nullif(sum(isFraud)+sum(CAST(proba>c AS INT)),0),0.0) AS f1 FROM t, (VALUES {', '.join(f'({i}, {c!r}::DOUBLE)' for i, c in enumerate(r.STEPS))}) s(i, c) GROUP BY i) SELECT *, CAST(value>pass_above AS INT) AS passed FROM ({{q}})"
MARKS = [f.amount_features, f.time_features, f.sim_swap]
op("catch_rate_by_slice", [*MARKS, r.catch_rates], "metric value:4 pass_above:2 passed:i", CHECKS.format(q=CATCH), key="")
op("threshold_stability", [r.threshold_stability], "metric value:4 pass_above:2 passed:i", CHECKS.format(q=STABLE), key="")
op("confidence_rate", [r.confidence_rate], "metric value:4 pass_above:2 passed:i", CHECKS.format(q=SURE), key="")
op("robustness_report", [*MARKS, r.robustness_report], "passed:i total:i pct:4", f"SELECT sum(passed) AS passed, count(*) AS total, 100*avg(passed) AS pct FROM ({CHECKS.format(q=f'{CATCH} UNION ALL {STABLE} UNION ALL {SURE}')})", key="")
VS = [f"V{j}" for j in range(1, 9)]
VALS = "[" + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM v))" for c in VS) + "]"
op("row_stats_v", [lambda t: r.row_stats(t, VS)], "v_mean:6 v_std:6 v_max:6 v_min:6 v_range:6 v_nulls:i v_null_pct:6", f"SELECT *, list_avg(a) AS v_mean, list_stddev_samp(a) AS v_std, list_max(a) AS v_max, list_min(a) AS v_min, list_max(a)-list_min(a) AS v_range, v_nulls/8 AS v_null_pct FROM (SELECT TransactionID, {VALS} AS a, {'+'.join(f'CAST({c} IS NULL AS INT)' for c in VS)} AS v_nulls FROM v)", view=v_feat)

op("graph_join_back", [g.graph_join_back], "graph_degree:i graph_fraud_neighbors:i graph_fraud_neighbor_ratio:6", graph("SELECT TransactionID, coalesce(n,0) AS graph_degree, coalesce(y,0) AS graph_fraud_neighbors, coalesce(z,0.0) AS graph_fraud_neighbor_ratio FROM o LEFT JOIN (SELECT src AS card1, count(*) AS n, sum(bad) AS y, avg(bad) AS z FROM w JOIN (SELECT card1, max(isFraud) AS bad FROM o GROUP BY card1) b ON w.dst=b.card1 GROUP BY src) USING (card1)"), view=txn_ord)
ROUNDS = 10
RANKS = "k AS (SELECT DISTINCT card1 FROM o), dg AS (SELECT src, count(*) AS d FROM w GROUP BY src), r0 AS MATERIALIZED (SELECT card1, 1.0::DOUBLE/(SELECT count(*) FROM k) AS pr FROM k)" + "".join(f", r{j + 1} AS MATERIALIZED (SELECT k.card1, 0.15::DOUBLE/(SELECT count(*) FROM k)+0.85::DOUBLE*(coalesce(got,0)+(SELECT coalesce(sum(pr),0) FROM r{j} WHERE card1 NOT IN (SELECT src FROM dg))/(SELECT count(*) FROM k)) AS pr FROM k LEFT JOIN (SELECT w.dst, sum(pr/d) AS got FROM r{j} JOIN w ON r{j}.card1=w.src JOIN dg ON dg.src=w.src GROUP BY w.dst) x ON x.dst=k.card1)" for j in range(ROUNDS))
op("pagerank", [lambda t: g.pagerank(t, rounds=ROUNDS, tolerance=0)], "card1:i pagerank:9", graph(f"SELECT * FROM (WITH {RANKS} SELECT card1, pr AS pagerank FROM r{ROUNDS})"), view=txn_ord, key="")
op("bridge_flag", [g.bridges], "card1:i betweenness:9 is_bridge:i", None, view=txn_ord, key="")

RANK = "row_number() OVER (PARTITION BY isFraud ORDER BY md5(CAST(TransactionID AS VARCHAR)))"
op("stratified_split", [m.stratified_split], "is_test:i", f"SELECT TransactionID, CAST({RANK}<=ceil(count(*) OVER (PARTITION BY isFraud)*0.2::DOUBLE) AS INT) AS is_test FROM t")
op("stratified_kfold", [m.stratified_kfold], "fold:i", f"SELECT TransactionID, {RANK}%7 AS fold FROM t")
PREPARED = [f.amount_features, f.time_features, f.behavioral_profile, f.velocity]
for kind, name in (("gbt", "train_gbt"), ("gbt_shallow", "train_gbt_shallow"), ("gbt_sampled", "train_gbt_sampled"), ("forest", "train_random_forest"), ("perceptron", "train_mlp")):
    op(name, [*PREPARED, lambda t, kind=kind: m.trained(t, kind)], "proba:6", None)
op("isolation_forest", [*PREPARED, m.isolation_forest], "iso_score:6", None)
op("oof_stacking", [*PREPARED, m.oof_stacking], "p_gbt:6 p_gbt_sampled:6 p_perceptron:6 p_isolation:6 proba:6", None)
op("persist_pipeline", [*PREPARED, m.round_trip], "proba:6 same:i", None)
op("tune_params", [*PREPARED, m.tuned], "max_depth:i step_size:4 subsampling:4 auc:6", None, key="")
op("select_features", [*PREPARED, m.selected_features], "feature importance:6 kept:i", None, key="")
op("avg_importance", [*PREPARED, m.importances], "feature importance:6", None, key="")
op("adversarial_validation", [*PREPARED, lambda t: m.adversarial_validation(t, F.col("TransactionDT") > r.quantiles(t, "TransactionDT", 0.8).first()["q"])], "auc:6 status feature importance:6", None, key="")
op("linear_contributions", [*PREPARED, m.linear_contributions], "reasons largest:6", None)
op("pca_v", [lambda t: m.pca_v(t, [f"V{j}" for j in range(1, 9)])], " ".join(f"pca_{j}:6" for j in range(1, 6)), None, view=v_feat)
op("pca_anomaly", [*PREPARED, m.pca_anomaly], "error:6 threshold:6 score:6 is_anomaly:i", None)
op("isotonic_calibration", [lambda t: m.isotonic_calibration(t, F.expr(CAL))], "proba:6 calibrated:6", None)
op("brier", [lambda t: m.isotonic_calibration(t, F.expr(CAL)), m.brier], "brier_before:6 brier_after:6", None, key="")
op("sink_json_report", [d.confusion, lambda t: store.sink_json_report(t, store.new_path(t.sparkSession, "report"))], "tp:i fp:i fn:i tn:i precision:6 recall:6 f1:6", CM, key="")

REGISTERED["stream_running_totals"] = (lambda s, p: streams.drained(streams.running_totals(streams.event_stream(s, p)), "complete"), "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
REGISTERED["stream_lag_state"] = (lambda s, p: streams.drained(streams.lag_state(streams.event_stream(s, p)), "append").select("user_id", "event_id", F.round("gap", 3).alias("gap"), F.col("is_rapid_fire").cast("long").alias("is_rapid_fire"), F.round("delta", 4).alias("delta")),
    "SELECT user_id, event_id, round(gap, 3) AS gap, CAST(gap<300 AS BIGINT) AS is_rapid_fire, round(delta, 4) AS delta FROM (SELECT *, coalesce((epoch_us(ts)-lag(epoch_us(ts)) OVER w)/1e6, 999999.0) AS gap, coalesce(value-lag(value) OVER w, 0.0) AS delta FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")


from . import more, served  # noqa: E402, F401  they add their queries to REGISTERED


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for k, (q, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in REGISTERED.items() if s}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTERED["tier_distribution"][0](spark, sf_dir)

"""Transaction and identity views over the given tables, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_EV = """SELECT event_id AS TransactionID, dt AS TransactionDT, CAST(round(value*10,1) AS DOUBLE) AS TransactionAmt,
 CAST(CASE WHEN event_type='error' AND (k%5=1 OR user_id%7=0) THEN 1 ELSE 0 END AS INT) AS isFraud,
 user_id AS card1, CASE WHEN user_id%17=0 THEN NULL ELSE user_id%50 END AS card2,
 CASE user_id%4 WHEN 0 THEN 'visa' WHEN 1 THEN 'mastercard' WHEN 2 THEN 'discover' ELSE NULL END AS card4,
 CAST(user_id%6 AS INT) AS card5, CASE WHEN user_id%2=0 THEN 'debit' ELSE 'credit' END AS card6,
 CASE k%5 WHEN 0 THEN 'W' WHEN 1 THEN 'C' WHEN 2 THEN 'H' WHEN 3 THEN 'S' ELSE 'R' END AS ProductCD,
 CASE WHEN k%10=0 THEN NULL ELSE 100+k%23 END AS addr1,
 CASE WHEN k%13=0 THEN NULL ELSE 60+k%3 END AS addr2, CASE WHEN k%5<3 THEN NULL WHEN k%2=0 THEN 'gmail.com' ELSE 'corp.example' END AS R_emaildomain,
 CASE WHEN k%11=0 THEN NULL WHEN k%7=0 THEN 'gmail.com' WHEN k%7=1 THEN 'yahoo.com' WHEN k%7=2 THEN 'hotmail.com' WHEN k%7=3 THEN 'protonmail.com' WHEN k%7=4 THEN 'corp.example' WHEN k%7=5 THEN 'outlook.com' ELSE 'anonymous.com' END AS P_emaildomain,
 CASE WHEN k%4=0 THEN NULL ELSE concat('dev_', CAST((user_id*3+k%5)%61 AS STRING)) END AS DeviceInfo,
 CASE WHEN k%9=0 THEN NULL ELSE k%30 END AS D1, CASE WHEN k%3=0 THEN NULL ELSE k END AS dist1,
 CAST(2*k+1 AS DOUBLE)/200 AS proba
FROM (SELECT *, {K} AS k, {DT} AS dt FROM events) e"""
_ORD = """SELECT o_orderkey AS TransactionID, {OD}*86400 + (o_orderkey*37)%86400 AS TransactionDT, o_totalprice AS TransactionAmt,
 CAST(CASE WHEN o_orderstatus='F' AND (o_orderpriority='1-URGENT' OR c_nationkey%11=0) THEN 1 ELSE 0 END AS INT) AS isFraud,
 CASE WHEN o_custkey%3=0 THEN 1000000+o_orderkey ELSE o_custkey END AS card1,
 c_mktsegment AS card4, c_nationkey AS card5, CASE WHEN o_custkey%2=0 THEN 'debit' ELSE 'credit' END AS card6,
 o_orderpriority AS ProductCD, CASE WHEN o_orderkey%13=0 THEN NULL ELSE 100+o_custkey END AS addr1,
 CASE WHEN o_orderkey%11=0 THEN NULL WHEN o_custkey%50=0 THEN concat('corp', CAST(o_custkey AS STRING), '.example') WHEN o_custkey%3=0 THEN 'gmail.com' WHEN o_custkey%3=1 THEN 'yahoo.com' ELSE 'protonmail.com' END AS P_emaildomain,
 CASE WHEN o_orderkey%4=0 THEN NULL ELSE concat('dev_', CAST(o_orderkey%2999 AS STRING)) END AS DeviceInfo
FROM orders JOIN customer ON o_custkey=c_custkey"""
_IDENT = """SELECT event_id AS TransactionID, concat('dev_', CAST(event_id%40 AS STRING)) AS DeviceInfo,
 CASE WHEN event_id%8=0 THEN 'mobile' ELSE 'desktop' END AS DeviceType FROM events WHERE event_id%4=0"""
_SLOTS = {
    "spark": {"K": "CAST(get_json_object(props,'$.k') AS INT)", "DT": "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)", "OD": "timestampdiff(DAY, TIMESTAMP_NTZ'1995-01-01 00:00:00', o_orderdate)"},
    "duckdb": {"K": "CAST(json_extract(props,'$.k') AS INT)", "DT": "(CAST(floor(epoch(ts)) AS BIGINT)-1704067200)", "OD": "date_diff('day', TIMESTAMP '1995-01-01', o_orderdate)"},
}


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str, **given: DataFrame) -> DataFrame:
    return spark.sql(sql.format(**_SLOTS["spark"], **{}).replace("FROM events", "FROM {events}").replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}").replace("FROM embeddings", "FROM {embeddings}"), **given, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def txn_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _EV, "events")


def txn_ord(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _ORD, "orders", "customer")


def ident_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, _IDENT, "events")


def _v(base: int) -> str:
    return ", ".join(f"CASE WHEN (vec_id+{j})%7=0 THEN NULL ELSE CAST(embedding[{base + j - 1}] AS DOUBLE) END AS V{j}" for j in range(1, 9))


def v_feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, f"SELECT vec_id AS TransactionID, {_v(0)} FROM embeddings", "embeddings")


def duckdb_views() -> str:
    """WITH list that defines t (from events), o (from orders) i (identity) and v (V columns) for an oracle query."""
    s = _SLOTS["duckdb"]
    return f"WITH t AS ({_EV.format(**s)}), o AS ({_ORD.format(**s)}), i AS ({_IDENT}), v AS (SELECT vec_id AS TransactionID, {_v(1)} FROM embeddings)"

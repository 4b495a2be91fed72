"""Scores, tiers, reasons, thresholds, metrics and reports on scored transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, flag
from .ordered import running

#: Fixed weights of the risk score, by column.
WEIGHTS = {"proba": 30, "iso_score": 15, "is_unusual_device": 8, "is_shared_device": 6, "is_low_activity_user": 4, "first_txn_high_value": 7, "is_suspicious_round": 4, "product_fraud_rate": 3, "round_x_new_device": 3, "category_mismatch_risk": 2,
           "is_rapid_fire": 5, "graph_community_fraud_rate": 6, "graph_fraud_neighbor_ratio": 4, "graph_is_bridge": 3, "graph_betweenness": 200}
#: Fixed texts by tier.
AUTH = {"RED": "BLOCK transaction. Notify customer. Explain reason. Flag for investigation.", "ORANGE": "Request biometric re-verification before proceeding.", "YELLOW": "Request PIN re-entry for confirmation.", "GREEN": "Auto-approve. No additional authentication needed."}


def raw_score(df: DataFrame) -> Column:
    """The weighted sum; columns that df lacks and nulls count as 0."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0)) if n in df.columns else F.lit(0)
    return sum((w * c(n) for n, w in WEIGHTS.items()), F.lit(0.0)) + c("is_night") * clip(c("amount_zscore"), 0.0, 5.0) * 2


def risk_score(df: DataFrame, batch_max: float | None = None) -> DataFrame:
    """Weighted sum over the batch maximum, in percent; batch_max: a fitted maximum, as a stream needs."""
    df = df.withColumn("_raw", raw_score(df))
    df = df.withColumn("_max", F.lit(batch_max)) if batch_max else df.crossJoin(F.broadcast(df.agg(F.max("_raw").alias("_max"))))
    return df.withColumn("risk_score", clip(F.col("_raw") / F.when(F.col("_max") > 0, F.col("_max")).otherwise(1.0) * 100, 0.0, 100.0)).drop("_raw", "_max")


def tier(score: str = "risk_score", cuts=(71, 51, 31), inclusive: bool = True) -> Column:
    s = F.col(score)
    out = F
    for name, cut in zip(("RED", "ORANGE", "YELLOW"), cuts):
        out = out.when(s >= cut if inclusive else s > cut, name)
    return out.otherwise("GREEN")


def auth_text(category: str = "risk_category") -> Column:
    out = F
    for k, v in AUTH.items():
        out = out.when(F.col(category) == k, v)
    return out


#: The texts of the reasons are fixed.
def explanations(df: DataFrame) -> Column:
    c = lambda n, d=0: F.coalesce(F.col(n), F.lit(d)) if n in df.columns else F.lit(d)
    pct = lambda n, f: F.format_string(f, c(n).cast("double") * 100)
    rules = [
        (c("amount_zscore") > 3, F.concat(F.lit("Amount is "), F.format_string("%.1f", c("amount_to_mean_ratio", 1).cast("double")), F.lit("x above user average"))),
        (c("is_night") == 1, F.concat(F.lit("Transaction at unusual hour ("), c("hour").cast("string"), F.lit(":00)"))),
        (c("is_unusual_device") == 1, F.lit("New/unusual device detected - possible SIM swap or account takeover")),
        (c("is_shared_device") == 1, F.lit("Device shared across multiple identities - possible mule network")),
        (c("first_txn_high_value") == 1, F.lit("Brand-new account with unusually high first transaction")),
        (c("is_suspicious_round") == 1, F.lit("Perfectly round high-value amount (common fraud pattern)")),
        ((c("is_low_activity_user") == 1) & (F.col("TransactionAmt") > 2 * c("user_avg_amt", 999999)), F.lit("Dormant account suddenly active with high-value transaction")),
        (c("product_fraud_rate") > 0.05, F.concat(F.lit("High-risk merchant category (fraud rate: "), pct("product_fraud_rate", "%.1f"), F.lit("%)"))),
        (c("category_mismatch_risk") == 1, F.lit("Transaction in unusual merchant category for this user")),
        (c("is_rapid_fire") == 1, F.lit("Rapid-fire transactions detected (< 5 min apart)")),
        (c("amt_vs_seasonal", 1) > 3, F.concat(F.lit("Amount is "), F.format_string("%.1f", c("amt_vs_seasonal", 1).cast("double")), F.lit("x above seasonal baseline for this user"))),
        (c("graph_community_fraud_rate") > 0.3, F.concat(F.lit("User belongs to high-fraud network community ("), pct("graph_community_fraud_rate", "%.0f"), F.lit("% fraud rate)"))),
        (c("graph_fraud_neighbor_ratio") > 0.3, F.concat(F.lit("Connected to known fraudsters ("), pct("graph_fraud_neighbor_ratio", "%.0f"), F.lit("% of connections)"))),
        (c("graph_is_bridge") == 1, F.lit("Network bridge node - potential money mule connecting fraud rings")),
    ]
    text = F.concat_ws(" | ", F.array_compact(F.array(*(F.when(on, t) for on, t in rules))))
    return F.when(text == "", "No specific risk factors identified").otherwise(text)


def build_output(df: DataFrame) -> DataFrame:
    return df.select("TransactionID", "TransactionAmt", F.col("isFraud").alias("isFraud_actual"), F.col("proba").alias("ml_fraud_probability"), "risk_score", "risk_category", auth_text().alias("auth_recommendation"), "explanation")


def scored(df: DataFrame) -> DataFrame:
    df = risk_score(df).withColumn("risk_category", tier())
    return build_output(df.withColumn("explanation", explanations(df)))


def point_score(df: DataFrame) -> DataFrame:
    """Requests (amount, hour, proba) to score, tier and text; cut at 100."""
    whole = F.col("TransactionAmt") == F.floor("TransactionAmt")
    s = F.least(F.lit(100.0), 70 * F.col("proba") + 10 * flag((F.col("hour") <= 6) | (F.col("hour") >= 23)) + 10 * flag(whole & (F.col("TransactionAmt") >= 500) & (F.col("hour") <= 6)) + 10 * flag(F.col("TransactionAmt") > 1000))
    return df.withColumn("risk_score", s).withColumn("risk_category", tier()).withColumn("risk_score", F.round(F.col("risk_score").cast("decimal(18,6)"), 1).cast("double"))


def feed_score(df: DataFrame) -> DataFrame:
    a, h = F.col("TransactionAmt"), F.col("hour")
    s = 10 + F.when(a > 5000, 25).when(a > 1000, 12).otherwise(0) + 18 * flag((h <= 5) | (h >= 23)) + 10 * flag((F.col("is_weekend") == 1) & (h <= 5)) + 15 * flag((F.col("ProductCD") == "W") & (a > 3000)) + 12 * flag(F.col("P_emaildomain") == "protonmail.com")
    return df.withColumn("feed_score", clip(s, 0, 100)).withColumn("feed_tier", tier("feed_score", (75, 55, 35), False))


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    y, p = F.col("isFraud") == 1, F.col("proba") > threshold
    t = df.agg(*(F.sum(flag(c)).cast("long").alias(n) for n, c in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p))))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return t.withColumn("precision", zero(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", zero(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("f1", zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def by_score(df: DataFrame) -> DataFrame:
    """Positives and negatives a distinct score, and their sums from the top."""
    g = df.where("proba IS NOT NULL").groupBy("proba").agg(F.sum("isFraud").cast("long").alias("pos"), F.sum(1 - F.col("isFraud")).cast("long").alias("neg"))
    return running(g, "proba", {"pos": "tp", "neg": "fp"}, down=True)


def roc_curve(df: DataFrame) -> DataFrame:
    g = by_score(df).crossJoin(F.broadcast(df.agg(F.sum("isFraud").alias("p"), F.sum(1 - F.col("isFraud")).alias("n"))))
    return g.select("proba", F.try_divide("fp", "n").alias("fpr"), F.try_divide("tp", "p").alias("tpr"))


def auc(df: DataFrame) -> DataFrame:
    g = by_score(df)
    return g.agg(F.try_divide(F.sum(F.col("pos") * (F.col("fp") - F.col("neg")) + F.col("pos") * F.col("neg") / 2), F.sum("pos") * F.sum("neg")).alias("below")).select((1 - F.col("below")).alias("auc"))


def with_rank(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the average rank of column among its equals, over the number of its values; null where it is null."""
    g = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_ties"))
    g = running(g, column, {"_ties": "_upto"}).select(column, (F.col("_upto") - (F.col("_ties") - 1) / 2).alias("_rank"))
    n = df.agg(F.count(column).alias("_n"))
    return df.join(g, column, "left").crossJoin(F.broadcast(n)).withColumn(name, F.try_divide("_rank", "_n")).drop("_rank", "_n")


def rank_normalised(df: DataFrame) -> DataFrame:
    """TransactionID, rank_norm. A row without a score stays, with a null rank, and isn't counted."""
    return with_rank(df, "proba", "rank_norm").select("TransactionID", "rank_norm")


def cost_threshold(df: DataFrame, fn_cost: float = 850.0, fp_cost: float = 25.0, review: float = 15.0, steps: int = 1000) -> DataFrame:
    """One row a threshold (0.01 to 0.99): scores fall to the last threshold they reach, and sums over the thresholds do the rest."""
    i = F.floor((F.col("proba") - 0.01) / (0.98 / (steps - 1)) + 1e-9).cast("int")
    h = df.withColumn("i", F.least(F.greatest(i, F.lit(-1)), F.lit(steps - 1))).groupBy("i").agg(F.sum("isFraud").alias("pos"), F.sum(1 - F.col("isFraud")).alias("neg"))
    grid = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("i"))
    total = df.agg(F.sum("isFraud").alias("p"))
    w = Window.orderBy(F.desc("i"))
    t = grid.join(h, "i", "left").fillna(0).withColumns({"tp": F.sum("pos").over(w), "fp": F.sum("neg").over(w)}).crossJoin(F.broadcast(total))
    return t.select("i", (F.lit(0.01) + F.col("i") * 0.98 / (steps - 1)).alias("threshold"), "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), ((F.col("p") - F.col("tp")) * fn_cost + F.col("fp") * fp_cost + (F.col("tp") + F.col("fp")) * review).alias("cost"))


def best_threshold(df: DataFrame) -> DataFrame:
    return cost_threshold(df).agg(F.min_by(F.struct("threshold", "tp", "fp", "fn", "cost"), F.struct("cost", "i")).alias("b")).select("b.*")


def tier_distribution(df: DataFrame) -> DataFrame:
    g = df.groupBy("risk_category").agg(F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(df.agg(F.count("*").alias("total")))).select("risk_category", "n", (100 * F.col("n") / F.col("total")).alias("pct"))


def rate_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg((100 * F.avg("isFraud")).alias("fraud_pct"), F.count("*").alias("n"))


def report_rollup(df: DataFrame) -> DataFrame:
    return df.rollup("ProductCD", "hour").agg(F.avg("isFraud").alias("fraud_rate"), F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def roi(df: DataFrame, n: float = 50e6, rate: float = 0.035) -> DataFrame:
    m = confusion(df)
    f, legit = n * rate, n * (1 - rate)
    flagged = F.lit(f) * F.col("recall") / F.greatest("precision", F.lit(0.01))
    cost = f * (1 - F.col("recall")) * 850 + (flagged - f * F.col("recall")) * 25 + flagged * 15
    base = f * 0.7 * 850 + legit * 0.05 * 25
    return m.select((F.lit(base) - cost).alias("savings"), ((F.lit(base) - cost) / base).alias("roi"))

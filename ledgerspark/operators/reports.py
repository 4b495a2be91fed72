"""Samples, analyst scores, blends and the tables behind reports, on scored transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, flag
from .decide import auc, explanations, with_rank
from .ordered import running
from .robust import quantiles

#: Fixed risk of a product, by its first letter.
PRODUCT_RISK = {"C": 0.117, "S": 0.059, "H": 0.048, "R": 0.038, "W": 0.020}
#: Fixed lower bounds of the heat map's amount bands.
BANDS = (0, 50, 200, 500, 1000, 5000, 10000)


def flagged_sample(df: DataFrame, n: int = 50) -> DataFrame:
    """The first n transactions of the two upper tiers."""
    return df.where(F.col("risk_category").isin("RED", "ORANGE")).orderBy("TransactionID").limit(n)


def random_sample(df: DataFrame, n: int, key: str = "TransactionID") -> DataFrame:
    """n rows without replacement: those with the smallest md5 of the key, the same on any partitioning."""
    return df.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def explained_sample(df: DataFrame, n: int = 5000) -> DataFrame:
    """Full reasons for n sampled rows, a short text for the others."""
    chosen = random_sample(df.select("TransactionID"), n).withColumn("_full", F.lit(True))
    short = F.concat(F.lit("Risk Score: "), F.format_string("%.0f", "risk_score"), F.lit(" | Category: "), F.col("risk_category"))
    return df.join(chosen, "TransactionID", "left").withColumn("explanation", F.when(F.col("_full"), explanations(df)).otherwise(short)).drop("_full")


def context_score(df: DataFrame) -> DataFrame:
    """An analyst's request (amount, user's average, hour, device and account flags, transactions a day) to a score,
    tier and reasons."""
    a, avg, h = F.col("TransactionAmt"), F.col("user_avg_amt"), F.col("hour")
    z = (a - avg) / F.greatest(avg * 0.5, F.lit(1.0))
    night, roundness = h <= 6, (a == F.floor(a)) & (a >= 500)
    p = reduce(lambda out, kv: out.when(F.col("ProductCD") == kv[0], kv[1]), PRODUCT_RISK.items(), F).otherwise(0.035)
    per_day = F.col("txns_24h")
    raw = F.least(z, F.lit(5.0)) * 8 + 12 * flag(night) + 15 * F.col("is_unusual_device") + 12 * F.col("is_shared_device") + 18 * F.col("is_new_account") + 8 * flag(roundness) + p * 100 + F.least(per_day / 10, F.lit(1.0)) * 15 + 6 * flag(a > 1000)
    df = df.withColumn("context_score", clip(raw, 0.0, 100.0))
    s = F.col("context_score")
    marks = [(z > 2, "AMT"), (night, "HOUR"), (F.col("is_unusual_device") == 1, "DEV"), (F.col("is_shared_device") == 1, "SHR"), (F.col("is_new_account") == 1, "NEW"), (roundness, "RND"), (p > 0.05, "CAT"), (per_day > 10, "VEL")]
    reasons = F.concat_ws(",", *(F.when(on, F.lit(m)) for on, m in marks))
    return df.withColumn("context_tier", F.when(s >= 71, "BLOCK").when(s >= 51, "BIOMETRIC").when(s >= 31, "PIN VERIFY").otherwise("APPROVE")).withColumn("context_reasons", F.when(reasons == "", "OK").otherwise(reasons))


def rank_weighted_blend(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """blend: the columns' average-tie ranks over n, weighted by the cubes of their AUCs; null where a score is."""
    weights = reduce(lambda x, y: x.crossJoin(y), (auc(df.select("isFraud", F.col(c).alias("proba"))).select((F.col("auc") ** 3).alias(f"_w_{c}")) for c in columns))
    out = df.select("TransactionID", "isFraud", *columns)
    for c in columns:
        out = with_rank(out, c, f"_r_{c}")
    total = sum(F.col(f"_w_{c}") for c in columns)
    blend = sum(F.col(f"_w_{c}") * F.col(f"_r_{c}") for c in columns) / total
    return out.crossJoin(F.broadcast(weights)).select("TransactionID", "isFraud", *columns, blend.alias("blend"))


def better_of(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row: which score has the greater AUC (the first on a tie), and both AUCs."""
    a, b = (auc(df.select("isFraud", F.col(c).alias("proba"))).withColumnRenamed("auc", f"auc_{c}") for c in (first, second))
    return a.crossJoin(b).withColumn("winner", F.when(F.col(f"auc_{second}") > F.col(f"auc_{first}"), second).otherwise(first))


def best_f1_threshold(df: DataFrame) -> DataFrame:
    """The first of the thresholds 0.30 to 0.69 with the greatest F1 (scores above it count), from sums a threshold step."""
    step = sum((flag(F.col("proba") > (30 + i) / 100) for i in range(40)), F.lit(0))  # how many thresholds a score is above
    h = df.groupBy(step.alias("step")).agg(F.sum("isFraud").alias("pos"), F.count("*").alias("n"))
    grid = df.sparkSession.range(40).select(F.col("id").alias("i"))
    t = grid.join(F.broadcast(h), F.col("step") > F.col("i"), "left").groupBy("i").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("flagged"))
    t = t.crossJoin(F.broadcast(df.agg(F.sum("isFraud").alias("p")))).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("flagged") + F.col("p")), F.lit(0.0)))
    best = t.agg(F.min_by(F.struct("i", "f1"), F.struct(-F.col("f1"), F.col("i"))).alias("b"))
    return best.select(F.when(F.col("b.f1") > 0, (30 + F.col("b.i")) / 100).otherwise(0.5).alias("threshold"), F.coalesce("b.f1", F.lit(0.0)).alias("f1"))


def histogram(df: DataFrame, column: str = "proba", bins: int = 50) -> DataFrame:
    """Counts and densities of equal-width bins by label; the last bin is closed."""
    ends = df.agg(F.min(column).alias("_mn"), F.max(column).alias("_mx"))
    width = F.when(F.col("_mx") > F.col("_mn"), (F.col("_mx") - F.col("_mn")) / bins).otherwise(1.0)
    b = F.least(F.floor((F.col(column) - F.col("_mn")) / width), F.lit(bins - 1)).cast("int")
    g = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(b.alias("bin"), "isFraud").agg(F.count("*").alias("n"), F.first(width).alias("_w"))
    total = df.where(F.col(column).isNotNull()).groupBy("isFraud").agg(F.count("*").alias("_t"))
    return g.join(F.broadcast(total), "isFraud").select("bin", "isFraud", "n", (F.col("n") / F.col("_t") / F.col("_w")).alias("density"))


def score_stats(df: DataFrame, column: str = "risk_score") -> DataFrame:
    s = F.col(column)
    one = df.agg(F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), (100 * F.avg(flag(s > 70))).alias("high_pct"), (100 * F.avg(flag(s <= 30))).alias("low_pct"), F.count(s).alias("n"))
    return one.crossJoin(F.broadcast(quantiles(df, column, 0.5, scale=16).select(F.col("q").alias("median"))))


def amount_band(amount: Column) -> Column:
    return sum((flag(amount >= b) for b in BANDS[1:]), F.lit(0))


def risk_heatmap(df: DataFrame) -> DataFrame:
    """band, hour, risk: the mean risk of each of 7 x 24 cells, 0 where none is; hottest and coldest mark the first such cell."""
    spark = df.sparkSession
    grid = spark.range(7).select(F.col("id").cast("int").alias("band")).crossJoin(spark.range(24).select(F.col("id").cast("int").alias("hour")))
    mean = df.where("TransactionAmt >= 0").groupBy(amount_band(F.col("TransactionAmt")).alias("band"), "hour").agg(F.avg("risk_score").alias("risk"))
    cells = grid.join(F.broadcast(mean), ["band", "hour"], "left").select("band", "hour", F.coalesce("risk", F.lit(0.0)).alias("risk"))
    at = F.col("band") * 24 + F.col("hour")
    ends = cells.agg(F.min_by(at, F.struct(-F.round("risk", 9), at)).alias("hot"), F.min_by(at, F.struct(F.round("risk", 9), at)).alias("cold"))
    return cells.crossJoin(F.broadcast(ends)).select("band", "hour", "risk", flag(at == F.col("hot")).alias("hottest"), flag(at == F.col("cold")).alias("coldest"))


def network_bands(df: DataFrame, column: str = "risk_score") -> DataFrame:
    s = F.col(column)
    return df.agg(*(F.sum(flag(c)).cast("long").alias(n) for n, c in (("low", s <= 40), ("medium", (s > 40) & (s <= 70)), ("high", s > 70))))


def model_leaderboard(df: DataFrame, columns: tuple[str, ...], threshold: float = 0.5) -> DataFrame:
    """model, auc, fp_per_1000 (of clean rows), specificity and is_best: a row a score column."""
    y = F.col("isFraud") == 1
    rows = []
    for c in columns:
        counts = df.agg(F.sum(flag(~y & (F.col(c) > threshold))).alias("fp"), F.sum(flag(~y)).alias("n"))
        rows.append(auc(df.select("isFraud", F.col(c).alias("proba"))).crossJoin(counts).select(F.lit(c).alias("model"), "auc", (1000 * F.try_divide("fp", "n")).alias("fp_per_1000"), (1 - F.try_divide("fp", "n")).alias("specificity")))
    every = reduce(DataFrame.unionByName, rows)
    best = every.agg(F.min_by("model", F.struct(-F.round("auc", 9), F.col("model"))).alias("best"))
    return every.crossJoin(F.broadcast(best)).withColumn("is_best", flag(F.col("model") == F.col("best"))).drop("best")


def drift_monitor(df: DataFrame, days: int = 7, column: str = "TransactionAmt", bins: int = 10) -> DataFrame:
    """period, auc of the score, status (under 0.95 critical, under 0.97 a warning; unknown where a period lacks fraud, clean rows or
    scores), psi: the shift of column against the first period, over bins of equal width between the first period's
    ends, shares floored at 0.0001."""
    df = df.withColumn("period", F.floor(F.col("TransactionDT") / (86400 * days)))
    first = df.crossJoin(F.broadcast(df.agg(F.min("period").alias("_first"))))
    ends = first.where("period = _first").agg(F.min(column).alias("_mn"), F.max(column).alias("_mx"))
    width = F.when(F.col("_mx") > F.col("_mn"), (F.col("_mx") - F.col("_mn")) / bins).otherwise(1.0)
    binned = first.crossJoin(F.broadcast(ends)).groupBy("period", "_first", clip(F.floor((F.col(column) - F.col("_mn")) / width), 0, bins - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = df.groupBy("period").agg(F.count("*").alias("t"))
    grid = total.crossJoin(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")))
    share = grid.join(F.broadcast(binned.drop("_first")), ["period", "bin"], "left").select("period", "bin", F.greatest(F.coalesce("n", F.lit(0)) / F.col("t"), F.lit(1e-4)).alias("share"))
    base = share.join(F.broadcast(df.agg(F.min("period").alias("period"))), "period").select("bin", F.col("share").alias("base"))
    psi = share.join(F.broadcast(base), "bin").groupBy("period").agg(F.sum((F.col("share") - F.col("base")) * F.log(F.col("share") / F.col("base"))).alias("psi"))
    scores = df.groupBy("period", "proba").agg(F.sum("isFraud").alias("pos"), F.sum(1 - F.col("isFraud")).alias("neg"))
    scores = running(scores.where("proba IS NOT NULL"), "proba", {"neg": "upto"}, keys=("period",)).withColumn("below", F.col("upto") - F.col("neg"))
    a = scores.groupBy("period").agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))
    status = F.when(F.col("auc").isNull(), "unknown").when(F.col("auc") < 0.95, "critical").when(F.col("auc") < 0.97, "warning").otherwise("ok")
    return psi.join(a, "period", "left").select("period", "auc", status.alias("status"), "psi")

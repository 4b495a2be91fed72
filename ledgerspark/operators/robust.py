"""Quantiles by histogram, conformal sets, robustness checks and row statistics of V columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw, flag


def quantiles(df: DataFrame, column: str, level: Column | float, keys: tuple[str, ...] = (), scale: int = 1 << 14) -> DataFrame:
    """keys and q, the linear quantile of column in each group; level may use n, the group's count of values.

    Values are counted in scale bins between the group's ends (on asinh, so that long tails spread), which locates the
    two ranks that matter; only the distinct values of their bins are then ordered, so nothing is sorted whole. Nulls are left out; a group without values has no row.
    """
    key = [F.col(k) for k in keys]
    rows = df.where(F.col(column).isNotNull()).select(*key, F.col(column).alias("_x"), F.asinh(column).alias("_y"))
    ends = rows.groupBy(*keys).agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi"))
    rows = rows.join(ends, list(keys)) if keys else rows.crossJoin(F.broadcast(ends))
    part = F.when(F.col("_hi") > F.col("_lo"), (F.col("_y") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    rows = rows.select(*key, "_x", F.floor(part * scale).alias("_b"))
    bins = rows.groupBy(*keys, "_b").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    bins = bins.withColumn("n", F.sum("c").over(w)).withColumn("before", F.sum("c").over(w.orderBy("_b")) - F.col("c"))
    bins = bins.withColumn("h", (F.col("n") - 1) * (F.lit(level) if isinstance(level, float) else level))
    holds = lambda r, start, c: (r >= start) & (r < start + c)
    low, high = F.floor("h"), F.ceil("h")
    bins = bins.where(holds(low, F.col("before"), F.col("c")) | holds(high, F.col("before"), F.col("c"))).select(*keys, "_b", "before", "h")
    values = rows.join(bins, [*keys, "_b"]).groupBy(*keys, "_b", "before", "h", "_x").agg(F.count("*").alias("c"))
    values = values.withColumn("at", F.col("before") + F.sum("c").over(Window.partitionBy(*keys, "_b").orderBy("_x")) - F.col("c"))
    ends = values.groupBy(*keys, "h").agg(F.max(F.when(holds(low, F.col("at"), F.col("c")), F.col("_x"))).alias("a"), F.max(F.when(holds(high, F.col("at"), F.col("c")), F.col("_x"))).alias("b"))
    return ends.select(*keys, (F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))).alias("q"))


def conformal_sets(df: DataFrame, calibration: Column, alpha: float = 0.05) -> DataFrame:
    """The input with prediction_set ('0', '1' or '0,1'), is_uncertain and confidence; calibration marks the rows that
    set the nonconformity threshold. Without such rows the set is the likelier class."""
    p = F.col("proba")
    cal = df.where(calibration).select(F.when(F.col("isFraud") == 1, 1 - p).otherwise(p).alias("score"))
    level = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"), F.lit(1.0))
    df = df.join(F.broadcast(quantiles(cal, "score", level)), F.lit(True), "left")
    fraud, legit = (1 - p) <= F.col("q"), p <= F.col("q")
    one = F.when(fraud & legit, "0,1").when(fraud, "1").when(legit, "0").when(p > 0.5, "1").otherwise("0")
    sure = F.when(fraud & ~legit, p).when(legit & ~fraud, 1 - p).otherwise(F.greatest(p, 1 - p))
    return df.withColumns({"prediction_set": one, "is_uncertain": flag(fraud & legit), "confidence": sure}).drop("q")


def conformal_summary(df: DataFrame) -> DataFrame:
    """Shares of certain and uncertain rows (they sum to 1) and the mean confidence."""
    share = lambda s: F.avg(flag(F.col("prediction_set") == s).cast("double"))
    return df.agg(share("1").alias("certain_fraud"), share("0").alias("certain_legit"), share("0,1").alias("uncertain"), F.avg("confidence").alias("mean_confidence"))


#: The thresholds of the stability check.
STEPS = [0.2 + 0.05 * i for i in range(13)]


def checked(df: DataFrame, metric: str, value: Column, least: float) -> DataFrame:
    return df.select(F.lit(metric).alias("metric"), value.alias("value"), F.lit(least).alias("pass_above"), flag(value > least).alias("passed"))


def catch_rates(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Recall on fraud of low amounts (median or below), by day and on usual devices; df has log_amount, is_night and is_unusual_device."""
    fraud = df.where("isFraud = 1")
    fraud = fraud.crossJoin(F.broadcast(quantiles(fraud, "log_amount", 0.5)))
    caught = flag(F.col("proba") > threshold)
    rate = lambda c: F.coalesce(F.avg(F.when(c, caught)), F.lit(0.0))
    r = fraud.agg(rate(F.col("log_amount") <= F.col("q")).alias("low"), rate(F.col("is_night") == 0).alias("day"), rate(F.col("is_unusual_device") == 0).alias("usual"))
    parts = (("low_amount_fraud_catch_rate", "low", 0.40), ("daytime_fraud_catch_rate", "day", 0.40), ("normal_device_fraud_catch_rate", "usual", 0.35))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"), F.lit(least).alias("pass_above"), flag(F.col(c) > least).alias("passed")) for m, c, least in parts)))
    return r.select(each.alias("x")).select("x.*")


def threshold_stability(df: DataFrame) -> DataFrame:
    """The least F1 within two steps of the best threshold, as a share of the best; one pass over the rows."""
    y, p = F.col("isFraud"), F.col("proba")
    sums = df.agg(F.sum(y).alias("pos"), *(F.sum(flag(p > t)).alias(f"f{i}") for i, t in enumerate(STEPS)), *(F.sum(flag(p > t) * y).alias(f"t{i}") for i, t in enumerate(STEPS)))
    f1 = F.array(*(F.coalesce(F.try_divide(2.0 * F.col(f"t{i}"), F.col("pos") + F.col(f"f{i}")), F.lit(0.0)) for i in range(len(STEPS))))
    s = sums.select(f1.alias("f1")).withColumn("best", F.array_max("f1")).withColumn("at", F.array_position("f1", F.col("best")).cast("int"))
    near = F.slice("f1", F.greatest(F.lit(1), F.col("at") - 2), F.least(F.lit(len(STEPS)), F.col("at") + 2) - F.greatest(F.lit(1), F.col("at") - 2) + 1)
    return checked(s, "threshold_stability", F.array_min(near) / F.greatest("best", F.lit(0.001)), 0.70)


def confidence_rate(df: DataFrame) -> DataFrame:
    """Share of fraud with a score above 0.6 or below 0.4."""
    r = df.where("isFraud = 1").agg(F.coalesce(F.avg(flag((F.col("proba") > 0.6) | (F.col("proba") < 0.4)).cast("double")), F.lit(0.0)).alias("r"))
    return checked(r, "confidence_rate", F.col("r"), 0.60)


def perturbation(df: DataFrame, score: Callable[[DataFrame], DataFrame], amount_share: float = 0.1, proba_noise: float = 0.05, key: str = "TransactionID") -> DataFrame:
    """risk_category, n, changed, changed_share, mean_shift, max_shift: what small noise on the inputs does to the scores, by the tier
    without it. score adds risk_score and risk_category; amounts move by up to amount_share of themselves and
    probabilities by up to proba_noise (within 0 and 1), by draws from the md5 of the key. Rows are scored twice where
    they are, so nothing is joined."""
    even = lambda salt: draw(key, salt) / float(2**31) - 1  # noqa: E731  from -1 to 1
    plain = score(df).withColumnsRenamed({"risk_score": "_score", "risk_category": "_tier"})
    moved = plain.withColumn("TransactionAmt", F.col("TransactionAmt") * (1 + amount_share * even("amount")))
    moved = moved.withColumn("proba", F.least(F.greatest(F.col("proba") + proba_noise * even("proba"), F.lit(0.0)), F.lit(1.0)))
    shift, other = F.abs(F.col("risk_score") - F.col("_score")), flag(F.col("risk_category") != F.col("_tier"))
    by = score(moved).groupBy(F.col("_tier").alias("risk_category"))
    return by.agg(F.count("*").alias("n"), F.sum(other).alias("changed"), F.avg(other).alias("changed_share"), F.avg(shift).alias("mean_shift"), F.max(shift).alias("max_shift"))


def robustness(df: DataFrame) -> DataFrame:
    return catch_rates(df).unionByName(threshold_stability(df)).unionByName(confidence_rate(df))


def robustness_report(df: DataFrame) -> DataFrame:
    return robustness(df).agg(F.sum("passed").alias("passed"), F.count("*").alias("total"), (100 * F.avg("passed")).alias("pct"))


def row_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, deviation, maximum, minimum and range over the columns, nulls filled with the column's median (counted
    before). Columns without any value stay null and are left out."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns))).alias("e")).select("e.*")
    med = quantiles(long, "x", 0.5, ("name",)).agg(*(F.max(F.when(F.col("name") == c, F.col("q"))).alias(f"_m_{c}") for c in columns))
    filled = F.array_compact(F.array(*(F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns)))
    nulls = sum((flag(F.col(c).isNull()) for c in columns), F.lit(0))
    out = df.crossJoin(F.broadcast(med)).withColumns({"v_nulls": nulls, "_v": filled})
    n, total = F.size("_v"), lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    out = out.withColumn("v_mean", F.try_divide(total(F.col("_v")), n))
    square = total(F.transform("_v", lambda x: (x - F.col("v_mean")) * (x - F.col("v_mean"))))
    out = out.withColumns({"v_std": F.sqrt(F.try_divide(square, n - 1)), "v_max": F.array_max("_v"), "v_min": F.array_min("_v"), "v_null_pct": F.col("v_nulls") / len(columns)})
    return out.withColumn("v_range", F.col("v_max") - F.col("v_min")).drop("_v", *(f"_m_{c}" for c in columns))

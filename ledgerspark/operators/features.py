"""Behavioural features of transactions: DataFrame in, DataFrame out, one exchange a key set.

Null keys: where a group statistic is looked up by one column, rows with a null key take the fill value; where the
key is a combination, null is a value like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw, flag, smoothed
from ..sources.store import written

#: Free mail providers.
FREE_MAIL = ("gmail.com yahoo.com hotmail.com outlook.com aol.com icloud.com mail.com ymail.com live.com msn.com protonmail.com gmx.com yahoo.co.jp "
             "yahoo.co.uk comcast.net cox.net sbcglobal.net verizon.net att.net bellsouth.net charter.net earthlink.net").split()  # fmt: skip
AMT, ID, DT, Y = "TransactionAmt", "TransactionID", "TransactionDT", "isFraud"


def exact_amount(name: str = AMT) -> Column:
    """An amount as a decimal, whose sums don't depend on the order of rows; null where that is not the same number (10 places at most,
    below 10**18)."""
    exact = F.col(name).try_cast("decimal(28,10)")
    return F.when(exact.cast("double") == F.col(name), exact)


def exact_mean(over=lambda c: c, name: str = AMT) -> Column:
    """The mean of amounts from their exact sum, or of doubles where an amount has no exact decimal. over: puts the aggregates over a window."""
    exact, n = over(F.sum(exact_amount(name))), over(F.count(name))
    return F.when(over(F.count(exact_amount(name))) < n, over(F.avg(name))).otherwise(F.try_divide(exact.cast("double"), n))


def look_up(df: DataFrame, keys: list[str], null_is_value: bool = False, source: DataFrame | None = None, **aggs: Column) -> DataFrame:
    """Joins group statistics of source (default df) back to the rows, aggregated once a key before the join. Null keys match none,
    unless null_is_value. A source that is written keeps the plan of many look-ups linear."""
    stats = (df if source is None else source).groupBy(*keys).agg(*(a.alias(n) for n, a in aggs.items()))
    if not null_is_value:
        return df.join(stats.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)), keys, "left")
    on = [df[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(stats.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *aggs), on, "left").drop(*(f"_k{i}" for i in range(len(keys))))


def with_rate(df: DataFrame, label: str = Y) -> DataFrame:
    """Adds the global label rate, a one-row aggregate."""
    return df.crossJoin(F.broadcast(df.agg(F.avg(label).alias("global_rate"))))


def fit_rate(df: DataFrame, fit: DataFrame | None = None, fold: str | None = None, name: str = "global_rate") -> DataFrame:
    """df with the label rate of the rows it is fitted on: fit, or (fold) the rows of other folds, or df itself."""
    if fold is None:
        return df.crossJoin(F.broadcast((df if fit is None else fit).agg(F.avg(Y).alias(name))))
    one = (df if fit is None else fit).groupBy(fold).agg(F.sum(Y).alias("_y"), F.count(Y).alias("_c"))
    total = one.agg(F.sum("_y").alias("_ty"), F.sum("_c").alias("_tc"))
    rest = one.crossJoin(F.broadcast(total)).select(F.col(fold).alias("_fold"), F.try_divide(F.col("_ty") - F.coalesce("_y", F.lit(0)), F.col("_tc") - F.col("_c")).alias(name))
    return df.join(F.broadcast(rest), F.col(fold).eqNullSafe(F.col("_fold")), "left").drop("_fold")  # a row a fold


def label_sums(df: DataFrame, keys: list[str], null_is_value: bool = False, fit: DataFrame | None = None, fold: str | None = None) -> DataFrame:
    """df with _t and _n: the label's sum and the number of rows with the same keys, among the rows of fit (default df), or with
    fold those of df in other folds, so that no row sees its own label. Keys that no such row has get 0 and 0; null
    keys too, unless null_is_value. One aggregate by key and fold, then a total a key less the own fold's."""
    by = [*keys, fold] if fold else keys
    stats = (df if fit is None else fit).groupBy(*by).agg(F.sum(Y).alias("_t"), F.count(Y).alias("_n"))
    if fold:
        every = Window.partitionBy(*keys)
        stats = stats.withColumns({c: F.sum(c).over(every) - F.coalesce(c, F.lit(0)) for c in ("_t", "_n")})
    stats = stats.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(by)), "_t", "_n")
    if not null_is_value:
        stats = stats.where(" AND ".join(f"_k{i} IS NOT NULL" for i in range(len(keys))))
    on = [(F.col(k).eqNullSafe(F.col(f"_k{i}")) if null_is_value or k == fold else F.col(k) == F.col(f"_k{i}")) for i, k in enumerate(by)]
    return df.join(stats, on, "left").drop(*(f"_k{i}" for i in range(len(by)))).fillna(0, ["_t", "_n"])


def left_join_identity(txn: DataFrame, identity: DataFrame) -> DataFrame:
    return txn.join(identity, ID, "left")


def null_shares(df: DataFrame) -> DataFrame:
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns))
    return shares.unpivot([], df.columns, "name", "null_share")


def amount_features(df: DataFrame) -> DataFrame:
    part = F.col(AMT) - F.floor(AMT)
    return df.withColumns({"log_amount": F.log1p(AMT), "sqrt_amount": F.sqrt(AMT), "amount_decimal": part, "is_round_amount": flag(part == 0)})


def time_features(df: DataFrame) -> DataFrame:
    hour, day = F.floor(F.col(DT) % 86400 / 3600).cast("int"), F.floor(F.col(DT) / 86400) % 7
    return df.withColumns({"hour": hour, "is_night": flag(hour.between(0, 6)), "day_of_week": day.cast("int"), "is_weekend": flag(day >= 5), "month_approx": F.floor(F.col(DT) / (86400 * 30)).cast("int")})


def behavioral_profile(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    df = look_up(df, ["card1"], source=source, user_avg_amt=exact_mean(), user_std_amt=F.stddev_samp(AMT), user_txn_count=F.count("*"), user_product_diversity=F.countDistinct("ProductCD"))
    df = df.withColumn("user_std_amt", F.coalesce("user_std_amt", F.lit(1.0)))
    return df.withColumn("amount_zscore", (F.col(AMT) - F.col("user_avg_amt")) / F.greatest("user_std_amt", F.lit(1.0))).withColumn("amount_to_mean_ratio", F.col(AMT) / F.greatest("user_avg_amt", F.lit(0.01)))


def account_flags(df: DataFrame, low: int = 5, high_amount: float = 500.0, round_from: float = 500.0) -> DataFrame:
    """Dormant, new-account and suspicious-round flags; needs behavioral_profile and amount_features."""
    few, one = F.col("user_txn_count") < low, F.col("user_txn_count") == 1
    return df.withColumns({"is_low_activity_user": flag(few), "dormant_high_value": flag(few & (F.col(AMT) > 2 * F.col("user_avg_amt"))), "is_new_account": flag(one),
                           "first_txn_high_value": flag(one & (F.col(AMT) > high_amount)), "is_suspicious_round": flag((F.col("is_round_amount") == 1) & (F.col(AMT) >= round_from))})


def sim_swap(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    df = look_up(df, ["card1"], source=source, user_device_count=F.countDistinct("DeviceInfo"), usual_device=F.mode("DeviceInfo", True))
    return df.withColumn("is_unusual_device", flag(F.col("DeviceInfo") != F.col("usual_device")))


def seasonal_baseline(df: DataFrame) -> DataFrame:
    """The mean amount of card and month and its ratio; the mean is exact, as ratios are often just at a bound or half a shown digit."""
    w = Window.partitionBy("card1", "month_approx")
    return df.withColumn("seasonal_avg", exact_mean(lambda c: c.over(w))).withColumn("amt_vs_seasonal", F.col(AMT) / F.greatest("seasonal_avg", F.lit(0.01)))


def merchant_risk(df: DataFrame, fit: DataFrame | None = None, fold: str | None = None) -> DataFrame:
    """Label rates of product and address, fitted on fit, on other folds, or on df."""
    fit = df if fit is None else fit
    df = fit_rate(df, fit, fold)
    for key, name in (("ProductCD", "product_fraud_rate"), ("addr1", "addr_fraud_rate")):
        df = label_sums(df, [key], fit=fit, fold=fold).withColumn(name, F.coalesce(F.try_divide("_t", "_n"), "global_rate")).drop("_t", "_n")
    return df.drop("global_rate")


def category_mismatch(df: DataFrame, diversity: int = 2, rate: float = 0.05) -> DataFrame:
    return df.withColumn("category_mismatch_risk", flag((F.col("user_product_diversity") <= diversity) & (F.col("product_fraud_rate") > rate)))


def shared_device(df: DataFrame, most: int = 2, source: DataFrame | None = None) -> DataFrame:
    df = look_up(df, ["DeviceInfo"], source=source, device_user_count=F.countDistinct("card1"), device_email_count=F.countDistinct("P_emaildomain"))
    return df.fillna(0, ["device_user_count", "device_email_count"]).withColumn("is_shared_device", flag(F.col("device_user_count") > most))


def email_features(df: DataFrame, fit: DataFrame | None = None, fold: str | None = None) -> DataFrame:
    """Provider kinds, cards a domain, and the domain's label rate, fitted on fit, on other folds, or on df."""
    free = F.col("P_emaildomain").isin(FREE_MAIL)
    if fit is None and fold is None:
        df = look_up(with_rate(df), ["P_emaildomain"], email_fraud_rate=F.avg(Y), email_user_count=F.countDistinct("card1"))
    else:
        df = look_up(df, ["P_emaildomain"], source=fit if fold is None else None, email_user_count=F.countDistinct("card1"))
        df = label_sums(fit_rate(df, fit, fold), ["P_emaildomain"], fit=df if fit is None else fit, fold=fold).withColumn("email_fraud_rate", F.try_divide("_t", "_n")).drop("_t", "_n")
    df = df.withColumns({"is_free_email": flag(free), "is_corporate_email": flag(~free)})
    return df.withColumn("email_fraud_rate", F.coalesce("email_fraud_rate", "global_rate")).fillna(0, ["email_user_count"]).drop("global_rate")


def network_lite(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    source = df if source is None else source
    df = look_up(df, ["addr1"], source=source, users_per_address=F.countDistinct("card1"), has_fraud_neighbor=F.max(Y)).fillna({"users_per_address": 1, "has_fraud_neighbor": 0})
    df = look_up(df, ["card4", "card5", "card6"], True, source, users_per_card_combo=F.countDistinct("card1"))
    return look_up(df, ["addr1", "hour"], True, source, txns_per_addr_hour=F.count("*"))


def uid_fraud_history(df: DataFrame, weight: float = 50.0, fit: DataFrame | None = None, fold: str | None = None) -> DataFrame:
    """uid_fraud_count and the smoothed uid_fraud_rate of card and address, fitted on fit, on other folds, or on df."""
    df = label_sums(fit_rate(df, fit, fold), ["card1", "addr1"], True, df if fit is None else fit, fold)
    return df.withColumn("uid_fraud_rate", smoothed(F.col("_t"), F.col("_n"), F.col("global_rate"), weight)).withColumnRenamed("_t", "uid_fraud_count").drop("_n", "global_rate")


def uid_windows(df: DataFrame) -> DataFrame:
    """Amount statistics and label counts of card and address, as windows."""
    w = Window.partitionBy("card1", "addr1")
    df = df.withColumns({"uid_mean": F.avg(AMT).over(w), "uid_std": F.coalesce(F.stddev_samp(AMT).over(w), F.lit(0.0)), "uid_max": F.max(AMT).over(w), "uid_min": F.min(AMT).over(w), "uid_count": F.count("*").over(w), "uid_fraud_count": F.sum(Y).over(w)})
    return df.withColumns({"uid_range": F.col("uid_max") - F.col("uid_min"), "uid_zscore": (F.col(AMT) - F.col("uid_mean")) / F.greatest("uid_std", F.lit(1.0)), "uid_ratio": F.col(AMT) / F.greatest("uid_mean", F.lit(0.01)), "uid_is_max": flag(F.col(AMT) >= 0.99 * F.col("uid_max"))})


def uid_profile(df: DataFrame, weight: float = 50.0) -> DataFrame:
    """Amount statistics and label history of card and address over df itself; uid_fraud_history has fitted histories."""
    return uid_windows(with_rate(df)).withColumn("uid_fraud_rate", smoothed(F.col("uid_fraud_count"), F.col("uid_count"), F.col("global_rate"), weight)).drop("global_rate")


def uid_diversity(df: DataFrame) -> DataFrame:
    return look_up(df, ["card1", "addr1"], True, uid_device_count=F.countDistinct("DeviceInfo"), uid_email_count=F.countDistinct("P_emaildomain"), uid_product_count=F.countDistinct("ProductCD"))


def uid2_profile(df: DataFrame) -> DataFrame:
    df = df.withColumn("_d1", F.coalesce(F.col("D1").cast("int"), F.lit(-1)))
    w = Window.partitionBy("card1", "addr1", "_d1")
    return df.withColumns({"uid2_count": F.count("*").over(w), "uid2_mean": F.avg(AMT).over(w)}).drop("_d1")


def uid_time_bins(df: DataFrame) -> DataFrame:
    """Counts and sums of card and address in bins of time. The amount spike (a day's sum over three times the mean) compares exact
    sums, as equal sides are frequent and sums of doubles would tell them apart by the order of rows."""
    df = df.withColumn("_exact", exact_amount())
    for name, size in (("1h", 3600), ("6h", 21600), ("24h", 86400)):
        w = Window.partitionBy("card1", "addr1", F.floor(F.col(DT) / size))
        df = df.withColumns({f"uid_count_{name}": F.count("*").over(w), f"uid_sum_{name}": F.sum(AMT).over(w)} | ({"_day": F.sum("_exact").over(w)} if name == "24h" else {}))
    uid = Window.partitionBy("card1", "addr1")
    df = df.withColumns({"_all": F.sum("_exact").over(uid), "_n": F.count(AMT).over(uid), "_fit": F.count("_exact").over(uid), "_mean": F.avg(AMT).over(uid)})
    spike = F.when(F.col("_fit") < F.col("_n"), F.col("uid_sum_24h") > 3 * F.col("_mean")).otherwise(F.col("_day") * F.col("_n") > 3 * F.col("_all"))
    df = df.withColumns({"uid_spike_1h": flag(F.col("uid_count_1h") >= 3), "uid_spike_24h": flag(F.col("uid_count_24h") >= 10), "uid_amount_spike": flag(spike), "uid_peak_hourly": F.max("uid_count_1h").over(uid)})
    return df.drop("_exact", "_day", "_all", "_n", "_fit", "_mean")


def frequency_encoding(df: DataFrame, columns: tuple[str, ...] = ("card1", "card2", "addr1", "addr2", "P_emaildomain", "R_emaildomain", "DeviceInfo", "ProductCD"), rare: float = 1e-4) -> DataFrame:
    columns = [c for c in columns if c in df.columns]
    df = df.crossJoin(F.broadcast(df.agg(*(F.count(c).alias(f"_n_{c}") for c in columns))))
    for c in columns:
        df = look_up(df, [c], **{f"{c}_freq": F.count("*")}).withColumn(f"{c}_freq", F.coalesce(F.col(f"{c}_freq") / F.col(f"_n_{c}"), F.lit(0.0))).withColumn(f"{c}_is_rare", flag(F.col(f"{c}_freq") < rare))
    return df.drop(*(f"_n_{c}" for c in columns))


def peer_deviation(df: DataFrame, peers: tuple[str, ...] = ("ProductCD", "card4", "addr1")) -> DataFrame:
    for p in peers:
        df = look_up(df, [p], _m=F.avg(AMT), _s=F.stddev_samp(AMT)).withColumn(f"dev_{p}", (F.col(AMT) - F.col("_m")) / (F.coalesce("_s", F.when(F.col("_m").isNotNull(), 1.0)) + 1)).drop("_m", "_s")
    there = F.array_compact(F.array(*(F.abs(f"dev_{p}") for p in peers)))
    total = F.aggregate(there, F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("peer_deviation", F.coalesce(F.try_divide(total, F.size(there)), F.lit(0.0))).withColumn("is_peer_outlier", flag(F.col("peer_deviation") > 2))


def target_encoding(df: DataFrame, columns: tuple[str, ...] = ("card1", "card2", "addr1", "addr2", "P_emaildomain"), weight: float = 50.0, fit: DataFrame | None = None, fold: str | None = None) -> DataFrame:
    """Smoothed label means of each column, fitted on fit, on other folds, or on df. Null and unseen values take the prior."""
    fit = df if fit is None else fit
    df = fit_rate(df, fit, fold)
    for c in [c for c in columns if c in df.columns]:
        df = label_sums(df, [c], fit=fit, fold=fold).withColumn(f"{c}_te", smoothed(F.col("_t"), F.col("_n"), F.col("global_rate"), weight)).drop("_t", "_n")
    return df.drop("global_rate")


def cross_fraud_rates(df: DataFrame, pairs=(("card1", "ProductCD"), ("card1", "addr1"), ("addr1", "P_emaildomain"), ("ProductCD", "P_emaildomain")), weight: float = 30.0, fit: DataFrame | None = None, fold: str | None = None) -> DataFrame:
    """Smoothed label means of pairs of columns, in which null is a value, fitted on fit, on other folds, or on df."""
    fit = df if fit is None else fit
    df = fit_rate(df, fit, fold)
    for a, b in pairs:
        df = label_sums(df, [a, b], True, fit, fold).withColumn(f"{a}_{b}_rate", smoothed(F.col("_t"), F.col("_n"), F.col("global_rate"), weight)).drop("_t", "_n")
    return df.drop("global_rate")


def entropy_diversity(df: DataFrame, bins: int = 10) -> DataFrame:
    df = df.crossJoin(F.broadcast(df.agg(F.min(AMT).alias("_mn"), F.max(AMT).alias("_mx"))))
    width = (F.col("_mx") - F.col("_mn")) / bins
    code = F.when(width > 0, F.greatest(F.ceil((F.col(AMT) - F.col("_mn")) / width), F.lit(1)) - 1).otherwise(F.lit(0))
    df = look_up(df.withColumn("_b", code), ["card1", "addr1"], True, amount_diversity=F.countDistinct("_b"), product_diversity=F.countDistinct("ProductCD"), hour_diversity=F.countDistinct("hour")).drop("_b", "_mn", "_mx")
    df = df.crossJoin(F.broadcast(df.agg(F.median("amount_diversity").alias("_m"))))
    return df.withColumn("is_high_diversity", flag(F.col("amount_diversity") > 2 * F.col("_m"))).drop("_m")


def by_time(*keys: str):
    return Window.partitionBy(*keys).orderBy(DT, ID)


def velocity(df: DataFrame) -> DataFrame:
    """Gaps, the count within 30 minutes among the last three rows, rolling sums and acceleration, a card."""
    w = by_time("card1")
    gap = lambda k: F.col(DT) - F.lag(DT, k).over(w)
    near = lambda k: F.coalesce((gap(k) < 1800).cast("int"), F.lit(0))
    prev = F.coalesce(F.lag(AMT).over(w), F.lit(0.0))
    df = df.withColumns({"time_since_last": F.coalesce(gap(1), F.lit(999999)), "txn_count_30min": 1 + near(1) + near(2), "rolling_sum_3": F.sum(AMT).over(w.rowsBetween(-2, 0)), "amount_acceleration": F.least(F.col(AMT) / F.greatest(prev, F.lit(0.01)), F.lit(100.0))})
    return df.withColumns({"hours_since_last": F.col("time_since_last") / 3600, "is_rapid_fire": flag(F.col("time_since_last") < 300)})


def uid_time_gap(df: DataFrame) -> DataFrame:
    gap = F.coalesce(F.col(DT) - F.lag(DT).over(by_time("card1", "addr1")), F.lit(-1))
    return df.withColumn("uid_gap", gap).withColumns({"uid_repeat_60": flag(F.col("uid_gap").between(0, 60)), "uid_burst_300": flag(F.col("uid_gap").between(0, 300))})


def lag_features(df: DataFrame) -> DataFrame:
    w = by_time("card1", "addr1")
    df = df.withColumn("prev_amount", F.coalesce(F.lag(AMT).over(w), F.col(AMT)))
    return df.withColumns({"amount_delta": F.col(AMT) - F.col("prev_amount"), "amount_ratio_prev": F.col(AMT) / (F.col("prev_amount") + 1), "time_since_prev": F.coalesce(F.col(DT) - F.lag(DT).over(w), F.lit(0)), "uid_rank": F.row_number().over(w) - 1})


def trailing_velocity(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("card1").orderBy(DT)
    return df.withColumns({f"trailing_{n}": F.count("*").over(w.rangeBetween(-s + 1, 0)) for n, s in (("1h", 3600), ("6h", 21600), ("24h", 86400))})


def missing_indicators(df: DataFrame, columns: tuple[str, ...] = ("card2", "addr1", "dist1", "P_emaildomain")) -> DataFrame:
    return df.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in columns})


def interactions(df: DataFrame, high: float = 500.0) -> DataFrame:
    """Products of flags; a column that df lacks counts as 0."""
    c = lambda n: F.col(n) if n in df.columns else F.lit(0)
    big = flag(F.col(AMT) > high)
    return df.withColumns({"amount_x_night": c("log_amount") * c("is_night"), "amount_x_weekend": c("log_amount") * c("is_weekend"), "round_x_night": c("is_suspicious_round") * c("is_night"), "round_x_new_device": c("is_suspicious_round") * c("is_unusual_device"),
                           "night_x_unusual_device": c("is_night") * c("is_unusual_device"), "dormant_x_night": c("is_low_activity_user") * c("is_night"), "new_acct_x_round": c("first_txn_high_value") * c("is_suspicious_round"), "rapid_fire_x_night": c("is_rapid_fire") * c("is_night"),
                           "rapid_fire_x_high_amt": c("is_rapid_fire") * big, "velocity_x_new_device": c("is_rapid_fire") * c("is_unusual_device"), "free_email_x_high_amt": c("is_free_email") * big, "fraud_neighbor_x_night": c("has_fraud_neighbor") * c("is_night"),
                           "shared_device_x_network": c("is_shared_device") * flag((F.col("users_per_address") if "users_per_address" in df.columns else F.lit(1)) > 5), "graph_fraud_comm_x_night": c("graph_community_fraud_rate") * c("is_night"),
                           "graph_fraud_comm_x_high_amt": c("graph_community_fraud_rate") * big, "graph_bridge_x_unusual_device": c("graph_is_bridge") * c("is_unusual_device"), "graph_fraud_neighbor_x_round": c("graph_fraud_neighbor_ratio") * c("is_suspicious_round")})


GRAPH = ("graph_community_fraud_rate", "graph_fraud_neighbor_ratio", "graph_is_bridge", "graph_betweenness")


def all_features(df: DataFrame) -> DataFrame:
    """df's rows, each once whatever its id, with every group's columns. The base rows are written once. Statistics a key are
    aggregated from them and joined by that key; windows come first, over rows that are dealt by card1, which serves the
    card, card and month, and card and address windows with one exchange."""
    base = written(time_features(amount_features(df)), "base")
    out = base.repartition("card1")
    for window in (velocity, seasonal_baseline, uid_windows):
        out = window(out)
    rate = fit_rate(out, base)
    out = rate.withColumn("uid_fraud_rate", smoothed(F.col("uid_fraud_count"), F.col("uid_count"), F.col("global_rate"), 50.0)).drop("global_rate")
    out = merchant_risk(behavioral_profile(out, base), fit=base)
    out = category_mismatch(account_flags(out))
    out = shared_device(sim_swap(out, base), source=base)
    return interactions(network_lite(email_features(out, fit=base), base))


CATEGORIES = ("card1", "card2", "card4", "card5", "card6", "ProductCD", "addr1", "addr2", "P_emaildomain", "R_emaildomain", "DeviceInfo", "DeviceType")


def initial_clean(df: DataFrame, columns: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Categories as strings; the text 'nan' is null."""
    return df.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit("nan")) for c in columns if c in df.columns})


#: Columns that stay however many nulls they have.
ESSENTIAL = ("DeviceInfo", "DeviceType", "P_emaildomain", "R_emaildomain", "TransactionID", "isFraud", "TransactionAmt", "TransactionDT", "card1", "card2", "card3", "card4", "card5", "card6", "ProductCD", "addr1", "addr2", "dist1")


def without_high_missing(df: DataFrame, keep: tuple[str, ...] = ESSENTIAL, most: float = 0.7) -> DataFrame:
    """df without the columns whose null share is over most, but for those to keep; the shares are one row."""
    others = [c for c in df.columns if c not in keep]
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("double")).alias(c) for c in others)).first()
    return df.drop(*(c for c in others if (shares[c] or 0.0) > most))


def in_fraud_address(df: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose address has any fraud, or those whose address has none (or is null)."""
    bad = df.where((F.col(Y) == 1) & F.col("addr1").isNotNull()).select("addr1").distinct()
    return df.join(bad, "addr1", "left_semi" if inside else "left_anti")


def device_imputation(df: DataFrame, own_share: float = 0.92, top: int = 100) -> DataFrame:
    """Fills null devices (imputed = 1): with own_share, one of the card's own rows' devices; else, or where the card has
    none, one of the top devices by their counts. Draws come from the md5 of the id. A card's rows are numbered and the
    draw joins by number, so no list of a card's devices is gathered."""
    known, empty = df.where("DeviceInfo IS NOT NULL"), df.where("DeviceInfo IS NULL").select(ID, "card1")
    numbered = known.select("card1", F.col("DeviceInfo").alias("own"), (F.row_number().over(Window.partitionBy("card1").orderBy("DeviceInfo", ID)) - 1).cast("long").alias("at"))
    size = known.groupBy("card1").agg(F.count("*").alias("n"))
    best = known.groupBy("DeviceInfo").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "DeviceInfo").limit(top)  # at most top rows are ordered and broadcast
    w = Window.orderBy(F.desc("c"), "DeviceInfo")
    best = best.select(F.col("DeviceInfo").alias("other"), (F.sum("c").over(w) - F.col("c")).alias("lo"), F.sum("c").over(w).alias("hi"))
    total = best.agg(F.max("hi").alias("total"))
    drawn = empty.join(size, "card1", "left").withColumn("mine", F.col("n").isNotNull() & (draw(ID, "share") < int(own_share * 2**32)))
    drawn = drawn.withColumn("at", F.when(F.col("mine"), F.pmod(draw(ID, "own"), F.col("n")))).crossJoin(F.broadcast(total)).withColumn("u", F.pmod(draw(ID, "other"), F.col("total")))
    filled = drawn.join(numbered, ["card1", "at"], "left").join(F.broadcast(best), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")), "left").select(ID, F.when(F.col("mine"), F.col("own")).otherwise(F.col("other")).alias("_device"))
    return df.join(filled, ID, "left").withColumn("imputed", F.col("DeviceInfo").isNull().cast("int")).withColumn("DeviceInfo", F.coalesce("DeviceInfo", "_device")).drop("_device")

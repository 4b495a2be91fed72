"""Scoring requests that arrive as JSON text: a declared schema, defaults, bounds, and an error in place of a score for bad rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag
from .decide import AUTH, auth_text, tier

SCHEMA = ("TransactionAmt double, ProductCD string, card1 long, card2 double, card4 string, card6 string, addr1 double, P_emaildomain string, DeviceInfo string, "
          "hour_of_day int, is_weekend int, probas map<string, double>, _bad string")  # fmt: skip
DEFAULTS = {"ProductCD": "W", "card1": 0, "hour_of_day": 12, "is_weekend": 0}
#: Domains that count as a reason.
RISKY_MAIL = ("protonmail.com", "anonymous.com")


def parsed(df: DataFrame, column: str = "body") -> DataFrame:
    """df with the request's fields, defaults filled in, and error: null, or what is wrong with the text, a field or a bound."""
    r = F.from_json(column, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = df.withColumn("_r", r)
    amount, hour = F.col("_r.TransactionAmt"), F.col("_r.hour_of_day")
    wrong = [
        (F.col(column).isNull(), "request: missing"),
        (F.col("_r").isNull() | F.col("_r._bad").isNotNull(), "request: not JSON of the declared fields"),
        (amount.isNull(), "TransactionAmt: missing"),
        (F.isnan(amount) | (F.abs(amount) == float("inf")), "TransactionAmt: not a number"),
        (amount < 0, "TransactionAmt: below 0"),
        (~hour.between(0, 23), "hour_of_day: not from 0 to 23"),
    ]
    error = reduce(lambda out, w: out.when(F.coalesce(w[0], F.lit(False)), w[1]), wrong, F)
    fields = {c.split()[0]: F.col(f"_r.{c.split()[0]}") for c in SCHEMA.split(", ") if " " in c and c.split()[0] != "_bad"}
    fields["probas"] = F.col("_r.probas")
    fields |= {c: F.coalesce(fields[c], F.lit(v)) for c, v in DEFAULTS.items()}
    return df.withColumn("error", error).withColumns({c: F.when(F.col("error").isNull(), v) for c, v in fields.items()}).drop("_r")


def reasons() -> Column:
    """Up to five factors as an array, or one that says there are none. The texts are fixed."""
    a, h, p = F.col("TransactionAmt"), F.col("hour_of_day"), F.col("fraud_probability")
    night, round_ = (h <= 6) | (h >= 23), (a == F.floor(a)) & (a >= 500) & (h <= 6)
    pct = F.format_string("%.1f", F.round(p * 100, 1))
    rules = [
        (night, F.format_string("Transaction at unusual hour (%d:00)", h)),
        (round_, F.format_string("Perfectly round high-value amount ($%,.0f) at night", a)),
        (a > 1000, F.format_string("High-value transaction ($%,.2f)", a)),
        (p > 0.5, F.concat(F.lit("ML models flag high fraud probability ("), pct, F.lit("%)"))),
        (F.col("P_emaildomain").isin(*RISKY_MAIL), F.concat(F.lit("High-risk email domain ("), F.col("P_emaildomain"), F.lit(")"))),
    ]
    found = F.array_compact(F.array(*(F.when(on, text) for on, text in rules)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No specific risk factors identified")))


def responses(df: DataFrame, column: str = "body") -> DataFrame:
    """df's rows with risk_score, risk_category, auth_recommendation, fraud_probability (the mean of the models that answered, 0.5
    without any), model_contributions (a map), top_risk_factors (an array) and error; a bad row has only its error."""
    df = parsed(df, column)
    # values of models that gave none are left out
    given = F.map_filter(F.coalesce("probas", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))), lambda k, v: v.isNotNull())
    df = df.withColumn("model_contributions", F.map_from_arrays(F.map_keys(given), F.transform(F.map_values(given), lambda v: F.round(v, 4))))
    total = F.aggregate(F.map_values(given), F.lit(0.0), lambda s, v: s + v)
    df = df.withColumn("_p", F.coalesce(F.try_divide(total, F.size(F.map_keys(given))), F.lit(0.5)))
    a, h = F.col("TransactionAmt"), F.col("hour_of_day")
    score = F.least(F.lit(100.0), 70 * F.col("_p") + 10 * flag((h <= 6) | (h >= 23)) + 10 * flag((a == F.floor(a)) & (a >= 500) & (h <= 6)) + 10 * flag(a > 1000))
    df = df.withColumn("fraud_probability", F.col("_p")).withColumn("risk_score", score).withColumn("risk_category", tier()).withColumn("auth_recommendation", auth_text())
    df = df.withColumn("auth_recommendation", F.when(F.col("risk_category") == "RED", AUTH["RED"].replace(" Explain reason.", "")).otherwise(F.col("auth_recommendation"))).withColumn("top_risk_factors", reasons())
    df = df.withColumns({"risk_score": F.round(F.col("risk_score").cast("decimal(18,6)"), 1).cast("double"), "fraud_probability": F.round("_p", 4)})
    made = ["risk_score", "risk_category", "auth_recommendation", "fraud_probability", "model_contributions", "top_risk_factors"]
    return df.withColumns({c: F.when(F.col("error").isNull(), F.col(c)) for c in made}).drop("_p")

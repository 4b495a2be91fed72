"""Result documents: metrics, threshold curve, conformal and robustness results as nested rows, written and read as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .decide import auc, best_threshold, confusion, cost_threshold
from .robust import conformal_sets, conformal_summary, quantiles, robustness

METRICS = "model_metrics map<string, struct<auc: double, f1: double, precision: double, recall: double, confusion_matrix: array<array<bigint>>>>"
THRESHOLD = "optimal_threshold double, optimal_cost double, default_cost double, confusion struct<tp: bigint, fp: bigint, fn: bigint, tn: bigint>, curve array<struct<threshold: double, cost: double>>"
CONFORMAL = "alpha double, threshold double, n bigint, shares map<string, double>, mean_confidence double, coverage double"
ROBUST = "tests map<string, struct<value: double, pass_above: double, passed: boolean>>, passed bigint, total bigint, overall_pct double"


def metrics_document(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One row: a map of score column to its metrics at 0.5, with the confusion matrix as rows of actual 0 and 1."""
    parts = []
    for c in columns:
        own = df.select("isFraud", F.col(c).alias("proba"))
        one = confusion(own).crossJoin(F.broadcast(auc(own)))
        matrix = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
        parts.append(one.select(F.lit(c).alias("name"), F.struct("auc", "f1", "precision", "recall", matrix.alias("confusion_matrix")).alias("v")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "v")))).alias("model_metrics"))  # an entry a score column


def threshold_document(df: DataFrame, every: int = 10) -> DataFrame:
    """One row: the cheapest threshold, its counts, the cost at 0.5, and each every-th point of the curve."""
    points = cost_threshold(df)
    curve = points.where(F.col("i") % every == 0).agg(F.array_sort(F.collect_list(F.struct("threshold", "cost"))).alias("curve"))
    default = points.where(F.col("threshold") >= 0.5).agg(F.min_by("cost", "i").alias("default_cost"))
    n = df.agg(F.count("*").alias("n"))
    best = best_threshold(df).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(default)).crossJoin(F.broadcast(curve))
    counts = F.struct("tp", "fp", "fn", (F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))
    return best.select(F.col("threshold").alias("optimal_threshold"), F.col("cost").alias("optimal_cost"), "default_cost", counts.alias("confusion"), "curve")


def conformal_document(df: DataFrame, calibration: Column, alpha: float = 0.05) -> DataFrame:
    """One row: the nonconformity threshold of the calibration rows and, over the others, shares of the sets and how many hold the label."""
    p = F.col("proba")
    level = F.least(F.ceil((F.col("n") + 1) * (1 - alpha)) / F.col("n"), F.lit(1.0))
    cut = quantiles(df.where(calibration).select(F.when(F.col("isFraud") == 1, 1 - p).otherwise(p).alias("score")), "score", level).agg(F.max("q").alias("threshold"))
    rest = conformal_sets(df, calibration, alpha).where(~calibration)
    cover = rest.agg(F.avg(F.contains("prediction_set", F.col("isFraud").cast("string")).cast("double")).alias("coverage"), F.count("*").alias("n"))
    one = conformal_summary(rest).crossJoin(F.broadcast(cover)).crossJoin(F.broadcast(cut))
    shares = F.create_map(*(x for c in ("certain_fraud", "certain_legit", "uncertain") for x in (F.lit(c), F.col(c))))
    return one.select(F.lit(alpha).alias("alpha"), "threshold", "n", shares.alias("shares"), "mean_confidence", "coverage")


def robustness_document(df: DataFrame) -> DataFrame:
    """One row: a map of check to its value, bound and outcome, and the totals."""
    entry = F.struct("metric", F.struct("value", "pass_above", (F.col("passed") == 1).alias("passed")))
    one = robustness(df).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("tests"), F.sum("passed").cast("long").alias("passed"), F.count("*").alias("total"))
    return one.withColumn("overall_pct", 100 * F.col("passed") / F.col("total"))


def stored(document: DataFrame, path: str, schema: str) -> DataFrame:
    """Writes documents as JSON and reads them by the declared schema; fields that don't fit it fail."""
    document.write.mode("overwrite").json(path)
    return read(document.sparkSession, path, schema)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)

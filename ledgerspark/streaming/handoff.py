"""What a batch fits and a stream uses: profiles, the batch maximum of the risk score, encoders and a model, in one folder.

A stream can't know the maximum of its batch, nor a card's history before it; both come from the fitted rows. Looking up
what isn't there gives 0, or 1 where a statistic is a divisor, as for a card that was never seen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import flag
from ..operators import decide as d
from ..operators import features as f

INPUTS = ["TransactionAmt", "log_amount", "hour", "is_night", "is_round_amount", "user_avg_amt", "amount_zscore", "product_fraud_rate", "is_unusual_device", "is_shared_device", "card4_code", "product_code"]
CODED = {"card4": "card4_code", "ProductCD": "product_code"}


@dataclass
class Fitted:
    """Loaded tables (a row a key), the maximum of the raw score, and the model if one was fitted."""

    cards: DataFrame
    products: DataFrame
    devices: DataFrame
    batch_max: float
    global_rate: float
    model: PipelineModel | None


def enriched(df: DataFrame, cards: DataFrame, products: DataFrame, devices: DataFrame, global_rate: float) -> DataFrame:
    """The columns that scores use, from the row itself and what was fitted; works on batches and streams."""
    df = f.time_features(f.amount_features(df))
    df = df.join(cards, "card1", "left").join(products, "ProductCD", "left").join(devices, "DeviceInfo", "left")
    df = df.fillna({"user_avg_amt": 0.0, "user_std_amt": 1.0, "user_txn_count": 0, "user_product_diversity": 0, "device_user_count": 0, "product_fraud_rate": global_rate})
    df = df.withColumns({"amount_zscore": F.when(F.col("user_txn_count") > 0, (F.col(f.AMT) - F.col("user_avg_amt")) / F.greatest("user_std_amt", F.lit(1.0))).otherwise(0.0), "is_unusual_device": flag(F.col("DeviceInfo") != F.col("usual_device")), "is_shared_device": flag(F.col("device_user_count") > 2)})
    df = f.category_mismatch(f.account_flags(df))
    return df.withColumn("round_x_new_device", F.col("is_suspicious_round") * F.col("is_unusual_device"))


def fit(df: DataFrame, path: str, with_model: bool = False) -> None:
    """Writes what later rows are scored with to path: cards, products, devices, scalars and, if asked for, a model with its encoders."""
    cards = df.groupBy("card1").agg(F.avg(f.AMT).alias("user_avg_amt"), F.coalesce(F.stddev_samp(f.AMT), F.lit(1.0)).alias("user_std_amt"), F.count("*").alias("user_txn_count"), F.countDistinct("ProductCD").alias("user_product_diversity"), F.mode("DeviceInfo", True).alias("usual_device"))
    tables = {"cards": cards, "products": df.groupBy("ProductCD").agg(F.avg(f.Y).alias("product_fraud_rate")), "devices": df.where("DeviceInfo IS NOT NULL").groupBy("DeviceInfo").agg(F.countDistinct("card1").alias("device_user_count"))}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = df.sparkSession
    read = [spark.read.parquet(f"{path}/{n}") for n in tables]
    rate = df.agg(F.avg(f.Y)).first()[0] or 0.0
    rows = enriched(df, *read, rate)
    rows.select(d.raw_score(rows).alias("raw")).agg(F.max("raw").alias("batch_max")).select(F.coalesce("batch_max", F.lit(0.0)).alias("batch_max"), F.lit(float(rate)).alias("global_rate")).write.mode("overwrite").json(f"{path}/scalars")
    if with_model:
        codes = [StringIndexer(inputCol=c, outputCol=o, handleInvalid="keep", stringOrderType="alphabetAsc") for c, o in CODED.items()]
        model = Pipeline(stages=[*codes, VectorAssembler(inputCols=INPUTS, outputCol="inputs"), GBTClassifier(featuresCol="inputs", labelCol="label", maxDepth=4, maxIter=10, seed=42)])
        model.fit(known(rows).withColumn("label", F.col(f.Y).cast("double"))).write().overwrite().save(f"{path}/model")


def known(df: DataFrame) -> DataFrame:
    return df.fillna("MISSING", list(CODED))


def load(spark: SparkSession, path: str, with_model: bool = False) -> Fitted:
    one = spark.read.schema("batch_max double, global_rate double").json(f"{path}/scalars").first()
    return Fitted(*(spark.read.parquet(f"{path}/{n}") for n in ("cards", "products", "devices")), one["batch_max"], one["global_rate"], PipelineModel.load(f"{path}/model") if with_model else None)


def scored(df: DataFrame, fitted: Fitted) -> DataFrame:
    """TransactionID, proba, risk_score, risk_category of batch or stream rows; with a model its probability, else the column proba."""
    rows = enriched(df, fitted.cards, fitted.products, fitted.devices, fitted.global_rate)
    if fitted.model is not None:
        rows = fitted.model.transform(known(rows).drop("proba")).withColumn("proba", vector_to_array("probability")[1])
    out = d.risk_score(rows, fitted.batch_max or 1.0).withColumn("risk_category", d.tier())
    return out.select(f.ID, "proba", "risk_score", "risk_category")

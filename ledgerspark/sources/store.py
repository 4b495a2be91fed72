"""Tables in the shared folder that cut lineage, and the sinks of scored transactions, reports and fitted pipelines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset (tests on one machine)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="ledgerspark-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, read back with their own schema."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sink_scored(df: DataFrame, path: str, form: str = "parquet") -> DataFrame:
    """Writes scored transactions in folders by tier and reads them back."""
    df.write.partitionBy("risk_category").mode("overwrite").option("header", True).format(form).save(path)
    return df.sparkSession.read.option("header", True).format(form).load(path)


def sink_json_report(df: DataFrame, path: str) -> DataFrame:
    """Writes a report, a JSON document a row, and reads it back."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def persisted(model: PipelineModel, path: str) -> PipelineModel:
    """Saves a fitted pipeline, its encoders and feature list included, and loads it again."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def scan_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """A CSV table with a header, read by its stated schema."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def as_documents(df: DataFrame, key: str = "TransactionID", rows: int = 1000) -> DataFrame:
    """Result documents: part, and up to rows rows as arrays, a column each."""
    return df.groupBy(F.floor(F.col(key) / rows).alias("part")).agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("rows")).select("part", *(F.col(f"rows.{c}").alias(c) for c in df.columns))


def scan_results_json(spark: SparkSession, path: str, schema, columns: list[str]) -> DataFrame:
    """Result documents of parallel arrays, a row an entry."""
    return spark.read.schema(schema).json(path).select(F.explode(F.arrays_zip(*columns)).alias("r")).select("r.*")

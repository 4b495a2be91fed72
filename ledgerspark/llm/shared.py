"""What every text operator uses: tables that cut lineage, folds and fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import written

__all__ = ["fold_of", "fragments", "held_out", "table", "written"]




def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds, equals 1. A null id counts as the text ''."""
    return fold_of(doc_id, folds) == 1


def fold_of(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds


def fragments(spark: SparkSession) -> int:
    """How many pieces a key space is cut into: grows with the shuffle partitions that the cluster is set to."""
    return max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))

"""Preparation of model inputs: codes, medians, scaling, finite values and minority oversampling."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import draw, finite_or_zero
from ..sources.store import written
from .neighbours import nearest
from .robust import quantiles


def label_encoded(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """c_code: the place of the value (null: 'MISSING') among the column's values in order of code points. For columns of few values."""
    df = df.withColumns({f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("MISSING")) for c in columns})
    coded = StringIndexer(inputCols=[f"_{c}" for c in columns], outputCols=[f"{c}_code" for c in columns], stringOrderType="alphabetAsc").fit(df).transform(df)
    return coded.drop(*(f"_{c}" for c in columns))


def median_imputed(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Nulls take the column's exact median (0 where it has no values); one pass finds the medians of all columns."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns))).alias("r")).select("r.*")
    one = quantiles(long, "x", 0.5, ("name",)).agg(*(F.max(F.when(F.col("name") == c, F.col("q"))).alias(f"_{c}") for c in columns))
    return df.crossJoin(F.broadcast(one)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_{c}"), F.lit(0.0)) for c in columns}).drop(*(f"_{c}" for c in columns))


def standard_scaled(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """c_scaled: centred and divided by the standard deviation over n (by 1 where it is 0)."""
    one = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    df = df.crossJoin(F.broadcast(one)).withColumns({f"{c}_scaled": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in columns})
    return df.drop(*(f"_{k}_{c}" for c in columns for k in "ms"))


def made_finite(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.withColumns({c: finite_or_zero(F.col(c)) for c in columns})


def oversampled(df: DataFrame, columns: tuple[str, ...], ratio: float = 0.15, neighbours: int = 5, key: str = "TransactionID") -> DataFrame:
    """synthetic, isFraud and columns: df's rows, and as many made minority rows as bring the minority to ratio of all.

    A made row lies between a minority row and one of its nearest neighbours among the minority, by distance of the
    scaled columns (a null counts as the mean and stays null where both rows have none). Rows with equal columns are
    one place: their neighbours are the nearest other places, so a made row repeats an original only where the minority
    has one place. Row r of the minority (by md5) is used once more than the next while rows are still wanted, so the
    count is exact. Draws come from md5."""
    own = df.where("isFraud = 1").select(key, *(F.col(c).cast("double").alias(c) for c in columns))
    sizes = df.agg(F.sum(F.when(F.col("isFraud") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("isFraud") == 0, 1).otherwise(0)).alias("neg"))
    want = sizes.select("pos", F.greatest(F.floor(F.col("neg") * (ratio / (1 - ratio))) - F.col("pos"), F.lit(0)).alias("want"))
    scaled = standard_scaled(own, columns).withColumn("_x", F.array(*(F.coalesce(f"{c}_scaled", F.lit(0.0)) for c in columns)))
    scaled = written(scaled.withColumn("_md5", F.md5(F.col(key).cast("string"))).select(key, "_x", "_md5", *columns), "minority")
    places = written(scaled.groupBy("_x").agg(F.min_by(F.struct(*columns), F.col("_md5")).alias("_at"), F.min("_md5").alias("_low")).select(F.col("_x").alias("x"), F.xxhash64("_x", "_low").alias("key"), "_at"), "places")
    near = nearest(places, neighbours).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "other"))).alias("_near"))  # neighbours a place
    # the place of a minority row by md5, from the counts of md5's first 3 digits: no task orders all of them
    lined = scaled.join(places.join(near, "key", "left").select(F.col("x").alias("_x"), "_near"), "_x").withColumn("_head", F.substring("_md5", 1, 3))
    heads = scaled.groupBy(F.substring("_md5", 1, 3).alias("_head")).agg(F.count("*").alias("_c"))
    heads = heads.select("_head", (F.sum("_c").over(Window.orderBy("_head")) - F.col("_c")).alias("_before"))  # 4,096 rows at most
    lined = lined.join(F.broadcast(heads), "_head").withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_head").orderBy("_md5", key)) - 1)
    times = F.when(F.col("pos") > 0, F.floor(F.col("want") / F.col("pos")) + F.when(F.col("_r") < F.col("want") % F.col("pos"), 1).otherwise(0)).otherwise(0)
    made = lined.crossJoin(F.broadcast(want)).withColumn("_times", times).where("_times > 0").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    made = made.withColumn("_id", F.concat_ws("-", F.col(key), F.col("_k")))
    made = made.withColumn("_other", F.get("_near", F.pmod(draw("_id", "near"), F.greatest(F.size("_near"), F.lit(1))).cast("int"))["other"])
    made = made.join(places.select(F.col("key").alias("_other"), "_at"), "_other", "left")
    step = draw("_id", "step") / float(2**32)

    def between(c: str) -> Column:
        mine, other = F.coalesce(F.col(c), F.col("_at")[c]), F.coalesce(F.col("_at")[c], F.col(c))
        return (mine + step * (other - mine)).alias(c)

    made = made.select(F.lit(1).alias("synthetic"), F.lit(1).alias("isFraud"), *(between(c) for c in columns))
    return df.select(F.lit(0).alias("synthetic"), F.col("isFraud").cast("int").alias("isFraud"), *(F.col(c).cast("double").alias(c) for c in columns)).unionByName(made)

"""Running sums over a global order, without a task that holds it all.

Rows are range-partitioned by the order and written with the number of their range; the ranges' sums, a row each, give
the offsets that are broadcast; a window inside each range does the rest. Rows that are equal in the order fall into
one range, so callers aggregate to distinct values first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written


def ranged(df: DataFrame, order: list) -> DataFrame:
    """df, written, with _range: the number of the row's range in the order, as many ranges as shuffle partitions."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: str | list[str], sums: dict[str, str], down: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with, for each column in sums, the running sum under its new name, in the order of by (down: from the top) within keys.
    Rows that are equal in keys and by all get the sum up to and with them; nulls of by come first, or last from the top."""
    by = [by] if isinstance(by, str) else list(by)
    order = [F.asc(k) for k in keys] + [F.desc(c) if down else F.asc(c) for c in by]
    placed, ranges = ranged(df, order), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    totals = placed.groupBy("_range").agg(*(F.sum(c).alias(f"_t_{c}") for c in sums))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums))  # a row a range
    inside = Window.partitionBy("_range").orderBy(*order)
    local = placed.repartitionByRange(ranges, "_range").withColumns({new: F.sum(c).over(inside) for c, new in sums.items()})
    out = local.join(F.broadcast(totals), "_range").withColumns({new: F.coalesce(F.col(new), F.lit(0)) + F.col(f"_b_{c}") for c, new in sums.items()})
    out = out.drop("_range", *(f"_b_{c}" for c in sums))
    if not keys:
        return out
    each = placed.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
    start = running(each, list(keys), {c: f"_s_{c}" for c in sums}).select(*(F.col(k).alias(f"_k_{k}") for k in keys), *((F.col(f"_s_{c}") - F.coalesce(c, F.lit(0))).alias(f"_s_{c}") for c in sums))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = out.join(start, same).withColumns({new: F.col(new) - F.col(f"_s_{c}") for c, new in sums.items()})
    return out.drop(*(f"_k_{k}" for k in keys), *(f"_s_{c}" for c in sums))

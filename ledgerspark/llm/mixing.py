"""Mixing sources to target weights by cube-method balanced sampling.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating. They share RATIO times the total size;
a source's target stops at CAP times its size and the excess goes to the others by weight, until none is above.

Sample: with rate r = target / source size, a document is taken floor(r) times for certain and once more with
inclusion probability p = r - floor(r). The extra copies come from the cube method: the vector of probabilities
moves along the null space of the balance constraints (document count and words of its source) until each is 0
or 1. It runs in blocks of about BLOCK documents; what a block leaves undecided (two documents at most)
meets that of other blocks in the next level, until one block a source is left; there the landing picks the
roundings that miss the words by least.

Rows equal in id, source and size are alike to the constraints, so moving along the null space between two of them ends
with floor(n p) taken, one open at most and the others not. They are counted before any block is made: one unit stands
for the open one, and the others come back by their count, REPEATS at a time.

Defined cases: null text has size 0 and takes 0; a null source is a source of its own; repeated rows are taken
or not each on their own; draws depend on the rows alone, so reruns agree; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

BLOCK = 2048
LANDING = 14
WEIGHTS = (5.0, 2.0, 1.0)
RATIO = 1.5
CAP = 2.0
SMALL = 100_000
REPEATS = 100_000  # rows that one row is expanded into at a time


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, source, size: number of words, runs outside ASCII white space."""

    def rows(batches):
        for b in batches:
            n = [len(x.as_buffer().to_pybytes().split()) if x.is_valid else 0 for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "size"])

    return documents.select("doc_id", "source", "text").mapInArrow(rows, "doc_id long, source string, size long")


def targets(by_source: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP) -> DataFrame:
    """by_source: source, source_size, ... one row each. Adds target. Sources are capped in the order of
    cap * size / weight; the level rises with each source that is capped and falls with each that should not be, so
    the right one is the highest."""
    one = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(one) - 1
    n = len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (rank % n + 1).cast("int"))
    t = by_source.withColumn("rank", rank).withColumn("w", w).withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("most") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    t = t.withColumn("level", (ratio * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    t = t.withColumn("level", F.max("level").over(every))
    return t.withColumn("target", F.least("most", F.col("level") * F.col("w"))).drop("rank", "w", "most", "level")


def flight(size: list[int], p: list[float], draw: random.Random) -> list[float]:
    """Moves p within the null space of (count, words) until at most two entries are fractional."""
    pool: list[int] = []
    eps = 1e-9
    for i in range(len(p)):
        if not eps < p[i] < 1 - eps:
            p[i] = float(round(p[i]))
            continue
        pool.append(i)
        if len(pool) < 3:
            continue
        a, b, c = pool
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - p[j]) / x if x > 0 else -p[j] / x for j, x in zip(pool, u) if x)
        down = min(p[j] / x if x > 0 else (p[j] - 1) / x for j, x in zip(pool, u) if x)
        move = up if draw.random() * (up + down) < down else -down
        for j, x in zip(pool, u):
            p[j] += move * x
            if p[j] < eps:
                p[j] = 0.0
            elif p[j] > 1 - eps:
                p[j] = 1.0
        pool = [j for j in pool if eps < p[j] < 1 - eps]
    return p


def landing(size: list[int], p: list[float], draw: random.Random) -> list[float]:
    """The last block of a source: LANDING units, evenly spread over the sizes, stay out of the flight; they and what
    the flight leaves are rounded so that words, then documents, miss by least."""
    wait = [i for i, x in sorted(enumerate(p), key=lambda y: (size[y[0]], y[0])) if 0 < x < 1]
    wait = sorted({wait[k * (len(wait) - 1) // (LANDING - 1)] for k in range(LANDING)}) if wait else []
    fly = [i for i in range(len(p)) if i not in set(wait)]
    for i, x in zip(fly, flight([size[i] for i in fly], [p[i] for i in fly], draw)):
        p[i] = x
    open_ = [i for i, x in enumerate(p) if 0 < x < 1]
    if open_:
        s, x = np.array([size[i] for i in open_]), np.array([p[i] for i in open_])
        z = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
        miss = np.abs(z @ s - s @ x) + 0.01 * s.mean() * np.abs(z.sum(1) - x.sum())
        for i, v in zip(open_, z[int(np.argmin(miss))].tolist()):
            p[i] = float(v)
    return p


def level(units: DataFrame) -> DataFrame:
    """One level: units (doc_id, source, size, target, source_size, sure, p, block, blocks) to the same with p decided but
    for two a block. A source with one block lands."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pd.util.hash_array(pdf["doc_id"].fillna(-1).to_numpy(np.int64))
        pdf = pdf.iloc[np.lexsort((pdf["size"].to_numpy(), pdf["doc_id"].fillna(-1).to_numpy(), key))]
        draw = random.Random(int(key.sum(dtype=np.uint64)))
        return pdf.assign(p=(landing if pdf["blocks"].iloc[0] == 1 else flight)(pdf["size"].tolist(), pdf["p"].tolist(), draw))

    return units.groupBy("source", "block").applyInPandas(run, units.schema)


def mix(documents: DataFrame, weights=WEIGHTS, ratio: float = RATIO, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per input row."""
    size = written(sizes(documents).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    by_source = size.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("docs"))
    by_source = written(targets(by_source, weights, ratio, cap), "mix-sources")
    n, most = by_source.agg(F.count("*"), F.max("docs")).first()
    side = F.broadcast(by_source) if n <= SMALL else by_source
    side = side.withColumnRenamed("source", "src")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = size.join(side, F.col("source").eqNullSafe(F.col("src"))).withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
    units = units.withColumn("sure", F.floor("rate")).withColumn("open", F.col("rows") * (F.col("rate") - F.col("sure"))).withColumn("whole", F.floor("open"))
    names = ["doc_id", "source", "size", "source_size", "target"]
    few = units.where("rows > 1").select(*names, "sure", "whole", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 2) / REPEATS))).alias("k")).repartition("doc_id", "size", "k")
    few = few.withColumn("i", F.explode(F.sequence(F.col("k") * REPEATS + 1, F.least((F.col("k") + 1) * REPEATS, F.col("rows") - 1))))
    others = few.select(*names, ((F.col("sure") + (F.col("i") <= F.col("whole")).cast("long")) * F.col("size")).alias("taken"))
    salt = F.xxhash64("doc_id", "size")
    units = units.select(*names, "sure", (F.col("open") - F.col("whole")).alias("p"), F.pmod(salt, F.ceil(F.col("docs") / block)).alias("block"), F.ceil(F.col("docs") / block).alias("blocks"))
    blocks = math.ceil((most or 1) / block)
    parts = []
    while True:
        got = written(level(units), "mix-level")
        parts.append(got.where("p IN (0, 1)"))
        if blocks == 1:
            break
        step = max(block // 2, 2)  # a block leaves two units at most
        blocks = math.ceil(blocks / step)
        units = got.where("p NOT IN (0, 1)").withColumn("block", F.floor(F.col("block") / step)).withColumn("blocks", F.ceil(F.col("blocks") / step))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    taken = (F.col("sure") + F.col("p").cast("long")) * F.col("size")
    return out.select(*names, taken.alias("taken")).unionByName(others)

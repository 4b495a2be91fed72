"""Communities by modularity: Louvain's local moves and contraction, as rounds of joins over written tables.

In a round each node looks at the communities of its neighbours, sums its weight to each and moves to the one with the
greatest gain, ties to the smallest name. All nodes of a round decide on the labels of the round before, so only the half
of them that a hash of node and round picks may move, and a node alone moves to another one alone only under a smaller
name; a labelling is kept only while modularity rises. Then communities become nodes, their edges are summed, and the
next level moves those, until a level gains nothing. Results depend on the graph alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written

LEAST = 1e-7  # gain of modularity that a round or a level needs
ROUNDS, LEVELS, PATIENCE = 20, 10, 2
FEW = 200_000  # rows that may be broadcast


def dealt(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df for a join by its key, dealt by that key unless it is known to have few rows. Tables by node are small as files and great as rows:
    a plan that goes by the size of files gathers them in the driver to broadcast them."""
    return df if rows is not None and rows <= FEW else df.hint("merge")


def weighted(edges: DataFrame) -> DataFrame:
    """src, dst, w in both directions, one row a pair, from src and dst (and w); a loop is one row with its weight once."""
    w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
    one = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), w.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    return one.unionByName(one.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def degrees(links: DataFrame) -> DataFrame:
    """node, k: the sum of weights, a loop counting twice."""
    return links.groupBy(F.col("src").alias("node")).agg(F.sum(F.when(F.col("src") == F.col("dst"), 2 * F.col("w")).otherwise(F.col("w"))).alias("k"))


def modularity_parts(links: DataFrame, labels: DataFrame, rows: int | None = None) -> DataFrame:
    """label, part: each community's share of the modularity of labels (node, label); they sum to it. rows: of labels, where known."""
    k = degrees(links)
    total = k.agg(F.sum("k").alias("m2"))
    both = links.join(dealt(labels.select(F.col("node").alias("src"), "label"), rows), "src").join(dealt(labels.select(F.col("node").alias("dst"), F.col("label").alias("other")), rows), "dst")
    inside = both.where("label = other").groupBy("label").agg(F.sum(F.when(F.col("src") == F.col("dst"), 2 * F.col("w")).otherwise(F.col("w"))).alias("inside"))
    size = k.join(dealt(labels, rows), "node").groupBy("label").agg(F.sum("k").alias("tot"))
    return size.join(dealt(inside, rows), "label", "left").crossJoin(F.broadcast(total)).select("label", (F.coalesce("inside", F.lit(0.0)) / F.col("m2") - (F.col("tot") / F.col("m2")) ** 2).alias("part"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of labels (node, label) on edges (src, dst and w); 0 without edges."""
    return modularity_parts(weighted(edges), labels).agg(F.coalesce(F.sum("part"), F.lit(0.0)).alias("modularity"))


def moved(links: DataFrame, state: DataFrame, m2: float, turn: int, rows: int | None = None) -> DataFrame:
    """state: node, label, k. The labels after one round. rows: of state, where known."""
    own = state.select(F.col("node").alias("src"), F.col("label").alias("own"), "k")
    near = links.where("src <> dst").join(dealt(state.select(F.col("node").alias("dst"), "label"), rows), "dst").groupBy("src", "label").agg(F.sum("w").alias("w"))
    # the own community is a choice too, also where no neighbour is in it
    near = near.unionByName(state.select(F.col("node").alias("src"), "label", F.lit(0.0).alias("w"))).groupBy("src", "label").agg(F.sum("w").alias("w"))
    size = state.groupBy("label").agg(F.sum("k").alias("tot"), F.count("*").alias("members"))
    c = near.join(dealt(own, rows), "src").join(dealt(size, rows), "label")
    stays = F.col("label") == F.col("own")
    gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / m2
    best = c.withColumn("gain", F.round(gain, 9)).groupBy("src").agg(F.max_by(F.struct("label", "gain", "members"), F.struct(F.col("gain"), stays.cast("int"), -F.col("label"))).alias("to"), F.max(F.when(stays, F.struct("gain", "members"))).alias("at"))
    turn_of = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
    alone = (F.col("at.members") == 1) & (F.col("to.members") == 1)
    goes = turn_of & (F.col("to.gain") > F.col("at.gain")) & (~alone | (F.col("to.label") < F.col("label")))
    return state.join(dealt(best.withColumnRenamed("src", "node"), rows), "node", "left").select("node", F.when(goes, F.col("to.label")).otherwise(F.col("label")).alias("label"), "k")


def total_of(parts: DataFrame) -> float:
    return parts.agg(F.sum("part")).first()[0] or 0.0


def level(links: DataFrame, m2: float) -> tuple[DataFrame, float, float]:
    """The best labels (node, label) that rounds of moves find, their modularity and that of the start."""
    state = written(degrees(links).select("node", F.col("node").alias("label"), "k"), "moves")
    rows = state.count()
    start = best = total_of(modularity_parts(links, state.select("node", "label"), rows))
    kept, idle = state, 0
    for turn in range(ROUNDS):
        state = written(moved(links, state, m2, turn, rows), "moves")
        now = total_of(modularity_parts(links, state.select("node", "label"), rows))
        if now > best + LEAST:
            kept, best, idle = state, now, 0
        else:
            idle += 1
            if idle >= PATIENCE:
                break
    return kept.select("node", "label"), best, start


def louvain(edges: DataFrame) -> DataFrame:
    """node, label: communities of the nodes that have edges, named by their smallest node."""
    links = written(weighted(edges), "links")
    m2 = degrees(links).agg(F.sum("k")).first()[0]
    names = None
    if not m2:
        return links.select(F.col("src").alias("node"), F.col("src").alias("label"))
    for _ in range(LEVELS):
        labels, best, start = level(links, m2)
        rows = labels.count()
        names = labels if names is None else names.select("node", F.col("label").alias("_at")).join(dealt(labels.select(F.col("node").alias("_at"), "label"), rows), "_at").select("node", "label")
        names = written(names, "names")
        if best <= start + LEAST:
            break
        up = links.where("src <= dst").join(dealt(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), rows), "src").join(dealt(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), rows), "dst")
        links = written(weighted(up.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")), "links")
    least = names.groupBy("label").agg(F.min("node").alias("name"))
    return names.join(dealt(least), "label").select("node", F.col("name").alias("label"))


def better_split(edges: DataFrame, whole: DataFrame, split: DataFrame) -> DataFrame:
    """node, label: by community of whole, either it or its pieces in split, whichever has the greater modularity."""
    links = written(weighted(edges), "links")
    rows = whole.count()
    of = split.join(dealt(whole.select("node", F.col("label").alias("whole")), rows), "node").select("label", "whole").distinct()
    pieces = modularity_parts(links, split, rows).join(dealt(of, rows), "label").groupBy("whole").agg(F.sum("part").alias("pieces"))
    gain = modularity_parts(links, whole, rows).withColumnRenamed("label", "whole").join(dealt(pieces, rows), "whole").where("pieces > part").select(F.col("whole").alias("label"), F.lit(True).alias("_split"))
    chosen = whole.join(dealt(gain, rows), "label", "left").join(dealt(split.select("node", F.col("label").alias("_piece")), rows), "node", "left")
    return chosen.select("node", F.when(F.col("_split"), F.coalesce("_piece", "label")).otherwise(F.col("label")).alias("label"))

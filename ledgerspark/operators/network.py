"""Graph of cards that share devices, addresses or rare e-mail domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from .modularity import better_split, dealt, louvain, modularity
from .robust import quantiles


def shared_edges(df: DataFrame, key: str, relation: str, most: int, reach: int, most_rows: int | None = None) -> DataFrame:
    """Edges between a card and the next reach cards of its group, for groups of 2 to most cards (and 2 to most_rows rows)."""
    if most_rows:
        df = df.join(dealt(df.where(F.col(key).isNotNull()).groupBy(key).count().where(f"count BETWEEN 2 AND {most_rows}").select(key)), key, "left_semi")
    members = df.where(F.col(key).isNotNull()).select(key, "card1").distinct()
    size = members.groupBy(key).count().where(f"count BETWEEN 2 AND {most}").select(key)
    ranked = members.join(dealt(size), key, "left_semi").withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("card1")))
    other = ranked.select(key, F.col("card1").alias("dst"), F.col("r").alias("r2"))
    return ranked.join(dealt(other), key).where(f"r2 - r BETWEEN 1 AND {reach}").select(F.col("card1").alias("src"), "dst", F.lit(relation).alias("relation")).distinct()


#: Relations in the order of their precedence: column, name, most cards and reach of a group, most rows of it.
RELATIONS = (("DeviceInfo", "shared_device", 20, 4, None), ("addr1", "shared_address", 15, 4, None), ("P_emaildomain", "shared_email", 10, 2, 100))


def graph_edges(df: DataFrame) -> DataFrame:
    """src < dst, relation: a pair keeps its first relation (device, then address, then a rare e-mail domain). A column that
    df lacks gives none."""
    found = [shared_edges(df, *r).withColumn("p", F.lit(i)) for i, r in enumerate(RELATIONS) if r[0] in df.columns]
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("src", "dst").agg(F.min_by("relation", "p").alias("relation"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degree_centrality(df: DataFrame) -> DataFrame:
    cards = df.select("card1").distinct()
    degree = both_ways(graph_edges(df)).groupBy(F.col("src").alias("card1")).agg(F.count("*").alias("degree"))
    n = cards.agg(F.count("*").alias("n"))
    return cards.join(degree, "card1", "left").fillna(0, ["degree"]).crossJoin(F.broadcast(n)).select("card1", "degree", F.coalesce(F.try_divide("degree", F.col("n") - 1), F.lit(0.0)).alias("centrality"))


def fraud_neighbors(df: DataFrame) -> DataFrame:
    bad = df.groupBy(F.col("card1").alias("dst")).agg(F.max("isFraud").alias("bad"))
    return both_ways(graph_edges(df)).join(bad, "dst").groupBy(F.col("src").alias("card1")).agg(F.sum("bad").alias("fraud_neighbors"), F.avg("bad").alias("fraud_neighbor_ratio"))


def clustering(df: DataFrame) -> DataFrame:
    """2 T / (d (d - 1)) of the cards with edges. Each edge leads from its card of lesser degree (ties: lesser card) to the other, and
    triangles are found once, from their least card, so a hub starts few wedges."""
    e = written(graph_edges(df).select("src", "dst"), "card-edges")
    d = both_ways(e).groupBy(F.col("src").alias("card1")).agg(F.count("*").alias("d"))
    both = e.join(d.select(F.col("card1").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("card1").alias("dst"), F.col("d").alias("dd")), "dst")
    low, high = F.struct(F.col("ds").alias("d"), F.col("src").alias("c")), F.struct(F.col("dd").alias("d"), F.col("dst").alias("c"))
    up = written(both.select(F.least(low, high)["c"].alias("src"), F.greatest(low, high)["c"].alias("dst")), "card-edges")
    wedge = up.join(up.select("src", F.col("dst").alias("other")), "src").where("dst < other")
    closed = up.select(F.least("src", "dst").alias("dst"), F.greatest("src", "dst").alias("other"))
    tri = wedge.join(closed, ["dst", "other"])
    t = tri.select(F.explode(F.array("src", "dst", "other")).alias("card1")).groupBy("card1").agg(F.count("*").alias("t"))
    return d.join(t, "card1", "left").select("card1", F.coalesce(F.try_divide(2 * F.coalesce("t", F.lit(0)), F.col("d") * (F.col("d") - 1)), F.lit(0.0)).alias("clustering"))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """edges: a, b. node, label: each node's smallest reachable node, by large and small stars in turn, which takes about
    log(longest chain) turns; each turn is a written table."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most):
        rows = now.count()
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(dealt(low, rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.join(dealt(large.groupBy("u").agg(F.min("v").alias("m")), rows), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "edges")
        if not now.groupBy("u").count().where("count > 1").head(1) and not now.join(dealt(now.select(F.col("v").alias("u")).distinct()), "u", "left_semi").head(1):
            roots = now.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
    raise RuntimeError("components did not settle")


def communities(df: DataFrame) -> DataFrame:
    """card1, community: the smallest card of its component; cards without edges are their own."""
    found = components(graph_edges(df).select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("node", "card1")
    return df.select("card1").distinct().join(dealt(found), "card1", "left").select("card1", F.coalesce("label", "card1").alias("community"))


def modular_communities(df: DataFrame) -> DataFrame:
    """card1, community: by modularity (Louvain), never worse than whole components; named by the smallest card; cards without
    edges are their own."""
    edges = written(graph_edges(df).select("src", "dst"), "card-edges")
    whole = written(components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "components")
    found = written(better_split(edges, whole, louvain(edges)), "louvain")
    return df.select("card1").distinct().join(dealt(found.withColumnRenamed("node", "card1")), "card1", "left").select("card1", F.coalesce("label", "card1").alias("community"))


def community_modularity(df: DataFrame, grouping=communities) -> DataFrame:
    """One row: how many communities grouping makes, and their modularity on the card graph."""
    c = written(grouping(df), "communities")
    return c.agg(F.countDistinct("community").alias("communities")).crossJoin(modularity(graph_edges(df).select("src", "dst"), c.select(F.col("card1").alias("node"), F.col("community").alias("label"))))


def community_stats(df: DataFrame, grouping=communities) -> DataFrame:
    """card1, community, its size and share of cards with fraud; grouping: communities or modular_communities."""
    bad = df.groupBy("card1").agg(F.max("isFraud").alias("bad"))
    c = written(grouping(df), "communities")
    stats = c.join(dealt(bad), "card1").groupBy("community").agg(F.count("*").alias("size"), F.avg("bad").alias("fraud_rate"))
    return c.join(dealt(stats), "community")


def pagerank(df: DataFrame, alpha: float = 0.85, rounds: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """card1, pagerank. Cards without edges spread their rank evenly. Stops when the sum of changes is under tolerance times the
    number of cards; a tolerance of 0 takes all rounds."""
    edges = written(both_ways(graph_edges(df)), "links")
    degree = edges.groupBy(F.col("src").alias("card1")).agg(F.count("*").alias("d"))
    n = df.select("card1").distinct().count()
    rank = written(df.select("card1").distinct().join(degree, "card1", "left").withColumn("pr", F.lit(1 / max(n, 1))), "ranks")
    for k in range(rounds):
        got = rank.join(edges, F.col("card1") == F.col("src")).groupBy(F.col("dst").alias("card1")).agg(F.sum(F.col("pr") / F.col("d")).alias("got"))
        loose = rank.where("d is null").agg(F.coalesce(F.sum("pr"), F.lit(0.0)).alias("loose"))
        new = rank.withColumnRenamed("pr", "old").join(got, "card1", "left").crossJoin(F.broadcast(loose))
        new = new.withColumn("pr", (1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)) if n else new.withColumn("pr", F.col("old"))
        if tolerance or k % 5 == 4:  # each written table ends the plan of the rounds before it
            new = written(new, "ranks")
        rank = new.select("card1", "d", "pr")
        if tolerance and (new.agg(F.sum(F.abs(F.col("pr") - F.col("old")))).first()[0] or 0.0) <= tolerance * n:
            break
    return rank.select("card1", F.col("pr").alias("pagerank"))


def betweenness(df: DataFrame, sources: int = 100) -> DataFrame:
    """card1, betweenness from sources cards chosen by hash: counts of shortest paths spread outwards a level a round, and shares
    of them are summed back, until no card is further away."""
    edges = written(both_ways(graph_edges(df)), "links")
    cards = df.select("card1").distinct()
    n = cards.count()
    start = cards.orderBy(F.xxhash64("card1"), "card1").limit(sources)
    levels = [written(start.select(F.col("card1").alias("s"), F.col("card1").alias("node"), F.lit(1.0).alias("paths")), "level")]
    seen = levels[0].select("s", "node")
    while True:
        step = levels[-1].join(edges, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = written(step.join(seen, ["s", "node"], "left_anti"), "level")
        if not level.head(1):
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "node"))
    share = levels[-1].withColumn("share", F.lit(0.0))
    every = share
    for level in levels[-2::-1]:
        below = share.select("s", F.col("node").alias("dst"), F.col("paths").alias("paths2"), F.col("share").alias("share2"))
        back = below.join(edges, "dst").join(level.withColumnRenamed("node", "src"), ["s", "src"]).groupBy("s", F.col("src").alias("node")).agg(F.sum(F.col("paths") / F.col("paths2") * (1 + F.col("share2"))).alias("share"))
        share = written(level.join(back, ["s", "node"], "left").select("s", "node", "paths", F.coalesce("share", F.lit(0.0)).alias("share")), "shares")
        every = every.unionByName(share)
    total = every.where("s <> node").groupBy(F.col("node").alias("card1")).agg(F.sum("share").alias("share"))
    scale = n / max(min(sources, n), 1) / max((n - 1) * (n - 2), 1)
    return cards.join(total, "card1", "left").select("card1", (F.coalesce("share", F.lit(0.0)) * scale).alias("betweenness"))


def bridges(df: DataFrame, sources: int = 100) -> DataFrame:
    """card1, betweenness, is_bridge: above the 95th percentile."""
    return bridge_flags(written(betweenness(df, sources), "betweenness"))


def bridge_flags(b: DataFrame) -> DataFrame:
    """card1, betweenness, is_bridge: strictly above the 95th percentile of all cards."""
    cut = quantiles(b, "betweenness", 0.95).select(F.col("q").alias("cut"))
    return b.crossJoin(F.broadcast(cut)).select("card1", "betweenness", (F.col("betweenness") > F.col("cut")).cast("int").alias("is_bridge"))


def graph_join_back(df: DataFrame) -> DataFrame:
    """The transactions with their card's graph features; cards without any get 0."""
    out = df.join(degree_centrality(df).select("card1", F.col("degree").alias("graph_degree")), "card1", "left")
    out = out.join(fraud_neighbors(df).select("card1", F.col("fraud_neighbors").alias("graph_fraud_neighbors"), F.col("fraud_neighbor_ratio").alias("graph_fraud_neighbor_ratio")), "card1", "left")
    return out.fillna(0, ["graph_degree", "graph_fraud_neighbors", "graph_fraud_neighbor_ratio"])


def fitted_community_rates(df: DataFrame, fit: DataFrame | None = None, fold: str | None = None) -> DataFrame:
    """df with community and community_rate: the share of its cards with fraud among the rows of fit, or with fold among the rows
    of df in other folds, so that no row's own label is in its rate. A card's fraud counts unless all of it lies in the
    left-out fold; members are all of df's cards. Communities, which no label enters, come from df."""
    c = written(communities(df), "communities")
    size = c.groupBy("community").agg(F.count("*").alias("_size"))
    own = (df if fit is None else fit).where("isFraud = 1").select("card1", *([fold] if fold else [])).distinct().join(c, "card1")
    bad = own.select("community", "card1").distinct().groupBy("community").agg(F.count("*").alias("_bad"))
    out = df.join(c.join(size.join(bad, "community", "left"), "community"), "card1", "left")
    if not fold:
        return out.withColumn("community_rate", F.coalesce("_bad", F.lit(0)) / F.col("_size")).drop("_bad", "_size")
    alone = own.groupBy("community", "card1").agg(F.count("*").alias("_folds"), F.first(fold).alias("_fold")).where("_folds = 1")
    alone = alone.groupBy(F.col("community").alias("_c"), "_fold").agg(F.count("*").alias("_only"))
    out = out.join(alone, (F.col("community") == F.col("_c")) & F.col(fold).eqNullSafe(F.col("_fold")), "left")
    rate = (F.coalesce("_bad", F.lit(0)) - F.coalesce("_only", F.lit(0))) / F.col("_size")
    return out.withColumn("community_rate", rate).drop("_c", "_fold", "_only", "_bad", "_size")


def community_rates(df: DataFrame) -> DataFrame:
    """The rate of each card's community, where it is over 0."""
    return community_stats(df).where("fraud_rate > 0").select("card1", F.col("fraud_rate").alias("community_rate"))


def chosen_cards(df: DataFrame, most: int = 50_000) -> DataFrame:
    """All cards where they are at most so many; else those with fraud, and of the rest those with the smallest md5 up to most."""
    cards = df.groupBy("card1").agg(F.max("isFraud").alias("bad"))
    bad = cards.where("bad = 1").select("card1")
    room = max(most - bad.count(), 0)
    clean = cards.select("card1").subtract(bad)
    return bad.unionByName(clean.orderBy(F.md5(F.col("card1").cast("string")), "card1").limit(room))


def with_graph(df: DataFrame) -> DataFrame:
    """The transactions with every graph column that scores and reasons use; cards without any get 0."""
    own = community_stats(df).select("card1", F.col("fraud_rate").alias("graph_community_fraud_rate"))
    own = own.join(bridges(df).select("card1", F.col("betweenness").alias("graph_betweenness"), F.col("is_bridge").alias("graph_is_bridge")), "card1", "left")
    return graph_join_back(df).join(own, "card1", "left").fillna(0, ["graph_community_fraud_rate", "graph_betweenness", "graph_is_bridge"])

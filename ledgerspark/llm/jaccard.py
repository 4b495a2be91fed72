"""Near-duplicate join on word shingles by vertical partitioning.

A document's set is its distinct SHINGLE-word shingles (64-bit hashes). Two documents link when
100 * intersection >= PERCENT * union. Documents with equal sets form a class; classes are joined.

The global order of shingles is by hash, with the frequent shingles last, by frequency.

1. Candidates. Linked sets share a shingle of their prefixes (the first n - ceil(t n) + 1 shingles in the global
   order). At the first one that they share, neither has more than what is left of the shorter rest to share, so a
   pair is possible only if both rests hold the overlap that a link needs (and the sizes allow one). Classes that
   share a prefix shingle form a group. A small group gives all its possible pairs; a large one gives each class with
   the group's hub, the class with the fewest shingles before the group's. Groups of shingles in HUGE documents or more
   are never gathered: their rows are dealt by class and their hubs found by a combined minimum. Bitmaps of the sets
   bound each pair's overlap from above and rule most of the unlike ones out.
2. Overlaps. The global order is cut into CUTS fragments; the overlap of a pair is counted in each of them apart and
   summed per pair.
3. The rest. Classes of a large group that are not in the hub's component are a query set against their group: every
   possible pair between components is tried. So no link between components is lost, and a group of copies costs as
   many pairs as it has members.

Defined cases: null, empty or wordless text has an empty set and links with nothing, not even its like; fewer words
than SHINGLE make one shingle; repeated rows are copies of each other; a row with a null doc_id is a component of its
own, or takes the smallest id of its component. Set identity is a 64-bit hash. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .graph import components
from .shared import fragments, written

SHINGLE, PERCENT = 5, 75
HOT = 200_000  # most shingles in the broadcast table of frequent ones (16 bytes each); it only orders, it drops nothing
LOCAL = 4  # a task reports shingles that it sees in so many documents
GROUP = 4  # groups up to this size give all pairs at once
HUGE = 5_000  # frequent shingles counted in so many documents have their groups dealt by class
CUTS = 4  # fragments of the order in which overlaps are counted
SMALL = 200_000  # rows of two longs that may be broadcast


def sets(t: tk.Texts) -> list[np.ndarray]:
    """Each text's sorted distinct shingles."""
    start, end, own = t.words()
    words = t.runs(t.prefix(True), start, end)
    g, at = tk.grams(words, own, SHINGLE)
    out = []
    for i in range(t.n):
        if at[i + 1] > at[i]:
            out.append(np.unique(g[at[i] : at[i + 1]]))
        elif own[i + 1] > own[i]:
            h = tk.U(0)
            for w in words[own[i] : own[i + 1]]:
                h = np.bitwise_xor(tk.mix(np.array([h], np.uint64) + w)[0], tk.U(own[i + 1] - own[i]))
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    return int(tk.mix(np.array([tk.mix(s).sum(dtype=np.uint64) + tk.U(len(s))], np.uint64)).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each shingle's residue, in 2,048 bits, or 16,384 for large sets."""
    size = 2048 if len(s) <= 1500 else 16384
    bits = np.zeros(size, bool)
    bits[(tk.mix(s) & tk.U(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def possible(pairs: DataFrame, size: DataFrame) -> DataFrame:
    """The pairs whose bitmaps allow a link: each bit of one set that the other lacks is at least one shingle that it
    lacks, so the overlap has an upper bound, and a pair below what a link needs is out."""

    def rows(batches):
        for b in batches:
            na, nb = (b.column(i).to_numpy() for i in (2, 4))
            keep = np.ones(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(3), b.column(5))):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                if len(x) != len(y):
                    m = min(len(x), len(y))
                    x, y = (np.bitwise_or.reduce(z.reshape(-1, m), 0) for z in (x, y))
                most = min(na[i] - int(np.bitwise_count(x & ~y).sum()), nb[i] - int(np.bitwise_count(y & ~x).sum()))
                keep[i] = most >= needed(na[i], nb[i])
            yield b.select([0, 1]).filter(pa.array(keep))

    a, b = (size.select(F.col("c").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "bitsa", "nb", "bitsb").mapInArrow(rows, "a long, b long")


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def surveyed(documents: DataFrame) -> DataFrame:
    """kind 0: doc_id, n, c (class; null for an empty set), key of the text. kind 1: a shingle that one task saw in LOCAL documents or more, and in how many."""

    def rows(batches):
        seen, lists = [], []
        for part, t in tk.pieces(batches, "text"):
            s = sets(t)
            n = np.array([len(x) for x in s])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int8)), part.column(0), pa.array(n), pa.array([class_of(x) if len(x) else None for x in s], pa.int64()), pa.array(list(map(bitmap, s)), pa.binary()), part.column("key")], ["kind", "a", "n", "c", "bits", "key"])
            lists.extend(s)
            if len(lists) > 4000:  # keeps the counts of shingles seen twice or more
                seen.append(counted(lists))
                lists = []
        seen.append(counted(lists))
        k, c = np.concatenate([x for x, _ in seen]), np.concatenate([x for _, x in seen])
        u, inv = np.unique(k, return_inverse=True)
        c = np.bincount(inv, c, len(u)).astype(np.int64)
        u, c = u[c >= LOCAL], c[c >= LOCAL]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(u), np.int8)), pa.array(u.view(np.int64)), pa.array(c), pa.array(np.zeros(len(u), np.int64)), pa.nulls(len(u), pa.binary()), pa.nulls(len(u), pa.int64())], ["kind", "a", "n", "c", "bits", "key"])

    return documents.select("doc_id", text_key().alias("key"), "text").mapInArrow(rows, "kind byte, a long, n long, c long, bits binary, key long")


def counted(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, c = np.unique(np.concatenate(lists) if lists else np.zeros(0, np.uint64), return_counts=True)
    return u[c > 1], c[c > 1]


class Order:
    """The global order: frequent shingles (rows of shingle and count, most frequent first) come last."""

    def __init__(self, rows: list[tuple[int, int]]):
        keys = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        by = np.argsort(keys)
        self.keys, self.rank = keys[by], np.arange(len(keys), dtype=np.uint64)[::-1][by]
        self.huge = tk.U((1 << 63) + sum(r[1] < HUGE for r in rows))  # places from here on are those of huge groups
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.keys >> tk.U(44)).astype(np.int64)] = True

    def sorted(self, s: np.ndarray) -> np.ndarray:
        """The places of sorted shingles in the global order, ascending: half the hash; behind 2**63, the rank."""
        place = s >> tk.U(1)
        maybe = np.flatnonzero(self.gate[(s >> tk.U(44)).astype(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)
        if not len(maybe):
            return place
        i = np.minimum(np.searchsorted(self.keys, s[maybe]), len(self.keys) - 1)
        on = self.keys[i] == s[maybe]
        if not on.any():
            return place
        return np.concatenate((np.delete(place, maybe[on]), np.sort(self.rank[i[on]]) + tk.U(1 << 63)))


def needed(n, m):
    """The least overlap of linked sets of n and m."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


def prefix_rows(documents: DataFrame, order, pieces: int) -> DataFrame:
    """f (fragment), tokens, c (class), n (its size), rest (its shingles from the token on): packed, a row per fragment and some
    megabytes of text. Fragments hold whole groups; those from pieces on hold huge groups' rows by class."""

    def rows(batches):
        for _, t in tk.pieces(batches, "text", 4 << 20):
            known = {}
            for x in sets(t):
                if len(x):
                    known.setdefault(class_of(x), x)  # copies at hand count once
            if not known:
                continue
            size = np.array([len(x) for x in known.values()], np.uint32)
            long = (size - (-(-PERCENT * size.astype(np.int64) // 100)) + 1).astype(np.int64)
            tok = np.concatenate([order.value.sorted(x)[:p] for x, p in zip(known.values(), long)])
            c, n = np.repeat(np.array(list(known), np.int64), long), np.repeat(size, long)
            rest = n - (np.arange(len(tok)) - np.repeat(np.cumsum(long) - long, long)).astype(np.uint32)
            huge = tok >= order.value.huge
            frag = (tk.mix(np.where(huge, c.view(np.uint64), tok)) % tk.U(pieces)).astype(np.int32) + np.int32(pieces) * huge
            out = tk.packed_by(frag, 2 * pieces, tok, c, n, rest)
            yield tk.batch_of(out, [pa.int32(), *[pa.binary()] * 4], ["f", "tokens", "c", "n", "rest"])

    return documents.select("text").mapInArrow(rows, "f int, tokens binary, c binary, n binary, rest binary")


def candidates(packed: DataFrame, order, pieces: int) -> DataFrame:
    """kind 0: a possible pair of classes a < b. kind 1: class a, of size n, with rest, is in the large group of token, whose
    hub is b. kind 2: the like of kind 1 for a huge group; its hub is not yet known."""
    names = ["kind", "a", "b", "token", "n", "rest"]

    def members(kind, a, b, token, n, rest):
        for k in range(0, len(a), 100_000):
            part = [x[k : k + 100_000] for x in (a, b, token.view(np.int64), n, rest)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int8)), *map(pa.array, part)], names)

    def rows(batches):
        cols = [[] for _ in range(4)]
        for b in batches:
            for r in zip(*(b.column(i) for i in range(1, 5))):
                for col, x, d in zip(cols, r, (np.uint64, np.int64, np.uint32, np.uint32)):
                    col.append(np.frombuffer(x.as_buffer(), d))
        if not cols[0]:
            return
        tok = np.concatenate(cols[0])
        by = np.argsort(tok)
        same = tok[by][1:] == tok[by][:-1]
        keep = tok >= order.value.huge  # else shared by two rows or more
        keep[by[1:][same]] = True
        keep[by[:-1][same]] = True
        tok = tok[keep]
        c, n, rest = (np.concatenate(x)[keep] for x in cols[1:])
        n, rest = n.astype(np.int64), rest.astype(np.int64)
        by = np.lexsort((c, n - rest, tok))  # the hub comes first
        tok, c, n, rest = (x[by] for x in (tok, c, n, rest))
        new = np.ones(len(tok), bool)  # one row a token and class
        new[1:] = (tok[1:] != tok[:-1]) | (c[1:] != c[:-1])
        tok, c, n, rest = (x[new] for x in (tok, c, n, rest))
        huge = int(np.searchsorted(tok, order.value.huge))
        yield from members(2, c[huge:], np.zeros(len(c) - huge, np.int64), tok[huge:], n[huge:], rest[huge:])
        tok, c, n, rest = (x[:huge] for x in (tok, c, n, rest))
        start = np.flatnonzero(np.diff(tok, prepend=~tok[:1]))
        count = np.diff(np.append(start, len(tok)))
        pairs = []
        for m in range(2, GROUP + 1):
            s = start[count == m]
            pairs += [(s + i, s + j) for i in range(m) for j in range(i + 1, m)]
        large = np.flatnonzero(np.repeat(count > GROUP, count))
        hub = np.repeat(start, count)
        pairs.append((hub[large], large))
        a, b = (np.concatenate(x) for x in zip(*pairs))
        lo, hi = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        fits = (a != b) & (100 * lo >= PERCENT * hi) & (np.minimum(rest[a], rest[b]) >= needed(lo, hi))
        two = np.unique(np.sort(np.stack((c[a[fits]], c[b[fits]]), 1), 1), axis=0)
        none = np.zeros(len(two), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(none.astype(np.int8)), *(pa.array(np.ascontiguousarray(x)) for x in (two[:, 0], two[:, 1], none, none, none))], names)
        yield from members(1, c[large], c[hub[large]], tok[large], n[large], rest[large])

    return packed.repartition(pieces, "f").mapInArrow(rows, "kind byte, a long, b long, token long, n long, rest long")


def with_hubs(huge: DataFrame) -> DataFrame:
    """The rows of huge groups with their hub b, its size nb and its rest restb."""
    hub = huge.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("rest")).alias("before"), F.col("a").alias("b"), F.col("n").alias("nb"), F.col("rest").alias("restb"))).alias("hub"))
    return huge.join(F.broadcast(hub), "token").select("token", "a", "n", "rest", "hub.b", "hub.nb", "hub.restb")  # at most HOT hubs


def segments(documents: DataFrame, reps: DataFrame, order) -> DataFrame:
    """c, f, s: each wanted class's shingles in each of CUTS fragments of the order (the last holds the frequent ones)."""
    pivots = np.array([(1 << 63) // (CUTS - 1) * i for i in range(1, CUTS - 1)] + [1 << 63], np.uint64)

    def rows(batches):
        for part, t in tk.pieces(batches, "text"):
            out = []
            for k, x in zip(part.column(0).to_pylist(), sets(t)):
                x = order.value.sorted(x)
                cut = [0, *np.searchsorted(x, pivots).tolist(), len(x)]
                out += [(k, i, x[cut[i] : cut[i + 1]].tobytes()) for i in range(CUTS) if cut[i + 1] > cut[i]]
            yield tk.batch_of(out, [pa.int64(), pa.int32(), pa.binary()], ["c", "f", "s"])

    reps = F.broadcast(reps) if reps.count() <= SMALL else reps
    return documents.select(text_key().alias("key"), "text").join(reps, "key").dropDuplicates(["c"]).select("c", "text").mapInArrow(rows, "c long, f int, s binary")


def linked(pairs: DataFrame, segs: DataFrame, size: DataFrame) -> DataFrame:
    """The pairs that link: overlaps are counted in each fragment and summed per pair."""

    def rows(batches):
        for b in batches:
            got = []
            for x, y in zip(b.column(2), b.column(3)):
                m = np.sort(np.concatenate([np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y)]))
                got.append(int((m[1:] == m[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.int64())], ["a", "b", "part"])

    joined = pairs.join(segs.withColumnRenamed("c", "a").withColumnRenamed("s", "x"), "a").join(segs.withColumnRenamed("c", "b").withColumnRenamed("s", "y"), ["b", "f"]).select("a", "b", "x", "y")
    both = joined.mapInArrow(rows, "a long, b long, part long").groupBy("a", "b").agg(F.sum("part").alias("both"))
    both = both.join(size.select(F.col("c").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("c").alias("b"), F.col("n").alias("nb")), "b")
    return both.where(f"100 * both >= {PERCENT} * (na + nb - both)").select("a", "b")


def sketches(size: DataFrame) -> DataFrame:
    """c, s0 to s31: each class's bitmap in 2,048 bits (a larger one folded), as longs that an expression can count."""
    names = [f"s{i}" for i in range(32)]

    def rows(batches):
        for b in batches:
            x = [np.bitwise_or.reduce(np.frombuffer(z.as_buffer(), np.int64).reshape(-1, 32), 0) for z in b.column(1)]
            x = np.stack(x) if x else np.zeros((0, 32), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(v)) for v in x.T)], ["c", *names])

    return size.select("c", "bits").mapInArrow(rows, "c long, " + ", ".join(f"{n} long" for n in names))


def between_components(groups: DataFrame, labels: DataFrame, size: DataFrame) -> DataFrame:
    """a, b: the possible pairs of a large group whose classes are in different components. Those outside the hub's
    component are the query set; a pair's sizes are in the same or neighbouring steps of 4 : 3. Bitmaps are compared
    inside the join, so it gives rows only for pairs that they let pass, about as many as link."""
    of = labels.withColumnRenamed("node", "a")
    hubs = labels.select(F.col("node").alias("b"), F.col("label").alias("home"))
    step = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)))
    left = groups.join(of, "a", "left").join(hubs, "b", "left").select("token", "a", "n", "rest", F.coalesce("label", "a").alias("label"), F.coalesce("home", "b").alias("home"), step.alias("step"))
    left = written(left, "near-left")
    asked = left.where("label <> home").select("token", F.col("a").alias("a2"), F.col("n").alias("n2"), F.col("rest").alias("rest2"), F.col("label").alias("label2"), F.explode(F.array(*(F.col("step") + k for k in (-1, 0, 1)))).alias("step"))
    left = left.join(asked.select("token", "step").distinct(), ["token", "step"], "left_semi")  # groups that are asked
    bits = written(sketches(size.join(left.select(F.col("a").alias("c")).distinct(), "c", "left_semi")), "near-sketches")
    left = left.join(bits.withColumnRenamed("c", "a"), "a")
    asked = asked.join(bits.withColumnsRenamed({"c": "a2"} | {f"s{i}": f"t{i}" for i in range(32)}), "a2")
    lacks = lambda x, y: " + ".join(f"bit_count({x}{i} & ~{y}{i})" for i in range(32))
    most = f"least(n - ({lacks('s', 't')}), n2 - ({lacks('t', 's')}))"
    possible = f"100 * least(n, n2) >= {PERCENT} * greatest(n, n2) AND {100 + PERCENT} * least(rest, rest2) >= {PERCENT} * (n + n2) AND {100 + PERCENT} * {most} >= {PERCENT} * (n + n2)"
    return left.join(asked, ["token", "step"]).where(f"label <> label2 AND {possible}").select(F.least("a", "a2").alias("a"), F.greatest("a", "a2").alias("b")).distinct()


def near_duplicates(documents: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document. keyed adds the key of its text and whether it is the
    first of its component by id and key (null without an id)."""
    spark = documents.sparkSession
    pieces = fragments(spark)
    survey = written(surveyed(documents), "shingle-survey")
    docs = survey.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "c", "key")
    hot = survey.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "a").limit(HOT).select("a", "n").collect()  # at most HOT
    order = spark.sparkContext.broadcast(Order(hot))
    found = written(candidates(prefix_rows(documents, order, pieces), order, pieces), "near-candidates")
    huge = with_hubs(found.where("kind = 2").select("token", "a", "n", "rest"))
    fits = f"a <> b AND 100 * least(n, nb) >= {PERCENT} * greatest(n, nb) AND {100 + PERCENT} * least(rest, restb) >= {PERCENT} * (n + nb)"
    size = written(survey.where("kind = 0 AND c IS NOT NULL").groupBy("c").agg(F.min("key").alias("key"), F.max("n").alias("n"), F.first("bits").alias("bits")), "near-classes")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = written(possible(pairs, size), "near-possible")
        named = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
        segs = written(segments(documents, size.join(named, "c", "left_semi").select("key", "c"), order), "near-segments")
        return written(linked(pairs, segs, size), "near-links")

    pairs = found.where("kind = 0").select("a", "b").unionByName(huge.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    tried = written(pairs.distinct(), "near-pairs")
    links = verified(tried)
    labels = components(links)
    groups = found.where("kind = 1").select("token", "a", "b", "n", "rest").unionByName(huge.select("token", "a", "b", "n", "rest"))
    more = written(between_components(groups, labels, size).join(tried, ["a", "b"], "left_anti"), "near-pairs")
    if more.head(1):
        labels = components(links.unionByName(verified(more)))
    named = docs.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    least = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("best"))
    first = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.struct("doc_id", "key") == F.col("best"), F.lit(True)))
    extra = ["key", first.alias("first")] if keyed else []
    return named.join(least, "label", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), *extra)

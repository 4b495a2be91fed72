"""Exact removal of repeated byte strings by hash-compared suffix sorting.

Every byte is removed that a LENGTH-byte string covers which also starts earlier (smaller doc_id, or the same document
and an earlier start).

1. Each window of LENGTH bytes has an anchor: its leftmost GRAM-byte gram of least hash. Equal windows have equal
   anchors, at equal places. Consecutive windows with one anchor make a context. Contexts are dealt by the anchor's
   hash, packed; anchors that occur once are dropped there. Of equal contexts only the earliest goes on: the others
   are removed whole. That is done first among the texts at hand, by bytes, before any row is dealt, so copies send
   their spans only.
2. Where an anchor has several different contexts left, their bytes are fetched, and the suffixes from the anchor are
   sorted by mergesort: prefix polynomial hashes and binary search give the common extension of two suffixes, so a
   comparison takes logarithmic time. In this order, windows that start r bytes before the anchor are equal if their
   suffixes share LENGTH - r bytes and their r bytes on the left have one hash. Bytes then verify what hashes found.
3. An anchor with over LIMIT contexts (a passage that very many documents quote) is not sorted in one task: its windows
   go one by one, by a 128-bit hash, through a map-side combined minimum and a join that Spark splits when skewed.

Defined cases: null text counts as empty; texts under LENGTH bytes are kept whole; rows that repeat an id and a
text are one document to this rule (equal rows get equal results, and neither counts as earlier than the other); unlike
texts under one id are documents of their own, in the order of their hashes; a null id sorts first. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import fragments, written

LENGTH, GRAM = 100, 36
SPAN = LENGTH - GRAM + 1  # grams of a window
LIMIT = 2000


def contexts(t: tk.Texts) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, text, start in the text, number of windows, place of the anchor: by context."""
    n = len(t.bytes)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    h = t.prefix()
    at = np.arange(n - GRAM + 1)
    g = t.runs(h, at, at + GRAM)
    bits = tk.U(max(n, 2).bit_length())
    key = (g >> bits << bits) | at.astype(np.uint64)
    low, width = key, 1
    while 2 * width <= SPAN:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if width < SPAN:
        low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
    anchor = (low & ((tk.U(1) << bits) - tk.U(1))).astype(np.int64)  # by window start
    lens = t.lengths
    ok = np.zeros(n + 1, np.int64)
    long = lens >= LENGTH
    np.add.at(ok, t.at[:-1][long], 1)
    np.add.at(ok, t.at[1:][long] - LENGTH + 1, -1)
    good = np.cumsum(ok)[: len(anchor)] > 0
    start = np.flatnonzero(good)
    if not len(start):
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    a = anchor[start]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)))
    first = start[new]
    count = np.diff(np.append(np.flatnonzero(new), len(start)))
    a = a[new]
    text = np.searchsorted(t.at, first, "right") - 1
    # a run never spans two texts: between them LENGTH - 1 starts are not good
    return g[a], t.runs(h, first, first + count + LENGTH - 1), text, first - t.at[text], count, a - first


def shaped(c: np.ndarray, count: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Context hashes that tell shapes apart: contexts of other shape at an anchor differ even if their bytes are equal."""
    return tk.mix(c + count.astype(np.uint64) * tk.U(131) + place.astype(np.uint64) * tk.U(tk.BASE))


def again(t: tk.Texts, a, c, doc, text, start, count) -> np.ndarray:
    """Which contexts are equal, byte for byte, to an earlier one of the texts at hand."""
    key = tk.mix(a ^ tk.mix(c))
    by = np.argsort(key)
    same = key[by][1:] == key[by][:-1]
    on = np.zeros(len(key), bool)
    on[by[1:][same]] = True
    on[by[:-1][same]] = True
    at = np.flatnonzero(on)
    at = at[np.lexsort((start[at], doc[at], c[at], a[at]))]
    out = np.zeros(len(key), bool)
    if not len(at):
        return out
    first = np.concatenate(([True], (a[at][1:] != a[at][:-1]) | (c[at][1:] != c[at][:-1])))
    head = at[np.flatnonzero(first)[np.cumsum(first) - 1]]
    later = (doc[at] != doc[head]) | (start[at] != start[head])
    at, head = at[later], head[later]
    raw, size = t.bytes.tobytes(), (count[at] + LENGTH - 1).tolist()
    here, there = (t.at[text[x]] + start[x] for x in (at, head))
    out[at] = [raw[x : x + n] == raw[y : y + n] for x, y, n in zip(here.tolist(), there.tolist(), size)]
    return out


def dealt(documents: DataFrame, pieces: int) -> DataFrame:
    """Contexts packed by fragments of the anchors' hashes; gone holds packed spans (doc, start, stop) that go already."""
    names = ["f", "anchor", "context", "doc", "start", "windows", "place", "gone"]

    def rows(batches):
        for part, t in tk.pieces(batches, "text"):
            a, c, text, start, count, place = contexts(t)
            if not len(a):
                continue
            doc = part.column(0).to_numpy()[text]
            c = shaped(c, count, place)
            out = again(t, a, c, doc, text, start, count)
            spans = runs_of(doc[out], text[out], start[out], (start + count)[out] + LENGTH - 1)
            a, c, doc, start, count, place = (x[~out] for x in (a, c, doc, start, count, place))
            frag = (a % tk.U(pieces)).astype(np.int32)
            by = np.argsort(frag, kind="stable")
            cut = np.searchsorted(frag[by], np.arange(pieces + 1))
            cols = [x[by] for x in (a, c, doc, start.astype(np.uint32), count.astype(np.uint8), place.astype(np.uint8))]
            out = [(k, *(x[cut[k] : cut[k + 1]].tobytes() for x in cols), b"") for k in range(pieces) if cut[k + 1] > cut[k]]
            if spans.size:
                out.append((int(spans[0, 0] % pieces), *(b"",) * 6, spans.tobytes()))
            yield tk.batch_of(out, [pa.int32(), *[pa.binary()] * 7], names)

    return documents.select("doc", "text").mapInArrow(rows, "f int, anchor binary, context binary, doc binary, start binary, windows binary, place binary, gone binary")


def runs_of(doc, text, start, stop) -> np.ndarray:
    """Spans in the order of their texts and starts, as rows of doc, start, stop; those that touch become one."""
    new = np.ones(len(doc), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] > stop[:-1])
    at = np.flatnonzero(new)
    return np.stack((doc[at], start[at], stop[np.append(at[1:], len(doc)) - 1] if len(at) else stop), 1)


ROW = ("kind byte, doc long, start long, stop long, anchor long, place int, many int", ["kind", "doc", "start", "stop", "anchor", "place", "many"])


def row_batch(kind, doc, start, stop, anchor=None, place=None, many=None) -> pa.RecordBatch:
    n = len(doc)
    z = np.zeros(n, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), pa.array(doc), pa.array(np.asarray(start, np.int64)), pa.array(np.asarray(stop, np.int64)), pa.array(z if anchor is None else anchor.view(np.int64)),
                                       pa.array((z if place is None else place).astype(np.int32)), pa.array((z if many is None else many).astype(np.int32))], ROW[1])


def matched(packed: DataFrame, pieces: int) -> DataFrame:
    """kind 0: [start, stop) of doc is removed. kind 1: the context there is the earliest of its kind, one of many at its anchor."""

    def rows(batches):
        cols = [[] for _ in range(6)]
        for b in batches:
            for x in b.column(7):
                doc, start, stop = np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3).T
                if len(doc):
                    yield row_batch(0, np.ascontiguousarray(doc), start, stop)
            for r in zip(*(b.column(i) for i in range(1, 7))):
                for c, x, d in zip(cols, r, (np.uint64, np.uint64, np.int64, np.uint32, np.uint8, np.uint8)):
                    c.append(np.frombuffer(x.as_buffer(), d))
        if not cols[0]:
            return
        a = np.concatenate(cols[0])
        by = np.argsort(a)
        same = a[by][1:] == a[by][:-1]
        on = np.zeros(len(a), bool)
        on[by[1:][same]] = True
        on[by[:-1][same]] = True
        a = a[on]
        c, doc, start, count, place = (np.concatenate(x)[on] for x in cols[1:])
        by = np.lexsort((start, doc, c, a))
        a, c, doc, start, count, place = (x[by] for x in (a, c, doc, start, count, place))
        start = start.astype(np.int64)
        if not len(a):
            return
        first = np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
        head = np.flatnonzero(first)[np.cumsum(first) - 1]
        gone = (doc != doc[head]) | (start != start[head])
        stop = start + count + LENGTH - 1
        yield row_batch(0, doc[gone], start[gone], stop[gone])
        new = np.concatenate(([True], a[1:] != a[:-1]))
        group = np.cumsum(new) - 1
        many = np.bincount(group, first)[group].astype(np.int64)
        rep = first & (many > 1)
        yield row_batch(1, doc[rep], start[rep], stop[rep], a[rep], place[rep].astype(np.int64), many[rep])

    return packed.repartition(pieces, "f").mapInArrow(rows, ROW[0])


class Suffixes:
    """Suffixes x, from at[x] to end[x] of a buffer, compared by the prefix hashes."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, end: np.ndarray):
        t = tk.Texts(pa.array([raw.tobytes()], pa.binary()))
        self.raw, self.at, self.end, self.h = raw, at, end, t.prefix()
        _, self.q = tk.powers(len(raw) + 1)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.h[b] - self.h[a]) * self.q[a]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search."""
        a, b = self.at[x], self.at[y]
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.end[x] - a, self.end[y] - b)
        while (lo < hi).any():
            m = (lo + hi + 1) >> 1
            eq = self.hashes(a, a + m) == self.hashes(b, b + m)
            lo, hi = np.where(eq, m, lo), np.where(eq, hi, m - 1)
        return lo

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = self.common(x, y)
        a, b = self.at[x] + k, self.at[y] + k
        ended_x, ended_y = a >= self.end[x], b >= self.end[y]
        top = len(self.raw) - 1
        return np.where(ended_x, ~ended_y, ~ended_y & (self.raw[np.minimum(a, top)] < self.raw[np.minimum(b, top)]))

    def order(self, group: np.ndarray) -> np.ndarray:
        """The suffixes sorted within their groups (given in runs), by a bottom-up mergesort of all groups at once:
        an element's new place is its place in its run plus, by binary search, what of the sister run comes before."""
        n = len(group)
        order = np.arange(n)
        head = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else order
        size = np.diff(np.append(head, n))
        base, place = np.repeat(head, size), np.arange(n) - np.repeat(head, size)
        total = np.repeat(size, size)
        run = 1
        while n and run < size.max():
            mine = place // run
            sister = mine ^ 1
            lo = np.minimum(sister * run, total)
            hi = np.minimum(lo + run, total)
            begin, right = lo.copy(), (mine & 1).astype(bool)
            el = order
            while (todo := np.flatnonzero(lo < hi)).size:
                m = (lo[todo] + hi[todo]) >> 1
                other = order[base[todo] + m]
                up = np.where(right[todo], ~self.less(el[todo], other), self.less(other, el[todo]))  # equal ones of the left run come first
                lo[todo] = np.where(up, m + 1, lo[todo])
                hi[todo] = np.where(up, hi[todo], m)
            to = base + (np.minimum(mine, sister) * run) + (place - mine * run) + (lo - begin)
            new = np.empty_like(order)
            new[to] = order
            order = new
            run *= 2
        return order


def repeats_at(raw: np.ndarray, at: np.ndarray, place: np.ndarray, length: np.ndarray, anchor: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts (raw[at : at + length], the anchor at place in them, at pos in doc), in runs by anchor: which
    of them have windows that occur earlier in their group, with the least and greatest r of those."""
    s = Suffixes(raw, at + place, at + length)
    order = s.order(anchor)
    lcp = np.full(len(order), -1)
    inner = np.flatnonzero(anchor[order][1:] == anchor[order][:-1]) + 1
    lcp[inner] = s.common(order[inner - 1], order[inner])
    early = np.lexsort((pos, doc))  # places in the documents
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    least, most = np.full(len(order), 1 << 30), np.full(len(order), -1)
    text = raw.tobytes()
    for r in range(SPAN):
        on = early[(place[early] >= r) & (length[early] - place[early] >= LENGTH - r)]
        if len(on) < 2:
            continue
        block = np.cumsum(lcp < LENGTH - r)[rank[on]]
        left = s.hashes(at[on] + place[on] - r, at[on] + place[on])
        key = tk.mix(left + block.astype(np.uint64) * tk.U(tk.BASE))
        by = np.argsort(key, kind="stable")
        k = key[by]
        new = np.concatenate(([True], k[1:] != k[:-1]))
        head = on[by[np.flatnonzero(new)[np.cumsum(new) - 1]]]
        el = on[by]
        dup = (doc[el] != doc[head]) | (pos[el] != pos[head])
        el, head = el[dup], head[dup]
        fresh = (least[el] == 1 << 30) | (r > most[el])
        # bytes verify: each window against the first of its class
        a, b = (at[el] + place[el] - r).tolist(), (at[head] + place[head] - r).tolist()
        same = np.array([text[x : x + LENGTH] == text[y : y + LENGTH] for x, y in zip(a, b)], bool)
        if not same.all():  # two strings share all hashes: the bytes decide
            first: dict[bytes, int] = {}
            heads = np.array([first.setdefault(text[x : x + LENGTH], i) for i, x in zip(on.tolist(), (at[on] + place[on] - r).tolist())])
            el = on[(doc[on] != doc[heads]) | (pos[on] != pos[heads])]
            fresh = (least[el] == 1 << 30) | (r > most[el])
        least[el[fresh]] = np.minimum(least[el[fresh]], r)
        most[el] = r
    hit = np.flatnonzero(most >= 0)
    return hit, least[hit], most[hit]


def sorted_out(fetched: DataFrame, pieces: int) -> DataFrame:
    """doc, start, stop: what the suffix sorts remove."""

    def rows(batches):
        cols = [b for b in batches if b.num_rows]
        if not cols:
            return
        t = pa.Table.from_batches(cols).combine_chunks()
        anchor = t.column("anchor").to_numpy()
        by = np.argsort(anchor, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(anchor[by]) != 0)))
        i = 0
        while i < len(by):  # whole groups, about 20,000 contexts at a time
            j = np.searchsorted(cut, i + 20_000)
            end = int(cut[j]) if j < len(cut) else len(by)
            part = t.take(pa.array(by[i:end])).combine_chunks()
            i = end
            texts = tk.Texts(part.column("bytes").combine_chunks() if part.num_rows else pa.array([], pa.binary()))
            place = part.column("place").to_numpy().astype(np.int64)
            doc, start = part.column("doc").to_numpy(), part.column("start").to_numpy()
            hit, least, most = repeats_at(texts.bytes, texts.at[:-1], place, texts.lengths, part.column("anchor").to_numpy(), doc, start + place)
            apos = (start + place)[hit]
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(apos - most), pa.array(apos - least + LENGTH)], ["doc", "start", "stop"])

    return fetched.repartition(pieces, "anchor").mapInArrow(rows, "doc long, start long, stop long")


def numbered(documents: DataFrame) -> DataFrame:
    """doc_id, doc, text: doc is a number in the order of the ids that no two unlike documents share. That is the id
    itself unless ids repeat or are null; then ids and text hashes are numbered by sorted ranges."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id", F.xxhash64("text").alias("key"))
    if not ids.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").head(1):
        return docs.select("doc_id", F.col("doc_id").alias("doc"), "text")
    ranged = ids.distinct().repartitionByRange("doc_id", "key").withColumn("part", F.spark_partition_id())
    ranged = written(ranged.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("doc_id", "key"))), "repeat-ids")
    before = ranged.groupBy("part").agg(F.count("*").alias("c"))
    before = before.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("before"))  # a row a partition
    named = ranged.join(F.broadcast(before), "part").select(F.col("doc_id").alias("id"), F.col("key").alias("k"), (F.col("before") + F.col("r")).alias("doc"))
    return docs.join(named, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("k"))).select("doc_id", "doc", "text")


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, stop: the maximal removed runs), kept (binary): one row per document."""
    spark = documents.sparkSession
    pieces = fragments(spark)
    docs = numbered(documents)
    found = written(matched(dealt(docs, pieces), pieces), "repeat-contexts")
    covers = found.where("kind = 0").select("doc", "start", "stop")
    reps = found.where("kind = 1")
    wanted = reps.groupBy("doc").agg(F.collect_list(F.struct("anchor", "start", "stop", "place", F.col("many").alias("many"))).alias("c"))
    need = F.broadcast(wanted) if reps.count() <= 200_000 else wanted

    def cut(batches):
        for b in batches:
            out = []
            for doc, text, cs in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                out += [(doc, c["anchor"], c["start"], c["place"], c["many"], raw[c["start"] : c["stop"]]) for c in cs]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))] if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())], ["doc", "anchor", "start", "place", "many", "bytes"])

    fetched = written(docs.select("doc", "text").join(need, "doc").mapInArrow(cut, "doc long, anchor long, start long, place int, many int, bytes binary"), "repeat-bytes")
    covers = covers.unionByName(sorted_out(fetched.where(f"many <= {LIMIT}"), pieces))

    def single(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                t = tk.Texts(part.column(2))
                own = np.repeat(np.arange(t.n), np.maximum(t.lengths - LENGTH + 1, 0))
                k = np.arange(len(own)) - np.searchsorted(own, own)
                at = t.at[own] + k
                h = t.prefix()
                w1 = t.runs(h, at, at + LENGTH)
                w2 = t.runs(h, at, at + LENGTH // 2) + t.runs(h, at + LENGTH // 2, at + LENGTH) * tk.U(tk.BASE)
                yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(part.column(0).to_numpy()[own]), pa.array(part.column(1).to_numpy()[own] + k)], ["w1", "w2", "doc", "pos"])

    hot = fetched.where(f"many > {LIMIT}")
    if hot.head(1):
        ones = written(hot.select("doc", "start", "bytes").mapInArrow(single, "w1 long, w2 long, doc long, pos long"), "repeat-windows")
        head = ones.groupBy("w1", "w2").agg(F.min(F.struct("doc", "pos")).alias("head"), F.count("*").alias("n")).where("n > 1").select("w1", "w2", F.col("head.doc").alias("d0"), F.col("head.pos").alias("p0"))
        covers = covers.unionByName(ones.join(head, ["w1", "w2"]).where("doc <> d0 OR pos <> p0").select("doc", F.col("pos").alias("start"), (F.col("pos") + LENGTH).alias("stop")))

    per = covers.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("cover"))
    joined = docs.join(per, "doc", "left").select("doc_id", "text", "cover")

    def finish(batches):
        for b in batches:
            sizes, spans, kept = [], [], []
            for text, cover in zip(b.column(1), b.column(2).to_pylist()):
                raw = text.as_buffer().to_pybytes()
                runs: list[list[int]] = []
                for c in cover or []:
                    if runs and c["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], c["stop"])
                    else:
                        runs.append([c["start"], c["stop"]])
                runs = [[x, min(y, len(raw))] for x, y in runs if x < len(raw)]
                left, last = [], 0
                for x, y in runs:
                    left.append(raw[last:x])
                    last = y
                sizes.append(len(raw))
                spans.append([{"start": x, "stop": y} for x, y in runs])
                kept.append(b"".join((*left, raw[last:])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")

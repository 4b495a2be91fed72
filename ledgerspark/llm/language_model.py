"""Word language model by deleted interpolation.

P(w | v) = l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1): maximum-likelihood estimates of orders two, one and zero,
mixed with weights (l2, l1, l0) that depend on the bucket of the context's frequency c(v) (powers of two). The weights
come from expectation-maximisation on held-out counts: one fold of the training documents is counted apart and
predicted from the others; then all training counts are used.

Tokens are words in lower case (A-Z) and one end a text, which is also the context of the first word. Every pair of
the training documents is counted. The FREQUENT most frequent words (and the end) have numbers, which are broadcast
with their counts; pairs of two numbers are gathered by fragments of the hash space, the HEAVY most frequent of
them looked up in a broadcast table, so no fragment gets a hot pair. Each place of a word without a number goes to the
fragment of that word, with its neighbours, so the fragment has the counts of the word and of its pairs on both sides.
Where both words of a pair lack numbers, one fragment returns c(v) and c(v, w), the other c(w), and the text's chunk puts
them together. Numbers thus save work and change no count; what is gathered grows with the input.

The cells of expectation-maximisation hold p2 and p1 in quarter powers of two; of a pair without numbers p1 is the mean of
such words. Fragments grow in number with the tokens, FRAGMENT training tokens to one, so a task's memory stays bounded.

Defined cases: null or empty text is one end; repeated rows each count and are each scored; a null id has the text
'' in the fold rule; without training tokens every probability is 1 and N is 0. Extra columns are ignored. A chunk is named
by its first row's place in the input, so an input that comes out of a shuffle is to be written first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import fold_of, fragments, held_out, written

NONE = 0xFFFF  # stands for a word without a number
FREQUENT = NONE
HEAVY = 1 << 17
FOLDS, TUNE = 5, 2  # of the training folds, documents with remainder TUNE are held out for the weights
END = np.uint64(0x5DEECE66D1234567)
BUCKETS = 40
CHUNK = 2 << 20
FRAGMENT = 1_000_000


def tokens(t: tk.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and the texts' ranges."""
    start, end, own = t.words()
    h = t.runs(t.prefix(True), start, end)
    out = np.empty(len(h) + t.n, np.uint64)
    at = own + np.arange(t.n + 1)
    out[at[1:] - 1] = END
    out[np.arange(len(h)) + tk.of_text(own)] = h
    return out, at


def training(documents: DataFrame) -> DataFrame:
    """text, tune of the training documents."""
    fold = fold_of("doc_id", FOLDS)
    return documents.where(fold != 1).select("text", (fold == TUNE).alias("tune"))


def type_counts(train: DataFrame, keys_of, width: type, pieces: int) -> DataFrame:
    """f, keys, rest, tune: per task and fragment the distinct keys with their counts outside and inside the tuning fold."""
    bits = np.dtype(width).itemsize

    def rows(batches):
        names, kinds = ["f", "keys", "rest", "tune"], [pa.int32(), *[pa.binary()] * 3]
        some, size = [], 0
        for part, t in tk.pieces(batches, "text", CHUNK):
            keys, at = keys_of(t)
            tune = np.repeat(np.asarray(part.column(1).to_numpy(zero_copy_only=False), bool), np.diff(at))
            for on in (False, True):
                u, c = np.unique(keys[(tune == on) & (keys != width(0))], return_counts=True)
                some.append((u, c * (not on), c * on))
                size += len(u)
            if size > 3_000_000:
                some = [merged(some)]
                if len(some[0][0]) > 1_500_000:
                    yield tk.batch_of(tk.packed_by(place(some[0][0], pieces), pieces, *some[0]), kinds, names)
                    some = []
                size = sum(len(x[0]) for x in some)
        if some:
            got = merged(some)
            if len(got[0]):
                yield tk.batch_of(tk.packed_by(place(got[0], pieces), pieces, *got), kinds, names)

    assert bits in (4, 8)
    return train.mapInArrow(rows, "f int, keys binary, rest binary, tune binary").repartition(pieces, "f")


def place(keys: np.ndarray, pieces: int) -> np.ndarray:
    return (tk.mix(keys.astype(np.uint64)) % tk.U(pieces)).astype(np.int32)


def merged(some: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate([x[0] for x in some])
    u, inv = np.unique(keys, return_inverse=True)
    return (u, *(np.bincount(inv, np.concatenate([x[i] for x in some]), len(u)).astype(np.uint32) for i in (1, 2)))


def unpacked(batches, width: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    some, size = [(np.zeros(0, width), np.zeros(0, np.uint32), np.zeros(0, np.uint32))], 0
    for b in batches:
        for r in zip(*(b.column(i) for i in (1, 2, 3))):
            some.append(tuple(np.frombuffer(x.as_buffer(), d) for x, d in zip(r, (width, np.uint32, np.uint32))))
            size += len(some[-1][0])
        if size > max(1_000_000, len(some[0][0])):  # merged as they come, so that only distinct keys stay
            some, size = [merged(some)], 0
    return merged(some)


def bucket_of(c: np.ndarray) -> np.ndarray:
    """0 for contexts that were not seen, else 1 + log2 of the count."""
    return np.where(c < 1, 0, np.minimum(1 + np.log2(np.maximum(c, 1)).astype(np.int64), BUCKETS - 1))


def quarters(p: np.ndarray) -> np.ndarray:
    """Probabilities in quarter powers of two; -999 for zero."""
    return np.where(p > 0, np.round(4 * np.log2(np.maximum(p, 1e-300))), -999).astype(np.int64)


def counted(keys: np.ndarray, on: np.ndarray) -> np.ndarray:
    """For each place, how often its key occurs among the places that are on."""
    u, inv = np.unique(keys, return_inverse=True)
    return np.bincount(inv, on, len(u)).astype(np.int64)[inv]


def sized(pieces: int, n: int) -> int:
    """Fragments for n training tokens."""
    return max(pieces, math.ceil(n / FRAGMENT))


class Model:
    """words (sorted hashes), their counts outside the tuning fold (rest) and in all (total); N, V; heavy pairs; weights."""

    def __init__(self, words, rest, total, n_rest, n, v):
        by = np.argsort(words)
        self.words, self.rest, self.total = words[by], rest[by], total[by]
        self.n_rest, self.n, self.v = n_rest, n, v
        self.gate = np.zeros(1 << 22, bool)
        self.gate[(self.words >> tk.U(42)).astype(np.int64)] = True
        self.heavy, self.heavy_count = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The words' numbers; -1 for words that have none."""
        out = np.full(len(h), -1, np.int32)
        maybe = np.flatnonzero(self.gate[(h >> tk.U(42)).astype(np.int64)])
        if len(maybe) and len(self.words):
            u, inv = np.unique(h[maybe], return_inverse=True)
            i = np.minimum(np.searchsorted(self.words, u), len(self.words) - 1)
            out[maybe] = np.where(self.words[i] == u, i, -1).astype(np.int32)[inv]
        return out

    def bucket(self, v: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Bucket of the contexts numbered v."""
        return bucket_of(np.where(v < 0, 0, counts[np.maximum(v, 0)]))

    def pairs(self, t: tk.Texts):
        """Tokens, ranges, numbers, contexts' numbers and pair keys (number of the context, of the word)."""
        h, at = tokens(t)
        w = self.numbers(h)
        v = np.empty_like(w)
        v[1:] = w[:-1]
        v[at[:-1]] = self.numbers(np.array([END]))[0]
        both = (w >= 0) & (v >= 0)
        key = np.where(both, v.astype(np.int64) << 16 | w, 0).astype(np.uint32)
        return h, at, w, v, both, key

    def unnumbered(self, h: np.ndarray, w: np.ndarray, v: np.ndarray):
        """Places of words without numbers, their hashes, the numbers before them and marks of the words after them
        (an end has a number, so each has a word after it): numbers, or the hash behind a set bit."""
        i = np.flatnonzero(w < 0)
        after = np.where(w[i + 1] >= 0, w[i + 1].astype(np.uint64), h[i + 1] | tk.U(1 << 63))
        return i, h[i], np.where(v[i] >= 0, v[i], NONE).astype(np.uint16), after


def known_words(train: DataFrame, pieces: int) -> Model:
    def totals(batches):
        keys, rest, tune = unpacked(batches, np.uint64)
        every = rest.astype(np.int64) + tune
        top = np.lexsort((keys, -every, keys != END))[:FREQUENT]
        top = top[(every[top] > 2) | (keys[top] == END)]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int8()), pa.array([len(keys)], pa.int64()), pa.array([int(rest.sum())], pa.int64()), pa.array([int(every.sum())], pa.int64())], ["kind", "w", "rest", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(top), np.int8)), pa.array(keys[top].view(np.int64)), pa.array(rest[top].astype(np.int64)), pa.array(every[top])], ["kind", "w", "rest", "n"])

    found = written(type_counts(train, tokens, np.uint64, pieces).mapInArrow(totals, "kind byte, w long, rest long, n long"), "lm-words")
    v, n_rest, n = found.where("kind = 0").agg(F.sum("w"), F.sum("rest"), F.sum("n")).first()
    rows = found.where("kind = 1").orderBy(F.desc(F.col("w") == int(END)), F.desc("n"), "w").limit(FREQUENT).collect()  # at most FREQUENT
    w, rest, every = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
    return Model(w.view(np.uint64), rest, every, n_rest or 0, n or 0, v or 0)


def fit(documents: DataFrame) -> Model:
    spark = documents.sparkSession
    pieces = fragments(spark)
    train = training(documents)
    model = known_words(train, pieces)
    if not len(model.words):
        model.weights = np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
        return model
    pieces = sized(pieces, model.n)
    shared = spark.sparkContext.broadcast(model)
    rare = max(model.n_rest - int(model.rest.sum()), 1) / max(model.n_rest, 1) / max(model.v - len(model.words), 1)

    def keys_of(t):
        """Pair keys plus one (0: none), for tokens whose word and context have numbers."""
        _, at, _, _, both, key = shared.value.pairs(t)
        return np.where(both, key.astype(np.int64) + 1, 0).astype(np.uint64), at

    def cells(batches):
        m = shared.value
        keys, rest, tune = unpacked(batches, np.uint64)
        keys = keys - tk.U(1)
        every = rest.astype(np.int64) + tune
        top = np.lexsort((keys, -every))[:HEAVY]
        top = top[every[top] > 9]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(top), np.int8)), pa.array(keys[top].view(np.int64)), pa.array(np.zeros(len(top), np.int64)), pa.array(np.zeros(len(top), np.int64)), pa.array(every[top])], ["kind", "k", "q2", "q1", "n"])
        on = tune > 0
        v, w = (keys[on] >> tk.U(16)).astype(np.int64), (keys[on] & tk.U(0xFFFF)).astype(np.int64)
        yield cell_rows(m.bucket(v, m.rest), rest[on] / np.maximum(m.rest[v], 1), m.rest[w] / max(m.n_rest, 1), tune[on])

    schema = "kind byte, k long, q2 long, q1 long, n long"
    found = written(type_counts(train, keys_of, np.uint64, pieces).mapInArrow(cells, schema), "lm-pairs")

    def sent(batches):
        m = shared.value
        for part, t in tk.pieces(batches, "text", CHUNK):
            h, at, w, v, _, _ = m.pairs(t)
            i, x, before, after = m.unnumbered(h, w, v)
            tune = np.repeat(np.asarray(part.column(1).to_numpy(zero_copy_only=False), bool), np.diff(at))[i]
            if len(i):
                yield tk.batch_of(tk.packed_by(place(x, pieces), pieces, x, before, after, tune), [pa.int32(), *[pa.binary()] * 4], ["f", "x", "before", "after", "tune"])

    def unnumbered_cells(batches):
        m = shared.value
        got = [[np.frombuffer(x.as_buffer(), d) for x, d in zip(r, (np.uint64, np.uint16, np.uint64, bool))] for b in batches for r in zip(*(b.column(i) for i in range(1, 5)))]
        if not got:
            return
        x, before, after, tune = (np.concatenate(a) for a in zip(*got))
        c, n = counted(x, ~tune), max(m.n_rest, 1)
        with_before = counted(tk.mix(x + tk.mix(before.astype(np.uint64))), ~tune)
        with_after = counted(tk.mix(x + tk.mix(after + tk.U(1 << 32))), ~tune)
        on = tune & (before != NONE)
        v = before[on].astype(np.int64)
        yield cell_rows(m.bucket(v, m.rest), with_before[on] / np.maximum(m.rest[v], 1), c[on] / n)
        w = after[tune]
        p1 = np.where(w < NONE, m.rest[np.minimum(w, tk.U(len(m.rest) - 1)).astype(np.int64)] / n, rare)
        yield cell_rows(bucket_of(c[tune]), with_after[tune] / np.maximum(c[tune], 1), p1)

    rest = train.mapInArrow(sent, "f int, x binary, before binary, after binary, tune binary").repartition(pieces, "f").mapInArrow(unnumbered_cells, schema)
    got = found.where("kind = 0").unionByName(rest).groupBy("k", "q2", "q1").agg(F.sum("n").alias("n")).orderBy("k", "q2", "q1").collect()  # bounded by the grid of BUCKETS and quarter powers of two
    k, q2, q1, n = (np.array([r[i] for r in got], np.int64) for i in range(4))
    model.weights = learned(k, q2, q1, n, model.v)
    heavy = found.where("kind = 1").orderBy(F.desc("n"), "k").limit(HEAVY).orderBy("k").collect()  # at most HEAVY
    model.heavy, model.heavy_count = np.array([r["k"] for r in heavy], np.int64).astype(np.uint32), np.array([r["n"] for r in heavy], np.int64)
    shared.unpersist()
    return model


def cell_rows(bucket, p2, p1, times=None) -> pa.RecordBatch:
    """The places of tuning documents by bucket and rounded probabilities."""
    u, inv = np.unique(np.stack((bucket, quarters(p2), quarters(p1)), 1), axis=0, return_inverse=True)
    n = np.bincount(inv.ravel(), times, len(u)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(u), np.int8)), *(pa.array(u[:, i]) for i in range(3)), pa.array(n)], ["kind", "k", "q2", "q1", "n"])


def learned(k, q2, q1, n, v, rounds: int = 50) -> np.ndarray:
    """Expectation-maximisation of each bucket's weights on the cells (bucket, p2, p1, held-out count)."""
    p = np.stack([np.where(q > -999, 2.0 ** (q / 4), 0.0) for q in (q2, q1)] + [np.full(len(k), 1 / (v + 1))], 1)
    w = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    w[0] = [0, 0.7, 0.3]
    for _ in range(rounds):
        part = w[k] * p
        part *= (n / np.maximum(part.sum(1), 1e-300))[:, None]
        new = np.stack([np.bincount(k, part[:, i], BUCKETS) for i in range(3)], 1) + 0.01 * w
        w = new / new.sum(1, keepdims=True)
        w = np.maximum(w, [0, 1e-6, 1e-6])
    return w / w.sum(1, keepdims=True)


LATE_W = np.dtype([("at", np.int32), ("w", np.uint32)])
LATE_V = np.dtype([("at", np.int32), ("v", np.uint32), ("vw", np.uint32)])


def scores(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document."""
    spark = documents.sparkSession
    pieces = fragments(spark)
    model = fit(documents)
    pieces = sized(pieces, model.n)
    shared = spark.sparkContext.broadcast(model)
    kinds = {"x": np.uint64, "x_own": np.int32, "x_at": np.int32, "before": np.uint16, "after": np.uint64, "pair": np.uint32, "pair_own": np.int32, "train": bool}

    def mixed(m, b, p2, c):
        lam = m.weights[b]
        return np.log10(lam[:, 0] * p2 + lam[:, 1] * c / max(m.n, 1) + lam[:, 2] / (m.v + 1))

    def rows(batches):
        m = shared.value
        unit = m.n + 0.5 * (m.v + 1)
        for part, t in tk.pieces(batches, "text", CHUNK):
            h, at, w, v, both, key = m.pairs(t)
            if not len(m.words):  # nothing was learnt
                w, both = np.zeros_like(w), np.zeros(len(w), bool)
            own = tk.of_text(at).astype(np.int32)
            train = ~np.asarray(part.column(2).to_numpy(zero_copy_only=False), bool)
            c = np.where(w >= 0, m.total[np.maximum(w, 0)], 0) if len(m.total) else np.zeros(len(w))
            i = np.minimum(np.searchsorted(m.heavy, key), max(len(m.heavy) - 1, 0))
            heavy = both & (m.heavy[i] == key) if len(m.heavy) else np.zeros(len(w), bool)
            known = np.zeros(len(w))
            known[heavy] = mixed(m, m.bucket(v[heavy], m.total), m.heavy_count[i[heavy]] / m.total[v[heavy]], c[heavy])
            far = both & ~heavy
            sums = [np.where(w < 0, 0.0, np.log10((c + 0.5) / unit)), known, (w >= 0) & (c > 0)]
            base, score, seen = (tk.per_text_sum(x, at) for x in sums)
            ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            chunk = int(ids[0])
            here = np.concatenate([x.astype(np.float64).view(np.int64) for x in (base, score)] + [seen.astype(np.int64), np.diff(at), part.column(3).fill_null(0).to_numpy().astype(np.int64), np.asarray(part.column(3).is_null().to_numpy(zero_copy_only=False), np.int64), (~train).astype(np.int64)]).tobytes()
            flags = train.tobytes()
            j, x, before, after = m.unnumbered(h, w, v)
            r = {k: y for k, *y in tk.packed_by(place(x, pieces), pieces, x, own[j], j.astype(np.int32), before, after)}
            q = {k: y for k, *y in tk.packed_by(place(key[far], pieces), pieces, key[far], own[far])}
            out = [(k, chunk, *(r.get(k) or (b"",) * 5), *(q.get(k) or (b"",) * 2), flags, b"") for k in sorted({*r, *q})]
            out.append((int(place(np.array([chunk]), pieces)[0]), chunk, *(b"",) * 7, flags, here))
            yield tk.batch_of(out, [pa.int32(), pa.int64(), *[pa.binary()] * 9], ["f", "chunk", *kinds, "here"])

    def sums(batches):
        m = shared.value
        unit = m.n + 0.5 * (m.v + 1)
        got = [(r[0].as_py(), *(x.as_buffer() for x in r[1:])) for b in batches for r in zip(*(b.column(i) for i in range(1, 11)))]
        if not got:
            return
        a = {k: [np.frombuffer(r[i], d) for r in got] for i, (k, d) in enumerate(kinds.items(), 1)}  # views of the batches
        part: dict[int, list[np.ndarray]] = {}
        late: dict[int, tuple[bytes, bytes]] = {}

        def add(j, own, *values):
            have = part.setdefault(got[j][0], [np.zeros(len(a["train"][j]))] * 3)
            part[got[j][0]] = [y + np.bincount(own, x, len(y)) for y, x in zip(have, values)]

        def spread(lens):
            at = np.concatenate(([0], np.cumsum(lens)))
            return [(j, slice(at[j], at[j + 1])) for j in range(len(got)) if lens[j]]

        if any(len(k) for k in a["x"]):
            x, before, after = (np.concatenate(a[k]) for k in ("x", "before", "after"))
            mine = np.concatenate([t[o] for t, o in zip(a["train"], a["x_own"])])
            c = counted(x, mine)
            with_before = counted(tk.mix(x + tk.mix(before.astype(np.uint64))), mine)
            with_after = counted(tk.mix(x + tk.mix(after + tk.U(1 << 32))), mine)
            v, w = np.minimum(before, len(m.total) - 1).astype(np.int64), np.minimum(after, tk.U(len(m.total) - 1)).astype(np.int64)
            lone, open_ = before == NONE, after >= NONE
            score = np.where(lone, 0.0, mixed(m, m.bucket(v, m.total), with_before / m.total[v], c))
            score += np.where(open_, 0.0, mixed(m, bucket_of(c), with_after / np.maximum(c, 1), m.total[w]))
            base = np.log10((c + 0.5) / unit)
            for j, s in spread([len(k) for k in a["x"]]):
                add(j, a["x_own"][j], base[s], score[s], c[s] > 0)
                left, right = np.flatnonzero(lone[s]), np.flatnonzero(open_[s])
                one, two = np.zeros(len(left), LATE_W), np.zeros(len(right), LATE_V)
                one["at"], one["w"] = a["x_at"][j][left], c[s][left]
                two["at"], two["v"], two["vw"] = a["x_at"][j][right] + 1, c[s][right], with_after[s][right]
                have = late.get(got[j][0], (b"", b""))  # a partition can hold several fragments
                late[got[j][0]] = (have[0] + one.tobytes(), have[1] + two.tobytes())
        if any(len(k) for k in a["pair"]):
            key = np.concatenate(a["pair"])
            mine = np.concatenate([t[o] for t, o in zip(a["train"], a["pair_own"])])
            v, w = (key >> np.uint32(16)).astype(np.int64), (key & np.uint32(0xFFFF)).astype(np.int64)
            score = mixed(m, m.bucket(v, m.total), counted(key, mine) / m.total[v], m.total[w])
            none = np.zeros(len(key))
            for j, s in spread([len(k) for k in a["pair"]]):
                add(j, a["pair_own"][j], none[s], score[s], none[s])
        out = [(chunk, b"".join(x.astype(np.float64).tobytes() for x in p), *late.get(chunk, (b"", b"")), b"") for chunk, p in part.items()]
        out += [(r[0], b"", b"", b"", r[9].to_pybytes()) for r in got if r[9].size]
        yield tk.batch_of(out, [pa.int64(), *[pa.binary()] * 4], ["chunk", "part", "late_w", "late_v", "here"])

    def joined(batches):
        """All rows of a chunk are in one partition: its documents' own sums, those of the fragments, and the pairs without numbers."""
        m = shared.value
        parts, here, late = {}, {}, {}
        for b in batches:
            for chunk, p, one, two, x in zip(*(b.column(i).to_pylist() for i in range(5))):
                if x:
                    here[chunk] = np.frombuffer(x, np.int64).reshape(7, -1)
                else:
                    parts.setdefault(chunk, []).append(np.frombuffer(p).reshape(3, -1))
                    late.setdefault(chunk, []).append((np.frombuffer(one, LATE_W), np.frombuffer(two, LATE_V)))
        for chunk, x in sorted(here.items()):
            got = sorted(parts.get(chunk, []), key=lambda a: a.tobytes())
            base, score, known = np.stack([x[0].view(np.float64), x[1].view(np.float64), x[2].astype(np.float64)]) + (sum(got) if got else 0)
            if chunk in late:
                one, two = (np.sort(np.concatenate(y), order="at") for y in zip(*late[chunk]))  # the same places
                own = np.searchsorted(np.cumsum(x[3]), one["at"], "right")
                score = score + np.bincount(own, mixed(m, bucket_of(two["v"]), two["vw"] / np.maximum(two["v"], 1), one["w"]), len(score))
            yield pa.RecordBatch.from_arrays([pa.array(x[4], mask=x[5].astype(bool)), pa.array(x[6].astype(bool)), pa.array(x[3]), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    # the first row's number names a chunk; it is used within this one job only
    ids = documents.select(F.monotonically_increasing_id().alias("row"), "text", held_out("doc_id", FOLDS).alias("held_out"), "doc_id")
    sent = ids.mapInArrow(rows, "f int, chunk long, " + ", ".join(f"{k} binary" for k in [*kinds, "here"]))
    back = sent.repartition(pieces, "f").mapInArrow(sums, "chunk long, part binary, late_w binary, late_v binary, here binary").repartition(pieces, "chunk")
    out = back.mapInArrow(joined, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(shared.value.n).cast("long").alias("train_tokens"), "base_score", "score")

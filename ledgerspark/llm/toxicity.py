"""Toxicity by weak supervision.

Voters mark each text: hand-written lexicon groups and patterns, and learnt ones that count the text's words and stems
in a lexicon of terms which labelled toxic texts hold much oftener than clean ones, in whatever language. A generative
label model estimates from all learning documents' vote patterns how often each voter fires on toxic and on clean texts
and which voters depend on each other (a tree of pairwise correlations within each class); its posteriors are the
labels of a linear classifier on hashed words, stems and votes, which gives the score.

The learnt lexicon and the classifier are fitted on at most MAX_TRAIN labelled documents, those with the smallest hash
of their id. Each half of them votes with the lexicon of the other half, so that no voter looks better than it is. Known
labels enter the label model as observations with an error rate; documents without one weigh as much as those with one
in all, so that the classes stay toxic and clean. Documents that are held out (crc32 of the id modulo
3 is 1) lend neither label nor text to anything.

Defined cases: null text counts as empty and is scored by the votes alone; repeated rows are each scored; of labels
that repeat an id the greatest holds, and labels without an id or mark are left out; a null id counts as the text '' in
the fold rule and has no label; with no labelled rows to learn from, every score is 0.5. Extra columns are ignored
(without_toxic keeps them).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .shared import held_out, written

MAX_TRAIN = 20_000  # labelled documents that lexicon and classifier are fitted on
LEARNT = 8192  # most terms of the learnt lexicon
STEMS = (4, 5, 7)  # a word's first bytes that are terms of their own
DIMS = 1 << 17
CUT = 0.7

#: Lexicon voters: a group fires if a word of it occurs as a whole word, in any case.
LEXICON = {
    "fool": "idiot idiots idiotic moron morons moronic imbecile imbeciles fool fools dimwit halfwit",
    "dull": "stupid stupidity dumb dumbass brainless dense clueless",
    "worth": "worthless useless nobody failure failures",
    "pity": "pathetic loser losers pitiful weakling coward cowards",
    "filth": "trash garbage filth filthy dirt dirty rubbish",
    "vermin": "scum vermin rat rats pig pigs parasite parasites maggot maggots",
    "disgust": "disgusting revolting repulsive gross vile nasty",
    "mock": "clown clowns joke freak freaks weirdo ugly",
    "hate": "hate hated hateful despise loathe",
    "threat": "kill die murder hang shoot beat hurt destroy",
    "swear": "damn hell shit crap bastard bitch asshole fuck fucking ass",
    "other": "idiota estupido imbecil basura asco payaso dumm idioten abschaum versager stupide crétin ordure minable",
}
#: Pattern voters, on the lower-cased text.
PATTERNS = {
    "address": rb"\b(?:you|you're|youre|u)\s+(?:are\s+|r\s+)?(?:an?\s+|all\s+|such\s+an?\s+|so\s+|fucking\s+)*(?:idiot|moron|stupid|dumb|loser|pathetic|worthless|disgusting|trash|scum|clown)",
    "go": rb"\b(?:shut\s+up|go\s+(?:away|die|to\s+hell)|get\s+lost|drop\s+dead|nobody\s+(?:likes|loves|wants)\s+you)\b",
}
LEET = bytes.maketrans(b"013457@$!", b"oieastasi")
#: Learnt voters fire at so many distinct terms of the kind, or at such a share of the text's distinct words.
COUNTS = {"strong words": (1, 2, 4, 8), "fair words": (3, 6, 12), "strong stems": (1, 2, 4, 8), "fair stems": (3, 6, 12)}
SHARES = {"strong words": (0.01, 0.04), "fair words": (0.03, 0.1), "strong stems": (0.01, 0.04), "fair stems": (0.03, 0.1)}
STRONG, FAIR, SURE = np.log(16), np.log(3), 3.5  # how much likelier a term is in toxic texts; in standard errors
VOTERS = [*LEXICON, *PATTERNS, "disguised", "several", *(f"{k} {n}" for x in (COUNTS, SHARES) for k, ns in x.items() for n in ns), "nothing"]
ANY = (1 << len(LEXICON)) - 1
ADDRESS = {k: re.compile(p) for k, p in PATTERNS.items()}
#: Only a text with one of these bytes' words can match a pattern; the search is skipped for the others.
GATE = re.compile(rb"you|\bu\s|shut|go\s|get\s+lost|drop\s+dead|nobody")

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
LETTER[39] = True
DISGUISE = LETTER.copy()
DISGUISE[[ord(c) for c in "013457@$!"]] = True
MARK = np.zeros(256, bool)
MARK[[ord(c) for c in "013457@$!"]] = True


def hashes(words: list[str]) -> np.ndarray:
    t = tk.Texts(pa.array(words, pa.string()))
    return t.runs(t.prefix(True), t.at[:-1], t.at[1:])


def lexicon() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the lexicon's words, and each one's group."""
    words = [(w, g) for g, ws in enumerate(LEXICON.values()) for w in ws.split()]
    h = hashes([w for w, _ in words])
    order = np.argsort(h)
    return h[order], np.array([g for _, g in words])[order]


def look_up(h: np.ndarray, lex: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are lexicon words (their indices), and their places in the lexicon."""
    i = np.minimum(np.searchsorted(lex[0], h), len(lex[0]) - 1)
    hit = np.flatnonzero(lex[0][i] == h)
    return hit, i[hit]


class Learnt:
    """Terms (sorted hashes) that toxic texts hold oftener, their log ratios, and which are stems."""

    def __init__(self, rows: list[tuple[int, float, bool]]):
        term = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        by = np.argsort(term)
        self.term, self.ratio, self.stem = term[by], np.array([r[1] for r in rows], float)[by], np.array([r[2] for r in rows], bool)[by]

    def marks(self, terms: np.ndarray, text: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
        """By learnt voter, which of the texts (of so many distinct words) it fires on; terms with their texts."""
        hit, place = look_up(terms, (self.term, None)) if len(self.term) else (np.zeros(0, np.int64),) * 2
        pair = np.unique(text[hit] * np.int64(len(self.term) + 1) + place)
        of, place = pair // (len(self.term) + 1), pair % (len(self.term) + 1)
        out = {}
        for unit, stem in (("words", False), ("stems", True)):
            for level, least in (("strong", STRONG), ("fair", FAIR)):
                k = f"{level} {unit}"
                n = np.bincount(of[(self.stem[place] == stem) & (self.ratio[place] >= least)], minlength=len(words))
                out |= {f"{k} {x}": n >= x for x in COUNTS[k]} | {f"{k} {x}": n >= np.maximum(x * words, 2) for x in SHARES[k]}
        return out


NOTHING = Learnt([])


def terms_of(t: tk.Texts, prefix: np.ndarray, start: np.ndarray, end: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and of their stems, which are stems, and the texts of each."""
    text = tk.of_text(own).astype(np.int64)
    h, of, stem = [t.runs(prefix, start, end)], [text], [np.zeros(len(text), bool)]
    for k in STEMS:
        on = np.flatnonzero(end - start > k)
        h.append(tk.mix(t.runs(prefix, start[on], start[on] + k) + tk.U(k)))
        of.append(text[on])
        stem.append(np.ones(len(on), bool))
    return np.concatenate(h), np.concatenate(stem), np.concatenate(of)


def votes_and_words(t: tk.Texts, lex, learnt: Learnt = NOTHING) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vote bits of each text; its distinct hashed terms below DIMS, by text, and their ranges."""
    prefix = t.prefix(True)
    start, end = t.spans(LETTER[t.bytes])
    own = t.owner(start)
    terms, stem, of = terms_of(t, prefix, start, end, own)
    h = terms[: len(start)]
    bits = np.zeros(t.n, np.int64)
    kinds = np.zeros((t.n, len(lex[0])), bool)
    hit, place = look_up(h, lex)
    text = np.searchsorted(own, hit, "right") - 1
    np.bitwise_or.at(bits, text, np.int64(1) << lex[1][place])
    kinds[text, place] = True
    # words written with digits or signs for letters
    marks = np.concatenate(([0], np.cumsum(MARK[t.bytes])))
    ds, de = t.spans(DISGUISE[t.bytes])
    lett = np.concatenate(([0], np.cumsum(LETTER[t.bytes])))
    odd = (marks[de] > marks[ds]) & (lett[de] > lett[ds]) & (de - ds < 24)
    ds, de = ds[odd], de[odd]
    if len(ds):
        raw = t.bytes.tobytes()
        forms = [raw[a:b].rstrip(b"!").translate(LEET) for a, b in zip(ds.tolist(), de.tolist())]
        plain = [bool(re.search(rb"[0-9@$!]", raw[a:b].rstrip(b"!"))) for a, b in zip(ds.tolist(), de.tolist())]
        dh = hashes([f.decode("utf-8", "replace") for f in forms])
        dhit, dplace = look_up(dh, lex)
        for i, pl in zip(dhit.tolist(), dplace.tolist()):
            if plain[i]:
                d = int(np.searchsorted(t.at, ds[i], "right")) - 1
                bits[d] |= (1 << VOTERS.index("disguised")) | (1 << int(lex[1][pl]))
                kinds[d, pl] = True
    bits[kinds.sum(1) >= 2] |= 1 << VOTERS.index("several")
    raw = t.bytes.tobytes().lower()
    for d, (a, b) in enumerate(zip(t.at[:-1].tolist(), t.at[1:].tolist())):
        low = raw[a:b]
        if GATE.search(low):
            for k, p in ADDRESS.items():
                if p.search(low):
                    bits[d] |= 1 << VOTERS.index(k)
    key = np.unique(of * DIMS + (terms & tk.U(DIMS - 1)).astype(np.int64))
    at = np.searchsorted(key, np.arange(t.n + 1) * DIMS)
    for k, on in learnt.marks(terms, of, np.diff(at)).items():
        bits[on] |= 1 << VOTERS.index(k)
    bits[bits == 0] = 1 << VOTERS.index("nothing")
    return bits, (key % DIMS).astype(np.int32), at


def features(bits: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classifier's inputs as feature numbers and their ranges, by text: its hashed terms, then one place a voter,
    then one for any lexicon vote, then the constant."""
    votes = [np.flatnonzero(bits >> v & 1) for v in range(len(VOTERS))] + [np.flatnonzero(bits & ANY), np.arange(len(bits))]
    d = np.concatenate([tk.of_text(at), *votes])
    f = np.concatenate([words, *(np.full(len(v), DIMS + i) for i, v in enumerate(votes))])
    order = np.argsort(d, kind="stable")
    return f[order].astype(np.int32), np.searchsorted(d[order], np.arange(len(bits) + 1))


ERROR, DOUBT = 0.01, 3.0  # of labels: the share that is wrong, and the log odds that votes can hold against one
WIDTH = DIMS + len(VOTERS) + 2


def values(f: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A vote counts 1; all terms of a text together have length 1, so that the many of a long text don't outweigh its votes."""
    word = f < DIMS
    n = tk.per_text_sum(word.astype(float), at)
    return np.where(word, np.repeat(1 / np.sqrt(np.maximum(n, 1)), np.diff(at)), 1.0)


def term_counts(sample: DataFrame) -> DataFrame:
    """term, stem, half, toxic, n: how many texts of the sample hold a term."""

    def rows(batches):
        for part, t in tk.pieces(batches, "text", 4 << 20):
            start, end = t.spans(LETTER[t.bytes])
            terms, stem, of = terms_of(t, t.prefix(True), start, end, t.owner(start))
            group = (part.column(1).to_numpy().astype(np.int64) * 2 + part.column(2).to_numpy())[of]
            once = np.unique(np.stack((of, terms.view(np.int64), stem, group), 1), axis=0)[:, 1:]
            u, n = np.unique(once, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u[:, 0])), pa.array(u[:, 1] > 0), pa.array(u[:, 2] // 2), pa.array(u[:, 2] % 2), pa.array(n)], ["term", "stem", "half", "toxic", "n"])

    return sample.select("text", "half", "toxic").mapInArrow(rows, "term long, stem boolean, half long, toxic long, n long").groupBy("term", "stem", "half", "toxic").agg(F.sum("n").alias("n"))


def learnt_of(counts: DataFrame, totals: dict, halves: tuple[int, ...]) -> Learnt:
    """The terms that the halves' toxic texts hold surely oftener (by SURE times the log ratio's standard error)."""
    pos, neg = (sum(totals.get((h, y), 0) for h in halves) for y in (1, 0))
    c = counts.where(F.col("half").isin(*halves)).groupBy("term", "stem").agg(F.sum(F.col("n") * F.col("toxic")).alias("a"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("b")).where("a >= 3")
    ratio = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("b") + 0.5) / (neg + 1))
    c = c.withColumn("ratio", ratio).withColumn("sure", F.col("ratio") / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5)))
    return Learnt(c.where((F.col("ratio") >= float(FAIR)) & (F.col("sure") > SURE)).orderBy(F.desc("sure"), "term").limit(LEARNT).select("term", "ratio", "stem").collect())  # at most LEARNT


class LabelModel:
    """The share of toxic texts and, by class, P(a voter fires | its parent voter's vote): each class's voters depend on
    each other along a tree of their strongest correlations. A label is wrong with chance ERROR."""

    def __init__(self):
        n = len(VOTERS)
        self.share = 0.1
        self.parent = np.zeros(n, np.int64)
        self.start = np.array([[0.3] * n, [0.005] * n])
        self.start[:, -1] = 0.2, 0.8  # "nothing" speaks for clean
        self.fire = np.repeat(self.start[:, None], 2, 1)  # class, parent's vote, voter

    def posterior(self, bits: np.ndarray, label: np.ndarray) -> np.ndarray:
        """P(toxic) of each vote pattern; label: 1, 0, or -1 where unknown."""
        x = bits[:, None] >> np.arange(len(VOTERS)) & 1
        p = self.fire[:, x[:, self.parent], np.arange(len(VOTERS))]  # class, pattern, voter
        log = np.where(x, np.log(p), np.log1p(-p)).sum(2)
        odds = log[0] - log[1] + np.log(self.share / (1 - self.share))
        sign = np.where(label == 1, 1.0, np.where(label == 0, -1.0, 0.0))
        odds = np.where(sign == 0, odds, np.clip(odds, -DOUBT, DOUBT)) + sign * np.log(1 / ERROR - 1)
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def fit(self, bits: np.ndarray, label: np.ndarray, count: np.ndarray, rounds: int = 40) -> LabelModel:
        """Expectation-maximisation on pattern counts; from the tenth round on, voters lean on their tree parents."""
        x = (bits[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)
        known = label >= 0
        count = np.where(known, 1.0, min(1.0, count[known].sum() / max(count[~known].sum(), 1)) if known.any() else 1.0) * count
        for k in range(rounds):
            p = self.posterior(bits, label)
            w = np.stack((count * p, count * (1 - p)))
            total = w.sum(1)
            both = np.stack([(x * w[c][:, None]).T @ x for c in (0, 1)])  # class, voter, voter: both fire
            one = np.stack([w[c] @ x for c in (0, 1)])
            if k >= 10 and k % 10 == 0:
                self.parent = tree(both, one, total)
            for c in (0, 1):
                on, fired = both[c][self.parent, np.arange(len(VOTERS))], one[c][self.parent]
                self.fire[c, 1] = (on + 2 * self.start[c]) / (fired + 2)
                self.fire[c, 0] = (one[c] - on + 2 * self.start[c]) / (total[c] - fired + 2)
            root = self.parent == np.arange(len(VOTERS))
            self.fire[:, :, root] = ((one + 2 * self.start) / (total[:, None] + 2))[:, None, root]
            self.fire = np.clip(self.fire, 1e-5, 1 - 1e-5)
            self.share = float(np.clip(total[0] / max(total.sum(), 1), 1e-3, 0.5))
        return self


def tree(both: np.ndarray, one: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Each voter's parent in the spanning tree of greatest mutual information within the classes; the root is its own."""
    n = one.shape[1]
    info = np.zeros((n, n))
    for c in (0, 1):
        if total[c] > 1:
            q = one[c] / total[c]
            for i in (0, 1):
                for j in (0, 1):
                    pij = (both[c] if i and j else one[c][:, None] - both[c] if i else one[c] - both[c] if j else total[c] - one[c][:, None] - one[c] + both[c]) / total[c]
                    base = np.outer(q if i else 1 - q, q if j else 1 - q)
                    on = (pij > 1e-12) & (base > 1e-12)
                    info[on] += total[c] * pij[on] * np.log(pij[on] / base[on])
    parent, best, near = np.zeros(n, np.int64), info[0].copy(), np.zeros(n, np.int64)
    best[0] = -np.inf
    for _ in range(n - 1):
        i = int(np.argmax(best))
        parent[i], best[i] = near[i], -np.inf
        better = (info[i] > best) & np.isfinite(best)
        best[better], near[better] = info[i][better], i
    return parent


def descend(rows: list[tuple[np.ndarray, float]], w: np.ndarray, seed: int, epochs: int = 6, l2: float = 1e-4) -> np.ndarray:
    """Adagrad on the logistic loss with soft labels, small batches in a seeded order."""
    w, g2 = w.copy(), np.full(WIDTH, 1e-2)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 16)):
            idx = np.concatenate([rows[i][0] for i in part])
            lens = np.array([len(rows[i][0]) for i in part])
            at = np.concatenate(([0], np.cumsum(lens)))
            v = values(idx, at)
            d = (1 / (1 + np.exp(-tk.per_text_sum(w[idx] * v, at))) - np.array([rows[i][1] for i in part])) / len(part)
            on, inv = np.unique(idx, return_inverse=True)
            grad = np.bincount(inv, np.repeat(d, lens) * v, len(on)) + l2 * w[on]
            g2[on] += grad * grad
            w[on] -= 0.3 * grad / np.sqrt(g2[on])
    return w


def descent(w: np.ndarray, seed: int, posterior: dict):
    """What a shard does in one round."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "f"])
        got = descend([(np.frombuffer(f, np.int32), posterior[b, y]) for f, b, y in zip(pdf["f"], pdf["bits"], pdf["toxic"])], w, seed)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n": [len(pdf)], "w": [got.tobytes()]})

    return run


def fit(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, shards: int = 4, rounds: int = 3) -> tuple[np.ndarray, Learnt]:
    """The classifier's weights and the learnt lexicon."""
    learn = documents.where(~held_out("doc_id", 3)).select("doc_id", "text")
    truth = labels.where(~held_out("doc_id", 3) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("long").alias("toxic"))
    chosen = F.broadcast(written(truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "toxic-truth"))  # at most max_train rows of two numbers
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    sample = written(learn.join(chosen, "doc_id").select("doc_id", "text", "toxic", half.alias("half")), "toxic-sample")
    totals = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}  # at most four rows
    if not totals:
        return np.zeros(WIDTH), NOTHING
    counts = written(term_counts(sample), "toxic-terms")
    lexicons = [learnt_of(counts, totals, h) for h in ((1,), (0,), (0, 1))]  # what half 0, half 1 and all others vote with
    shared = documents.sparkSession.sparkContext.broadcast(lexicons)

    def vote_rows(batches):
        lex = lexicon()
        for part, t in tk.pieces(batches, "text"):
            bits, words, at = votes_and_words(t, lex, shared.value[2])
            u, n = np.unique(bits, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], ["bits", "n"])

    def train_rows(batches):
        lex = lexicon()
        for part, t in tk.pieces(batches, "text"):
            half = part.column(3).to_numpy()
            some = [votes_and_words(t, lex, x) for x in shared.value[:2]]
            bits = np.where(half == 0, some[0][0], some[1][0])
            f, at = features(bits, *some[0][1:])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(bits), pa.array(tk.packed(f, at), pa.binary())], ["doc_id", "toxic", "bits", "f"])

    train = written(sample.mapInArrow(train_rows, "doc_id long, toxic long, bits long, f binary").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))), "toxic-train")
    others = learn.join(chosen, "doc_id", "left_anti").select("text").mapInArrow(vote_rows, "bits long, n long")
    got = train.select("bits", F.col("toxic").alias("label"), F.lit(1).cast("long").alias("n")).unionByName(others.select("bits", F.lit(-1).cast("long").alias("label"), "n")).groupBy("bits", "label").agg(F.sum("n").alias("n")).orderBy("bits", "label").collect()  # three rows a vote pattern
    bits, label, count = (np.array([r[i] for r in got]) for i in range(3))
    model = LabelModel().fit(bits, label, count)
    posterior = {(b, y): float(p) for b, y, p in zip(bits.tolist(), label.tolist(), model.posterior(bits, label))}
    w = np.zeros(WIDTH)
    for k in range(rounds):  # each shard descends from the mean of the last round
        got = train.groupBy("shard").applyInPandas(descent(w, k, posterior), "shard long, n long, w binary").orderBy("shard").collect()  # one row a shard
        w = sum(np.frombuffer(r["w"]) * r["n"] for r in got) / sum(r["n"] for r in got)
    return w, lexicons[2]


def scored(t: tk.Texts, lex, w: np.ndarray, learnt: Learnt) -> tuple[np.ndarray, np.ndarray]:
    """Scores and vote bits of the texts."""
    bits, words, at = votes_and_words(t, lex, learnt)
    f, at = features(bits, words, at)
    return np.round(1 / (1 + np.exp(-np.clip(tk.per_text_sum(w[f] * values(f, at), at), -40, 40))), 9), bits


def toxicity(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, bits (which voters fired): one row per document."""
    fitted = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, max_train))

    def rows(batches):
        lex = lexicon()
        for part, t in tk.pieces(batches, "text"):
            score, bits = scored(t, lex, *fitted.value)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(bits)], ["doc_id", "score", "bits"])

    out = documents.select("doc_id", "text").mapInArrow(rows, "doc_id long, score double, bits long")
    return out.select("doc_id", held_out("doc_id", 3).alias("held_out"), "score", "bits")


def without_toxic(documents: DataFrame, labels: DataFrame, cut: float = CUT, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of documents that score below cut, with all their columns."""
    fitted = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, max_train))

    def rows(batches):
        lex = lexicon()
        for part, t in tk.pieces(batches, "text"):
            yield part.filter(pa.array(scored(t, lex, *fitted.value)[0] < cut))

    return documents.mapInArrow(rows, documents.schema)

"""The registered queries over whole given tables, every column of their results against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import cache
from itertools import groupby
from math import log10

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from ledgerspark.llm import entries, html_text, jaccard, mixing

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
LOW = {c: c + 32 for c in range(65, 91)}


@cache
def table(sf, name, *columns):
    return [tuple(r.values()) for r in pq.read_table(f"{sf}/{name}.parquet", columns=list(columns)).to_pylist()]


def texts(sf):
    return {i: t or "" for i, t in table(sf, "documents", "doc_id", "text")}


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s)


def result(spark, name, sf, *columns):
    return {r[0]: tuple(r[1:]) for r in entries.QUERIES[name](spark, sf).select("doc_id", *columns).collect()}


def components(texts):
    """doc_id to (set size, smallest doc_id that links reach), by an index of all shingles."""
    sets, having = {}, {}
    for i, t in texts.items():
        w = words(t.translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            having.setdefault(s, []).append(i)
    up = {i: i for i in texts}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in having[x] if j < i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


def hits(texts, items):
    """doc_id to (words, hit words, items found)."""
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    windows = {}
    for k, t in items:
        w = split((t or "").translate(LOW))
        for p in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[p : p + 10]), set()).add(str(k))
    lengths = sorted({len(x) for x in windows})
    out = {}
    for i, t in texts.items():
        w, hit, found = split(t.translate(LOW)), set(), set()
        for n in lengths:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p : p + n])) in windows:
                    hit.update(range(p, p + n))
                    found |= windows[x]
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_op1(spark):
    want = {}
    for i, t in texts(SF).items():
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        wins = Counter(zip(w, w[1:], w[2:]))
        n_repeat = len({k + j for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for j in range(3)})
        want[i] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), n_repeat, len(w) < 50 or 100 * n_repeat > 50 * len(w))
    got = result(spark, "op1_quality", SF, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {i: r[:-1] for i, r in got.items()} == want
    assert not any(kept and failed for *_, failed, kept in got.values()) and any(r[-1] for r in got.values())


def test_op2(spark):
    assert result(spark, "op2_jaccard", SF, "n_shingles", "component_id") == components(texts(SF))


def test_op2_with_huge_groups(spark, monkeypatch):
    """The same links when groups of few documents already count as huge."""
    monkeypatch.setattr(jaccard, "HUGE", 6)
    assert result(spark, "op2_jaccard", SF, "n_shingles", "component_id") == components(texts(SF))


def test_huge_groups_of_near_copies(spark, monkeypatch):
    """160 texts of one hundred words with one to four of eight changes: some link to the hub, some only to each other, some to none."""
    monkeypatch.setattr(jaccard, "HUGE", 6)
    rng, made = random.Random(7), {}
    for i in range(160):
        w = [f"w{k}" for k in range(100)]
        for k in rng.sample(range(8), rng.randint(1, 4)):
            w[6 + 12 * k] = f"x{rng.randint(0, 3)}"
        made[i] = " ".join(w)
    found = jaccard.near_duplicates(spark.createDataFrame(list(made.items()), "doc_id long, text string").coalesce(2)).collect()
    want = components(made)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert len({c for _, c in want.values()}) > 1


def test_op4(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    tok.no_truncation(), tok.no_padding()
    want = {}
    for i, t in texts(SF).items():
        n = len(tok.encode(t, add_special_tokens=False).ids)
        want[i] = (len(t.encode()), n, n > 2048)
    assert result(spark, "op4_tokens", SF, "n_bytes", "n_tokens", "over_limit") == want


def test_op6(spark):
    seen, want = set(), {}
    for i, t in sorted(texts(SMALL).items()):
        b = t.encode()
        gone = [False] * len(b)
        for s in range(len(b) - 99):
            h = b[s : s + 100]
            if h in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(h)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), len(b) - len(kept), sum(k for k, _ in groupby(gone)), hashlib.sha256(kept).hexdigest())
    assert result(spark, "op6_repeats", SMALL, "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_op7(spark):
    size = {i: (s, len(words(t or ""))) for i, s, t in table(SF, "documents", "doc_id", "source", "text")}
    total = Counter()
    for s, n in size.values():
        total[s] += n
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s)))}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(total)
    while over := {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * total[s]}:
        target |= {s: 2.0 * total[s] for s in over}
        left, open_ = left - sum(2 * total[s] for s in over), open_ - over
    target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
    got = result(spark, "op7_mixing", SF, "size", "source_size", "target", "taken")
    taken = Counter()
    assert got.keys() == size.keys()
    for i, (n, all_, aim, took) in got.items():
        s = size[i][0]
        assert (n, all_) == (size[i][1], total[s]) and aim == pytest.approx(target[s]) and took <= 2 * n and (not n or took % n == 0)
        taken[s] += took
    assert all(abs(taken[s] - target[s]) <= max(10, 0.005 * target[s]) for s in total), (taken, target)
    assert got == result(spark, "op7_mixing", SF, "size", "source_size", "target", "taken")


def test_op7_repeated_rows(spark, monkeypatch):
    """Rows that repeat are counted, not gathered: none is lost, and the words come near their target."""
    monkeypatch.setattr(mixing, "REPEATS", 100)
    rows = [(1, "a b c", "x")] * 3000 + [(None, "a b c d", "x")] * 2 + [(None, None, "x")] * 3 + [(i, "w " * (i % 60), "y") for i in range(500)] + [(i, "w " * (i % 90), None) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=64).collect()
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, len(words(t or ""))) for i, t, s in rows)
    for s in ("x", "y", None):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 5 and all(r["taken"] <= 2 * r["size"] for r in own), s


def test_op8(spark):
    tokens = {i: [*words(t.translate(LOW)), None] for i, t in texts(SF).items()}
    out = {i for i in tokens if zlib.crc32(str(i).encode()) % 5 == 1}
    c = Counter(w for i, t in tokens.items() if i not in out for w in t)
    n, v = sum(c.values()), len(c)
    got = result(spark, "op8_lm", SF, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert {i: r[:4] for i, r in got.items()} == {i: (i in out, len(t), sum(c[w] > 0 for w in t), n) for i, t in tokens.items()}
    for i, t in tokens.items():
        assert got[i][4] == pytest.approx(sum(log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) and got[i][5] <= 0
    assert sum(got[i][5] for i in out) > sum(got[i][4] for i in out)  # better than single words where it didn't learn


def test_op10(spark):
    want = {i: (n, h, len(k), hashlib.sha256(",".join(k).encode()).hexdigest(), h > 0) for i, (n, h, k) in hits(texts(SF), table(SF, "benchmark", "item_id", "text")).items()}
    assert result(spark, "op10_decontaminate", SF, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_op5_on_held_out_rows(spark):
    toxic = dict(table(SF, "labels", "doc_id", "toxic"))
    got = result(spark, "op5_toxicity", SF, "held_out", "score", "predicted")
    assert got.keys() == texts(SF).keys()
    for i, (held, score, predicted) in got.items():
        assert held == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= score <= 1 and predicted == (score >= 0.7)
    rows = [(toxic[i], p) for i, (held, _, p) in got.items() if held and toxic.get(i) is not None]
    bad, good = [p for t, p in rows if t == 1], [p for t, p in rows if t == 0]
    assert sum(good) <= 0.02 * len(good) and sum(bad) >= 0.5 * len(bad), (sum(bad), len(bad), sum(good), len(good))


def test_op9_votes(spark):
    """A page whose largest container is not the host's main path is extracted from the host's path; alone, from its own."""
    story = "<div class='story{}'><p>The story of page {} is told here, in more than forty characters.</p></div>"
    other = "<div class='blurb'><p>" + "Long words on the side of the page. " * 30 + "</p></div>"
    pages = [(k, f"http://one/{k}", f"<body>{story.format(k, k)}</body>") for k in range(1, 6)]
    odd = f"<body>{story.format(9, 9)}{other}</body>"
    rows = spark.createDataFrame([*pages, (9, "http://one/9", odd), (10, "http://two/1", odd), (11, None, odd), (12, "http://one/9", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(rows).collect()}
    assert all(got[k] == f"The story of page {k} is told here, in more than forty characters." for k in (1, 2, 3, 4, 5, 9))
    assert got[10] == got[11] == ("Long words on the side of the page. " * 30).strip() and got[12] == ""


def test_pipeline_stages(spark):
    """Each stage's decisions on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [texts(SF)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"contract-{name}")
        if name != "mixing":
            assert docs.columns == columns
            kept.append({i: t or "" for i, t in docs.select("doc_id", "text").collect()})
    toxic, near, clean, pii = kept[1:]
    assert toxic.keys() == {i for i, (p,) in result(spark, "op5_toxicity", SF, "predicted").items() if not p}
    assert near.keys() == {i for i, (_, c) in components(toxic).items() if i == c} and all(near[i] == toxic[i] for i in near)
    assert clean.keys() == {i for i, (_, h, _) in hits(near, table(SF, "benchmark", "item_id", "text")).items() if not h}
    assert pii.keys() == clean.keys() and all(pii[i] == t for i, t in clean.items() if not re.search("[0-9@]", t))
    mixed = docs.collect()
    assert {r["doc_id"] for r in mixed} <= pii.keys() and all(r["size"] == len(words(pii[r["doc_id"]])) and 0 < r["taken"] <= 2 * r["size"] for r in mixed)
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, again)) == sorted(map(str, mixed))

"""The ten operators on small tables with nulls, empty texts, copies and clashing columns, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from ledgerspark.llm import decontaminate, html_text, jaccard, language_model, mixing, pii, quality, repeats, token_counts, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed + 3) + i) % 20] + str((seed * i) % 7) for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = text(1, 120)
    rows = [(1, base, "a"), (2, base, None), (3, base.replace("beta1", "x", 1) + " tail", "b"), (4, None, "b"), (5, "", "a"), (6, "one two", "c"), (7, "One TWO", "c"),
            (8, text(2, 200) + " " + base[:400], "a"), (9, text(5, 60), "c"), (10, "you are a stupid idiot and a pathetic loser", "b"), (11, "Ünïcödé   été " * 30, "a"), (12, text(9, 30) * 3, None)]
    return spark.createDataFrame([(*r, 0, "clash") for r in rows], "doc_id long, text string, source string, n long, c string").repartition(3).cache()


def plain(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s)


def test_near_duplicates(docs):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t.lower() if t.isascii() else t)) else set() for i, t in plain(docs).items()}
    part = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(docs).collect()}
    assert {i: v[1] for i, v in got.items()} == part
    assert all(got[i][0] == len(s) for i, s in sets.items() if i != 11)


def test_repeats(docs):
    seen = set()
    for r in sorted(repeats.remove_repeats(docs).collect(), key=lambda r: r["doc_id"]):
        b = (plain(docs)[r["doc_id"]]).encode()
        gone = [False] * len(b)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = [True] * 100
            seen.add(b[s : s + 100])
        assert bytes(r["kept"]) == bytes(x for x, g in zip(b, gone) if not g)


def test_suffix_order():
    import numpy as np

    raw = np.frombuffer(b"banana band bandana ban", np.uint8)
    at = np.arange(len(raw))
    s = repeats.Suffixes(raw, at, np.full(len(raw), len(raw)))
    order = s.order(np.zeros(len(raw), np.uint64))
    assert [raw.tobytes()[i:] for i in order] == sorted(raw.tobytes()[i:] for i in at)


def test_language_model(docs):
    toks = {i: [*words(t.lower() if t.isascii() else t), "\0"] for i, t in plain(docs).items()}
    train = Counter(w for i, t in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in t)
    for r in language_model.scores(docs).collect():
        if r["doc_id"] != 11:
            assert (r["n_tokens"], r["n_known"]) == (len(toks[r["doc_id"]]), sum(train[w] > 0 for w in toks[r["doc_id"]]))
        assert r["score"] <= 0 and r["base_score"] <= 0


@pytest.mark.parametrize("numbered", [3, 20, 65535])
def test_language_model_counts(docs, monkeypatch, numbered):
    """Every pair counts, whatever words have numbers: scores against counts of all training pairs."""
    monkeypatch.setattr(language_model, "FREQUENT", numbered)
    weights = language_model.fit(docs).weights
    tokens = {i: [*words(re.sub("[A-Z]", lambda m: m[0].lower(), t)), None] for i, t in plain(docs).items()}
    train = [t for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    one, two = Counter(w for t in train for w in t), Counter(p for t in train for p in zip([None, *t], t))
    n = sum(one.values())
    for r in language_model.scores(docs).collect():
        t, score = tokens[r["doc_id"]], 0.0
        for v, w in zip([None, *t], t):
            lam = weights[min(one[v].bit_length(), language_model.BUCKETS - 1)]
            score += math.log10(lam[0] * two[v, w] / max(one[v], 1) + lam[1] * one[w] / n + lam[2] / (len(one) + 1))
        assert r["score"] == pytest.approx(score), r
        assert r["n_known"] == sum(one[w] > 0 for w in t) and r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 0.5) / (n + 0.5 * (len(one) + 1))) for w in t))


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(text(1, 120).split()[10:40])), (2, "one two"), (3, None), (4, "")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, bench).collect()}
    assert len(got) == 12 and got[1]["n_hit"] == 30 and got[1]["items"] == ["1"]
    assert got[6]["items"] == got[7]["items"] == ["2"] and got[7]["n_hit"] == 2 and not got[4]["contaminated"] and not got[9]["contaminated"]


def test_pii(spark):
    rows = [(1, "card 4111111111111111 and 4111 1111 1111 1111, born 2001-02-28"), (2, "again 4111111111111111! 28.02.2001 ip 10.0.0.1 mail a.b@c.org"), (3, None), (4, ""), (5, "no data 2001-02-30, 12 apples, version 3.5")]
    got = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    one, two = re.findall(r"\d{16}", got[1]["text"]), re.findall(r"\d{16}", got[2]["text"])
    assert one == two and one[0] != "4111111111111111" and re.search(r"(?:\d{4} ){3}\d{4}", got[1]["text"])[0].replace(" ", "") == one[0]
    digits = [int(x) for x in one[0]][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    y, m, d = re.search(r"(\d{4})-(\d\d)-(\d\d)", got[1]["text"]).groups()
    assert f"{d}.{m}.{y}" in got[2]["text"] and got[5]["text"] == rows[4][1] and got[3]["text"] is None and got[4]["text"] == ""


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 12 and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


def test_scores_and_counts(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = token_counts.opened(path)
    for r in token_counts.token_counts(docs, path, table=5).collect():
        assert r["n_tokens"] == len(tok.encode(plain(docs)[r["doc_id"]], add_special_tokens=False).ids)
    labels = spark.createDataFrame([(i, 1, int(i == 10)) for i in range(1, 13)], "doc_id long, quality int, toxic int")
    tox = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(tox) == 12 and tox[10]["score"] == max(r["score"] for r in tox.values())
    q = {r["doc_id"]: r for r in quality.quality(docs, labels.where("quality = 1")).collect()}
    w = words(plain(docs)[12])
    wins = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if wins[tuple(w[k : k + 3])] > 1 for j in range(3)}
    assert q[12]["n_repeat_words"] == len(covered) and q[4]["base_failed"] and q[5]["n_words"] == 0


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert jaccard.near_duplicates(none).count() == repeats.remove_repeats(none).count() == mixing.mix(none).count() == 0
    assert language_model.scores(none).count() == toxicity.toxicity(none, labels).count() == quality.quality(none, labels).count() == 0


def test_html(spark):
    pages = [(1, "http://h/1", "<body><nav><a href=x>menu</a></nav><article><h1>T &amp; t</h1><p>Long enough text\n here.<p>More<br>text</article><footer>f</footer>"), (2, None, None), (3, "http://h/3", "")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "T & t\nLong enough text here.\nMore text", 2: "", 3: ""}


def test_hash_is_hex():
    assert re.fullmatch("[0-9a-f]{64}", hashlib.sha256(b"").hexdigest())

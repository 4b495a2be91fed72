"""Whitening and hard negatives against brute force: whole given tables and small tables of hard rows."""

import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerspark.llm import entries, negatives, whitening

SF = "/root/testdata/sf0.01"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def floored(v):
    return [math.floor(256 * float(x)) for x in v]


def read():
    return [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]


def check_whitening(rows, got, top=4):
    rows = [(i, floored(v)) for i, v, *_ in rows if usable(v)]
    dims = max((len(v) for _, v in rows), default=0)
    rows = [(i, v + [0] * (dims - len(v))) for i, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in rows}), np.int64)
    n, sums = len(fit), [int(s) for s in fit.sum(0)]
    c = fit - np.array([s / n for s in sums])
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(top, dims)
    by = {}
    for r in got:
        by.setdefault((-1 if r["vec_id"] is None else r["vec_id"], r["component"]), []).append(r)
    assert sum(map(len, by.values())) == len(rows) * k
    for m in range(k):
        signs = set()
        for i, v in rows:
            want = float((np.array(v) - np.array([s / n for s in sums])) @ u[:, m] / math.sqrt(e[m])) if e[m] > 1e-9 else 0.0
            deviation = sum((n * a - s) ** 2 for a, s in zip(v, sums))
            same = [r for r in by[-1 if i is None else i, m + 1] if r["n"] == n and r["deviation"] == deviation and abs(abs(r["whitened"]) - abs(want)) < 1e-7]
            assert same, (i, m)
            if abs(want) > 1e-6:
                signs.add(same[0]["whitened"] * want > 0)
            assert same[0]["explained"] == pytest.approx(e[m] / e.sum() if e.sum() > 0 else 0.0, abs=1e-9) and same[0]["identity_error"] <= 1e-9
        assert len(signs) <= 1


@pytest.mark.parametrize("batch", [1 << 16, 1])
def test_whitening_of_the_table(spark, batch):
    check_whitening(read(), whitening.whiten(spark.read.parquet(f"{SF}/embeddings.parquet").repartition(11), batch=batch).collect())


def test_whitening_query(spark):
    got = entries.QUERIES["op11_whitening"](spark, SF).collect()
    check_whitening(read(), got)


HARD = [(1, [0.5, 0.1, -0.25], 1), (1, [0.5, 0.1, -0.25], 1), (2, [0.5, None, 0.0], 1), (3, None, 2), (None, [0.25, -1.0, 3.0], 2), (4, [float("nan"), 0.0, 0.0], 1), (5, [float("inf"), 0.0, 0.0], 1), (6, [0.1, 0.2], 0), (7, [], 3), (8, [1e5, 3.0, 2.0], None), (1, [0.0, 0.1, 0.7], 2)]
KIND = "vec_id long, embedding array<double>, label int, x long, part string, n double"


def hard(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 0, "x", 0.0) for r in rows], KIND).repartition(parts)


@pytest.mark.parametrize("rows", [HARD, HARD[:2], [(i, [float(i % 3), 2.0 * (i % 3), 1.0, 0.0, 5.0], 0) for i in range(40)]])
def test_whitening_of_hard_rows(spark, rows):
    check_whitening(rows, whitening.whiten(hard(spark, rows)).collect())


def test_empty_tables(spark):
    for rows in ([], HARD[2:4], [(1, [], 1), (100, [], 2)]):
        assert whitening.whiten(hard(spark, rows)).count() == 0
        assert negatives.hard_negatives(hard(spark, rows)).count() == 0


def test_deviation_beyond_a_long(spark):
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(hard(spark, [(1, [4e6, 1.0], 1), (2, [0.0, 1.0], 1), (3, [1.2e7, 1.0], 1)])).collect()}
    xs = {1: 4_000_000 * 256, 2: 0, 3: 12_000_000 * 256}
    total = sum(xs.values())
    want = {i: (3 * x - total) ** 2 for i, x in xs.items()}
    assert got == {i: v if v < 2**63 else None for i, v in want.items()}
    ends = [r["deviation"] for r in whitening.whiten(hard(spark, [(1, [1e300], 1), (2, [-1e300], 1), (3, [0.0], 1)])).collect()]
    assert len(ends) == 3 and sum(d is None for d in ends) == 2


def test_updates_equal_the_decomposition():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(0, 40, (70, 12)))
    x[:, 9:] = x[:, :3]  # without full rank
    for at in (1, 5, 70):
        s, t = whitening.Spectrum(12), whitening.Spectrum(12)
        for i in range(0, 40, at):
            s.take(x[i : min(i + at, 40)])
        t.take(x[40:])
        s.join(t)
        c = x - x.mean(0)
        assert np.abs(s.q * s.d @ s.q.T - c.T @ c).max() < 1e-8 and np.abs(s.q.T @ s.q - np.eye(12)).max() < 1e-12


def mined(rows):
    """Every row of the result, in plain Python."""
    part = []
    for i, v, y in rows:
        if i is not None and y is not None and usable(v):
            part.append((i, (y + 1) % 10 if i % 7 == 0 else y, floored(v)))
    out = []
    for i, y, v in {(i, y, tuple(v)) for i, y, v in part if i % 100 == 0}:
        others = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in part if j != i)
        for s, j, _ in [o for o in others if o[2] == y][:5]:
            inside = [o for o in others if o[2] != y and 30 * -s <= 100 * -o[0] <= 90 * -s][:10]
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k, _) in enumerate(inside)]
    return sorted(out)


def test_hard_negatives_query(spark):
    assert sorted(map(tuple, entries.QUERIES["op13_hard_negatives"](spark, SF).collect())) == mined(read())


def test_hard_negatives_in_small_pieces(spark, monkeypatch):
    rows = [(i * 50, [((i * j) % 11 - 5) / 4 for j in range(1, 7)], i % 3) for i in range(60)] + [(100, [0.5] * 6, 1), (100, [0.5] * 6, 1), (200, [1.0, 2.0], 0), (350, [0.25] * 6, -4)]
    rows += [(7000 + i, [1.0] * 6, 2) for i in range(40)] + HARD  # ties
    monkeypatch.setattr(negatives, "BLOCK", 3)
    monkeypatch.setattr(negatives, "HELD", 1500)
    assert sorted(tuple(r)[:6] for r in negatives.hard_negatives(hard(spark, rows, 5)).collect()) == mined(rows)


def test_large_components(spark):
    rows = [(i, [(-1) ** i * (2.0**17 + i), 2.0**16 * (i % 5), 3.0 - i], i % 2) for i in range(1, 120)]
    rows[99] = (100, [2.0**17, 2.0**17, 1.0], 0)
    assert sorted(tuple(r)[:6] for r in negatives.hard_negatives(hard(spark, rows)).collect()) == mined(rows)


def test_residue_products_are_exact():
    rng = np.random.default_rng(1)
    for most, dims in ((140, 64), (2**20, 64), (2**26, 100), (2**29, 7)):
        a, b = (rng.integers(-most, most + 1, (k, dims)) for k in (9, 13))
        a[0], b[0], b[1] = most, -most, most
        assert (negatives.products(negatives.Residues(a), negatives.Residues(b)) == (a.astype(object) @ b.T.astype(object)).astype(np.int64)).all()

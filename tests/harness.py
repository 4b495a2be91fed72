"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(names, rows):
    by = sorted(range(len(names)), key=lambda i: names[i])

    def plain(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return str(x)
        x = float(x)
        return "nan" if math.isnan(x) else f"{x:.5g}" if abs(x) >= 1 else f"{x:.4f}".replace("-0.0000", "0.0000")

    return sorted(tuple(plain(r[i]) for i in by) for r in rows)


def compare(spark, name, query, sql, sf_dir):
    df = query(spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    assert sorted(df.columns) == sorted(got.columns), (name, df.columns, got.columns)
    a, b = rows_of(df.columns, df.collect()), rows_of(got.columns, got.fetchall())
    assert len(a) == len(b), (name, len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, (name, len(bad), bad[:2])

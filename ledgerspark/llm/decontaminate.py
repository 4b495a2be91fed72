"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are lower-cased (A-Z) runs outside ASCII control, space and punctuation. A text's fingerprints are the
minimum hashes of each WINDOW consecutive GRAM-word grams, so any shared span of GRAM + WINDOW - 1 = SPAN words
has a shared fingerprint. Documents that share one with the benchmark are extended: each of their SPAN-word windows
is compared, as text, with the items' windows, and the union of the matches is the hit. An item of fewer words is
one window; where the benchmark has such items, every run of as many words is a fingerprint too.

Defined cases: null or empty texts and items have no words and match nothing; an item id that repeats counts once;
a null item id is matched but not listed; repeated document rows each get the same result; with no match n_hit and
n_items are 0 and items_sha256 is that of the empty text. Extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a side that may be broadcast, and bytes of their texts.
SMALL, BYTES = 200_000, 64 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), NOT_WORD), "")


def gram(h: Column, x: Column, i: Column, n: int) -> Column:
    """Hash of the n words from place i on; words beyond the end are skipped."""
    return F.xxhash64(F.lit(n), x, *(F.get(h, i + j) for j in range(1, n)))


def runs_of(hashes: Column, n: int) -> Column:
    return F.transform(hashes, lambda x, i: gram(hashes, x, i, n))


def fingerprints(df: DataFrame, keep: list[str], short: list[int]) -> DataFrame:
    """keep and fps, the winnowed fingerprints and all runs of the lengths in short; df has the word hashes h. The grams
    get a column of their own: inside the lambda each reference would compute them anew."""
    df = df.select(*keep, "h", F.transform("h", lambda x, i: gram(F.col("h"), x, i, GRAM)).alias("g"))
    least = F.transform("g", lambda x, i: F.least(x, *(F.get("g", i + j) for j in range(1, WINDOW))))
    return df.select(*keep, F.array_distinct(F.concat(least, *(runs_of(F.col("h"), n) for n in short))).alias("fps"))


def prepared(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, words(F.col("text")).alias("w"))


def windows_of(n: int) -> Column:
    """All windows of n of the words w."""
    starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), F.array_join(F.slice("w", i, n), " ").alias("win")))


def windows(df: DataFrame, keep: list[str], short: list[int]) -> DataFrame:
    """keep, at, len, win: all windows of SPAN words and of the lengths in short, as text; df has w."""
    every = [windows_of(n) for n in (*short, SPAN)]
    return df.select(*keep, F.explode(F.concat(*every)).alias("x")).select(*keep, "x.*")


def sided(df: DataFrame) -> DataFrame:
    """Broadcast where the counted rows are few and their texts short; else Spark shuffles and splits skewed keys."""
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if n <= SMALL and size <= BYTES else df


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted strings), n_items, contaminated: one row per document."""
    items = written(prepared(benchmark.select(F.col("item_id"), F.col("text")), ["item_id"]).where(F.size("w") > 0), "bench-words")
    short = [r[0] for r in items.where(F.size("w") < SPAN).select(F.size("w")).distinct().orderBy(F.size("w")).collect()]  # at most SPAN - 1 lengths
    item_windows = windows(items.where(F.size("w") >= SPAN), ["item_id"], [])
    if short:
        item_windows = item_windows.unionByName(items.where(F.size("w") < SPAN).select("item_id", F.lit(1).alias("at"), F.size("w").alias("len"), F.array_join("w", " ").alias("win")))
    item_windows = written(item_windows.select("win", F.col("item_id").cast("string").alias("item")).distinct(), "bench-windows")

    hashed = F.transform("w", lambda x: F.xxhash64(x))
    long_items = items.where(F.size("w") >= SPAN).select(hashed.alias("h"))
    # explode_outer: the optimizer would filter explode's input by size(fps) > 0, pushed below the columns of h and g,
    # which each lambda would then compute anew
    long_items = fingerprints(long_items, [], []).select(F.explode_outer("fps").alias("fp")).where("fp IS NOT NULL")
    marks = long_items
    for n in short:
        marks = marks.unionByName(items.where(F.size("w") == n).select(hashed.alias("h")).select(gram(F.col("h"), F.get("h", F.lit(0)), F.lit(0), n).alias("fp")))
    marks = written(marks.distinct(), "bench-marks")

    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    docs = documents.select("doc_id", "text")
    seen = docs.select("doc_id", key, words(F.col("text")).alias("w")).select("doc_id", "key", F.size("w").cast("long").alias("n_words"), hashed.alias("h"))
    seen = fingerprints(seen, ["doc_id", "key", "n_words"], short).select("doc_id", "key", "n_words", F.explode_outer("fps").alias("fp"))
    seen = seen.join(sided(marks.withColumn("found", F.lit(True))), "fp", "left").groupBy("doc_id", "key", "n_words").agg(F.coalesce(F.max("found"), F.lit(False)).alias("found"))
    seen = written(seen, "doc-marks")

    found = seen.where("found").select(F.col("doc_id").alias("id"), F.col("key").alias("k"))
    mine = docs.select("doc_id", key, "text").join(sided(found), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k"))).select("doc_id", "key", "text").dropDuplicates(["doc_id", "key"])
    hits = windows(prepared(mine, ["doc_id", "key"]), ["doc_id", "key"], short).join(sided(item_windows), "win").select("doc_id", "key", "at", "len", "item")
    hits = written(hits, "doc-hits")
    order = Window.partitionBy("doc_id", "key").orderBy("at", "len")
    end = F.col("at") + F.col("len")
    before = F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = hits.select("doc_id", "key", "at", "len").distinct().withColumn("new", F.greatest(end - F.greatest(F.col("at"), before), F.lit(0)))
    covered = runs.groupBy("doc_id", "key").agg(F.sum("new").cast("long").alias("n_hit"))
    which = hits.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    marked = covered.join(which, (covered["doc_id"].eqNullSafe(which["doc_id"])) & (covered["key"] == which["key"])).select(covered["doc_id"].alias("id"), covered["key"].alias("k"), "n_hit", "items")
    base = docs.select("doc_id", key)
    counted = seen.select(F.col("doc_id").alias("id2"), F.col("key").alias("k2"), "n_words")
    out = base.join(counted, base["doc_id"].eqNullSafe(counted["id2"]) & (base["key"] == counted["k2"])).join(marked, base["doc_id"].eqNullSafe(marked["id"]) & (base["key"] == marked["k"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(base["doc_id"], F.col("key"), "n_words", n_hit.alias("n_hit"), listed.alias("items"), F.size(listed).cast("long").alias("n_items"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT *, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
       FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
cov AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hits GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""

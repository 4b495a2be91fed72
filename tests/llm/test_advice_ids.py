"""Near copies where ids are null or repeated."""

import corpus_pipeline
from ledgerspark.llm import jaccard

A = [f"word{i}" for i in range(100)]
#: Neighbours in the chain link; its ends do not.
CHAIN = [" ".join([*A[k:], *(f"tail{i}" for i in range(k))]) for k in (0, 10, 20)]
OTHER = " ".join(f"other{i}" for i in range(80))
SCHEMA = "doc_id long, text string, source string"


def components(spark, rows):
    return sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())


def test_document_without_id_bridges_two(spark):
    assert components(spark, [(5, CHAIN[0], "a"), (6, CHAIN[2], "a")]) == [(5, 5), (6, 6)]
    assert components(spark, [(5, CHAIN[0], "a"), (None, CHAIN[1], "a"), (6, CHAIN[2], "a")]) == [(0, 5), (5, 5), (6, 5)]


def test_unlike_texts_under_one_id(spark):
    rows = [(1, CHAIN[0], "a"), (1, OTHER, "a"), (2, CHAIN[1], "a"), (3, OTHER + " end", "a"), (4, OTHER + " end", "b")]
    assert components(spark, rows) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 1)]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame([*rows, rows[0], (None, OTHER, "c"), (7, None, "c"), (7, None, "c")], SCHEMA), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(0, OTHER), (1, CHAIN[0]), (1, OTHER), (7, "")])

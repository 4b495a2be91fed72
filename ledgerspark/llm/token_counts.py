"""Token counts by a map-side two-tier lookup; the texts' pre-tokens are never shuffled (to build the table, each task
passes on the counts of at most PER_TASK frequent chunks).

A chunk is a run of bytes outside ASCII white space. The normaliser and the pre-tokeniser of the vocabulary
never join across white space, so a text's tokens are the sum over its chunks. Tier one is a broadcast table of
frequent chunks and their token counts, at most TABLE entries. Tier two encodes misses and keeps their counts in
a cache of the worker, at most CACHE entries of at most LONG bytes; longer chunks are encoded where they occur. Every count is exact; the tables only save time.
A task encodes on its own thread: its misses come a few at a time, and a pool of threads costs more than their encoding.

Defined cases: null or empty text has 0 bytes and 0 tokens; repeated rows and null ids are each counted; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE = 100_000
CACHE = 1_000_000
PER_TASK = 20_000
LONG = 64
OUT = "doc_id long, n_bytes long, n_tokens long"


def frequent_chunks(texts: DataFrame, table: int = TABLE, per_task: int = PER_TASK) -> list[bytes]:
    """Frequent chunks of the corpus: each task counts its own and passes on its per_task most frequent, so what
    is summed is bounded by tasks x per_task, whatever the text. A miss here costs time, never a wrong count."""

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                if x.is_valid:
                    seen.update(x.as_buffer().to_pybytes().split())
            if len(seen) > 20 * per_task:
                seen = Counter(dict(seen.most_common(10 * per_task)))
        top = [(c, n) for c, n in seen.most_common(per_task) if len(c) <= LONG]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["chunk", "n"])

    rows = texts.select("text").mapInArrow(count, "chunk binary, n long").groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(table)
    return [bytes(r[0]) for r in rows.select("chunk").collect()]  # at most table rows


def opened(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def counted(tok, chunks: list[bytes]) -> dict[bytes, int]:
    """Token counts of chunks, for calls inside tasks: without the library's threads in this process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the library reads it at each call
    return {c: len(e.ids) for c, e in zip(chunks, tok.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False))}


_caches: dict[str, dict[bytes, int]] = {}


def worker_cache(path: str) -> dict[bytes, int]:
    """The cache of this worker process: it lives on between its tasks."""
    return _caches.setdefault(path, {})


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 2048, table: int = TABLE) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit); tokenizer: a tokenizers .json on every executor."""
    spark = documents.sparkSession
    top = frequent_chunks(documents, table)
    tok = opened(tokenizer)
    lengths = [len(e.ids) for e in tok.encode_batch([c.decode() for c in top], add_special_tokens=False)]
    tier1 = spark.sparkContext.broadcast(dict(zip(top, lengths)))

    def rows(batches):
        tok = None
        first = tier1.value
        cache = worker_cache(tokenizer)
        for batch in batches:
            n_bytes, counts = [], []
            for x in batch.column(1):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                chunks = raw.split()
                got = list(map(first.get, chunks))
                if None in got:
                    miss = [c for c, n in zip(chunks, got) if n is None]
                    new = [c for c in dict.fromkeys(miss) if c not in cache]
                    if new:
                        tok = tok or opened(tokenizer)
                        if len(cache) + len(new) > CACHE:
                            cache.clear()
                            new = list(dict.fromkeys(miss))
                        fresh = counted(tok, new)
                        cache.update((c, n) for c, n in fresh.items() if len(c) <= LONG)
                    else:
                        fresh = cache
                    counts.append(sum(n for n in got if n is not None) + sum(fresh[c] if c in fresh else cache[c] for c in miss))
                else:
                    counts.append(sum(got))
                n_bytes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(rows, OUT).withColumn("over_limit", F.col("n_tokens") > limit)

"""op4's tasks encode their misses on their own thread. The task function is taken out of the operator and run in a process of its own."""

import subprocess
import sys

import pytest

pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

TASK = """
import os, sys
from types import SimpleNamespace as N
import pyarrow as pa
from ledgerspark.llm import token_counts as tc

class Documents:
    sparkSession = N(sparkContext=N(broadcast=lambda value: N(value=value)))
    select = withColumn = lambda self, *_: self

    def mapInArrow(self, task, _):
        self.task = task
        return self

tc.F = N(col=lambda _: 0)
tc.frequent_chunks = lambda *_: []
opened, tc.opened = tc.opened, lambda _: N(encode_batch=lambda *_, **__: [])  # the driver's part, in a process of its own
texts = [" ".join(f"w{chr(97 + i % 26)}x{i}y{j}" for j in range(40)) for i in range(100)]
task = tc.token_counts(Documents(), sys.argv[1]).task
tc.opened = opened
before = len(os.listdir("/proc/self/task"))
got = [n for b in task([pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(texts)], ["doc_id", "text"])]) for n in b.column(2).to_pylist()]
after = len(os.listdir("/proc/self/task"))
tok = tc.opened(sys.argv[1])
assert got == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
print(after - before)
"""


def test_no_threads_of_the_library():
    done = subprocess.run([sys.executable, "-c", TASK, public_tokenizers.path("word_bpe_49k.json")], capture_output=True, text=True, check=True, timeout=120)
    assert int(done.stdout) == 0

"""Numbers of any length cost in proportion to it."""

import time

from ledgerspark.llm import pii


def test_a_number_of_100_000_digits(spark):
    digits = "".join(str((i * i + 3 * i) % 10) for i in range(100_000))
    df = spark.createDataFrame([(1, f"no {digits} end"), (2, digits), (3, "4111 1111 1111 1111 and 2024-01-02")], "doc_id long, text string")
    pii.pseudonymise(df.where("doc_id = 3"), "k").collect()  # code is compiled
    start = time.time()
    got = {r["doc_id"]: r for r in pii.pseudonymise(df, "k").collect()}
    assert time.time() - start < 10
    new = got[2]["text"]
    assert len(new) == 100_000 and new.isdigit() and new != digits and got[1]["text"] == f"no {new} end" and got[1]["pii_kinds"] == ["number"]
    assert sum(a == b for a, b in zip(new, digits)) < 15_000

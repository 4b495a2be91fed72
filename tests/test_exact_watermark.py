"""Rows within the millisecond of a watermark, over two deliveries."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.streaming import arrivals, streams

DAY = 86400


def part(spark, *rows):
    return spark.createDataFrame([(i, 1, us) for i, us in rows], "event_id long, user_id long, us long").select("event_id", "user_id", F.timestamp_micros("us").alias("ts"))


@pytest.fixture(scope="module")
def parts(spark):
    """The watermark comes to stand at 5 days less than the last time, 900 microseconds after a millisecond. Of the second delivery, one row is a
    microsecond after it, one just at it and one before it, all within that millisecond; one has the first row's id."""
    end = (1704067200 + 20 * DAY) * 1_000_000 + 900
    mark = end - 5 * DAY * 1_000_000
    return mark, [part(spark, (1, end), (2, mark + 5)), part(spark, (3, mark + 1), (4, mark), (5, mark - 300), (1, end))]


def test_late_rows_to_the_microsecond(parts):
    out, dropped = arrivals.delivered(parts[1], lambda e: streams.deduplicated(e, "5 days"))
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2, 3] and dropped == 2 and out.columns == ["event_id", "user_id", "ts"]


def test_sessions_to_the_microsecond(spark, parts):
    """A session is late when its end isn't after the watermark; a later delivery closes the others."""
    mark, gap = parts[0], 300_000_000
    deliveries = [parts[1][0], part(spark, (3, mark - gap + 1), (4, mark - gap), (5, mark - gap - 300)), part(spark, (6, mark + 30 * DAY * 1_000_000))]
    out, dropped = arrivals.delivered(deliveries, lambda e: streams.burst_sessions(e, "5 minutes", "5 days"))
    got = sorted((r["s"], r["e"], r["n"]) for r in out.select(F.unix_micros("session.start").alias("s"), F.unix_micros("session.end").alias("e"), "n").collect())
    end = mark + 5 * DAY * 1_000_000
    assert got == [(mark - gap + 1, mark + 1, 1), (mark + 5, mark + 5 + gap, 1), (end, end + gap, 1)] and dropped == 2

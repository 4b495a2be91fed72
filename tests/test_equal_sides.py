"""Comparisons whose sides are equal in exact arithmetic, where sums of doubles depend on the order of rows."""

import random
from decimal import Decimal

from ledgerspark.operators import features as f

COLUMNS = "TransactionID long, card1 long, addr1 long, TransactionDT long, TransactionAmt double"


def test_amount_spike_of_equal_sides(spark):
    """A day of three amounts, each of them again on two other days: the day's sum is three times the mean of the nine. Card 99 has more
    than that on its day, card 98 an amount that is no number."""
    draw = random.Random(1)
    rows = []
    for card in range(60):
        day = [draw.randrange(1, 9999) / 10 for _ in range(3)]
        rows += [(9 * card + i, card, 100 if card % 2 else None, 90 * i if i < 3 else 86400 * i, a) for i, a in enumerate(3 * day)]
    rows += [(900 + i, 99, 1, 100 * i, a) for i, a in enumerate((5.0, 5.0, 5.0, 5.1))] + [(910, 98, 1, 0, float("nan")), (911, 98, 1, 1, 1.0)]
    draw.shuffle(rows)
    got = f.uid_time_bins(spark.createDataFrame(rows, COLUMNS).repartition(5))
    assert set(got.columns) >= {"uid_amount_spike", "uid_sum_24h"} and not [c for c in got.columns if c.startswith("_")]
    found = got.collect()
    assert len(found) == len(rows) and {r["card1"] for r in found if r["uid_amount_spike"]} == {99}


def test_means_of_any_order(spark):
    """Means of card and of card and month are those of exact sums, in any order of rows; very small, great and null amounts too."""
    draw = random.Random(2)
    amounts = {card: [draw.randrange(1, 9999) / 10 for _ in range(7)] for card in range(60)}
    rows = [(7 * card + i, card, 1, 100 * i, a) for card, of in amounts.items() for i, a in enumerate(of)]
    rows += [(900, 99, 1, 0, 1e-12), (901, 99, 1, 1, 3e-12), (910, 98, 1, 0, None), (911, 97, 1, 0, 1e300)]
    draw.shuffle(rows)
    df = f.time_features(spark.createDataFrame(rows, COLUMNS).repartition(5))
    got = {r["TransactionID"]: r for r in f.behavioral_profile(f.seasonal_baseline(df.withColumn("ProductCD", df.card1))).collect()}
    assert len(got) == len(rows)
    for card, of in amounts.items():
        mean = float(sum(Decimal(str(a)) for a in of)) / 7
        for i, a in enumerate(of):
            r = got[7 * card + i]
            assert (r["user_avg_amt"], r["seasonal_avg"], r["amt_vs_seasonal"]) == (mean, mean, a / mean)
    assert got[900]["user_avg_amt"] == 2e-12 and got[910]["user_avg_amt"] is None and got[911]["seasonal_avg"] == 1e300

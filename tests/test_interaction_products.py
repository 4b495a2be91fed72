"""interaction_features gives all 17 products; the four of the graph are compared with a graph made in plain Python."""

from collections import defaultdict

import pytest

from ledgerspark.operators import features as f
from ledgerspark.operators import network as g
from ledgerspark.plans import registry  # before more, which it imports
from ledgerspark.plans import more  # isort: skip
from ledgerspark.sources.views import txn_ev

SF = "/root/testdata/sf0.001"
GRAPH = ("graph_fraud_comm_x_night", "graph_fraud_comm_x_high_amt", "graph_bridge_x_unusual_device", "graph_fraud_neighbor_x_round")


def card_terms(rows):
    """card: share of its community's cards with fraud, bridge as GIVEN, share of its neighbours with fraud."""
    bad, near = defaultdict(int), defaultdict(set)
    for r in rows:
        bad[r["card1"]] = max(bad[r["card1"]], r["isFraud"])
    for key, _, most, reach, most_rows in g.RELATIONS:
        groups = defaultdict(list)
        for r in rows:
            if r[key] is not None and r["card1"] is not None:
                groups[r[key]].append(r["card1"])
        for cards in groups.values():
            if most_rows and not 2 <= len(cards) <= most_rows:
                continue
            cards = sorted(set(cards))
            if 2 <= len(cards) <= most:
                for i, a in enumerate(cards):
                    for b in cards[i + 1 : i + 1 + reach]:
                        near[a].add(b)
                        near[b].add(a)
    terms = {None: (0, 0, 0)}
    for card in [c for c in bad if c is not None]:
        seen, todo = {card}, [card]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        terms[card] = (sum(bad[c] for c in seen) / len(seen), int(len(near[card]) >= 4), sum(bad[c] for c in near[card]) / max(len(near[card]), 1))
    return terms


def products(rows, terms):
    want = {}
    for r in rows:
        rate, bridge, ratio = terms[r["card1"]]
        want[r["TransactionID"]] = (rate * r["is_night"], rate * (r["TransactionAmt"] > 500), bridge * r["is_unusual_device"], ratio * r["is_suspicious_round"])
    return want


def test_query_shows_all_products(spark):
    got = registry.queries()["interaction_features"](spark, SF)
    made = set(f.interactions(txn_ev(spark, SF).selectExpr("*", *(f"0 AS {c}" for c in f.GRAPH))).columns) - set(txn_ev(spark, SF).columns) - set(f.GRAPH)
    assert len(made) == 17 and set(got.columns) == made | {"TransactionID"}


def test_graph_products_of_events(spark):
    rows = f.all_features(txn_ev(spark, SF)).collect()
    want = products(rows, card_terms(rows))
    got = {r["TransactionID"]: tuple(r[c] for c in GRAPH) for r in registry.queries()["interaction_features"](spark, SF).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-6)
    assert any(v[0] for v in got.values()) and any(v[1] for v in got.values()) and any(v[2] for v in got.values())


def test_components_bridges_and_rows_without_a_card(spark):
    made = []
    for card in [*range(1, 10), None]:
        key = "hub" if card and card <= 5 else f"dev_{card}"  # cards 1 to 5 share a device, 7 and 8 an address, 6 and 9 are alone
        for k in range(3):
            made.append((10 * (card or 0) + k, 86400 * k, 600.0 + k, int(card in (2, 6, 8) and k == 1), card, "W", 500 if card in (7, 8) else None, f"d{card}.example", key if k < 2 else "other"))
    docs = spark.createDataFrame(made, "TransactionID long, TransactionDT long, TransactionAmt double, isFraud int, card1 long, ProductCD string, addr1 int, P_emaildomain string, DeviceInfo string")
    docs = docs.withColumns({c: docs.ProductCD for c in ("card4", "card5", "card6")}).where("DeviceInfo <> 'other' or card1 <= 3")
    rows = f.all_features(docs).collect()
    want = products(rows, card_terms(rows))
    got = {r["TransactionID"]: tuple(r[c] for c in GRAPH) for r in more.crossed_features(docs).collect()}
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-6)
    assert got[0] == (0, 0, 0, 0) and got[10][0] == pytest.approx(0.2) and got[61][0] == 1 and got[70][3] == 1 and got[12][2] == 1

"""Personal data beside other values, and in formats with long numbers."""

import pytest

from ledgerspark.llm import pii

PHONES = ["+1 (826) 555-4081", "+1 826 555 4081", "+18265554081", "+44 20 7946 0958", "+33 6 12 34 56 78", "+49 30 1234567", "1-826-555-4081", "(826) 555-4081", "826-555-4081"]
OTHERS = {"ip": "190.137.223.18", "date": "2024-01-02", "ssn": "123-45-6789", "card": "4111 1111 1111 1111", "phone": "826-555-9999", "email": "a.b@c.org"}


def changed(spark, texts):
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    return [(r["text"], r["pii_kinds"]) for r in rows]


def test_phone_beside_another_value(spark):
    pairs = [(p, k, o) for p in PHONES for k, o in OTHERS.items()]
    alone = dict(zip([*PHONES, *OTHERS.values()], (t for t, _ in changed(spark, [*PHONES, *OTHERS.values()]))))
    assert all(a != b for a, b in alone.items())
    for (p, k, o), (got, kinds) in zip(pairs, changed(spark, [f"call {p} {o} now" for p, k, o in pairs])):
        assert got == f"call {alone[p]} {alone[o]} now" and kinds == ["phone", k], (p, o, got)


def test_phone_beside_a_plain_number(spark):
    known = [p for p in PHONES if not p.startswith("+49")]
    alone = [t for t, _ in changed(spark, known)]
    assert [t for t, _ in changed(spark, [f"{p} 2024 12" for p in known])] == [f"{a} 2024 12" for a in alone]


def test_long_match_goes_to_the_other_kinds(spark):
    (got, kinds), (alone, _) = changed(spark, ["+4111111111111111 sent", "4111111111111111 sent"])
    assert got == "+" + alone and kinds == ["card"] and "4111111111111111" not in got


@pytest.mark.parametrize("card", ["3782 822463 10005", "3782-822463-10005", "3056 930902 5904"])
def test_cards_of_three_groups(spark, card):
    (got, kinds), (plain, _) = changed(spark, [f"{card} 12", card.replace(" ", "").replace("-", "") + " 12"])
    assert kinds == ["card"] and got.replace(" ", "").replace("-", "") == plain.replace(" ", "") and card not in got


def iban_of(country, account):
    rest = int("".join(str(int(c, 36)) for c in account + country + "00")) % 97
    return f"{country}{98 - rest:02d}{account}"


ACCOUNTS = [("ES", "21000418450200051332"), ("FR", "20041010050500013026063"), ("PL", "109010140000071219812874"), ("PT", "000201231234567890154"), ("DE", "370400440532013000"), ("GB", "NWBK60161331926819"), ("RU", "04452560040702810412345678901"), ("MT", "MALT011000012345MTLCAST001S")]


def test_ibans_of_every_length(spark):
    plain = [iban_of(*a) for a in ACCOUNTS]
    spaced = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in plain]
    one, two = changed(spark, plain), changed(spark, [f"{s} 2024 PAID" for s in spaced])
    for x, s, (a, ka), (b, kb) in zip(plain, spaced, one, two):
        assert ka == kb == ["iban"] and len(a) == len(x) and a[4:] != x[4:] and a[:2] == x[:2], (x, a)
        assert iban_of(a[:2], a[4:]) == a and b.removesuffix(" 2024 PAID").replace(" ", "") == a and [len(w) for w in b.split()[:-2]] == [len(w) for w in s.split()]
    assert len({a for a, _ in one}) == len(plain)

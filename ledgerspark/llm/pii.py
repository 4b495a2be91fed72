"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Found values are replaced in place by values of the same format. Numbers (cards, other long numbers, phone and social
security numbers, IBANs), IPv4 addresses and dates are validated, then permuted by a keyed Feistel network over all
values of their format, so equal values get equal pseudonyms in every document, and different ones different
pseudonyms. Check digits (Luhn, IBAN) hold after the change if they held before. E-mail addresses and long hex
secrets, which aren't numbers, get keyed SHA-256 digits in their own shape.

Rules by kind (a value that fails its kind's validation stays as it is):
  number  more digits than a card has: all are permuted, 18 at a time
  card    13-19 digits, or groups of 4-4-4-n, 4-6-5 or 4-6-4 with single spaces or hyphens between: all but the Luhn digit are permuted; if the digits fail the Luhn
          test it counts as number and all digits are permuted
  phone   + and country code, or 3-3-4 digits, with or without a 1 before: the last ten digits (or as many as there are) are
          permuted. It has 7 to 15 digits, after a country code of NATIONAL as many as that country's numbers have, and
          ends before a value of another kind. After another country code groups of digits that follow count as its own
  ssn     ddd-dd-dddd
  iban    as long as its country's IBANs, or of another length, and valid modulo 97: its digits after the check digits are permuted, and the check digits computed again
  ip      four numbers up to 255, permuted as 32 bits
  date    yyyy-mm-dd, d.m.yyyy, d/m/yyyy or m/d/yyyy: the day is permuted within its cycle of 73,000 days; order and
          signs are kept, day and month get two digits
  email, secret (32-64 hex digits; AKIA and 16 letters or digits)

Defined cases: null text stays null with no finds; empty text stays; repeated rows are each changed alike; all other
columns of the input are kept. The key is a parameter; keep it secret.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
CYCLE = (250, 292)  # days of a date cycle, as a product
#: Country codes by the digits of their national numbers.
NATIONAL = {8: "45 47 65 852", 9: "31 33 34 41 48 61 351 380 420 421 971 972", 10: "1 7 30 44 52 57 63 81 90 91", 11: "55 86"}
DIGIT = "[ ().-]{0,2}[0-9]"  # written out where repeated: Java's lookbehind takes no repeated group
OCTET = "(?:2(?:[0-4][0-9]|5[0-5])|[01]?[0-9]{1,2})"
#: Where a number that follows a phone number is a value of its own.
NEXT = "|".join((
    rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    r"(?<![0-9./-])(?:[0-9]{4}-(?:0[1-9]|1[0-2])-[0-3][0-9]|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[./-][0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    r"(?:(?:[0-9]{4} ){3}|(?:[0-9]{4}-){3})[0-9]{4,7}(?![0-9]|[ -][0-9]{4}(?![0-9]))|[0-9]{4}(?: [0-9]{6} |-[0-9]{6}-)[0-9]{4,5}(?![0-9])",
    r"(?<!-)[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9]|-[0-9])",
))
CODE = r"[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?"
KNOWN = "|".join(f"(?:{'|'.join(codes.split())}){DIGIT * n}" for n, codes in NATIONAL.items())
ABROAD = (
    rf"(?<![0-9+])\+(?:{CODE}[0-9]{{1,4}}(?:[ .-]?[0-9]{{2,4}}){{1,4}}(?![0-9])(?<=\+(?:{KNOWN}))"
    rf"|{CODE}[0-9]{{2,4}}(?:(?:[ .-](?!{NEXT}))?[0-9]{{2,4}}){{1,4}}(?![0-9])(?<=\+[0-9]{DIGIT * 6}{f'(?:{DIGIT}' * 8}{')?' * 8}))"
)
#: Countries by the length of their IBANs.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
NATIONAL_IBAN = "|".join(f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, codes in IBANS.items())
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{32,64}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?:{NATIONAL_IBAN}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?<dot>[./])[0-9]{1,2}\k<dot>[0-9]{4})(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": ABROAD + r"|(?<![0-9])(?:\([0-9]{3}\) ?|(?<!-)1[-. ](?:\([0-9]{3}\) ?|[0-9]{3}[-. ])|(?<!-)[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9]|-[0-9])|(?<![0-9./-])0[1-9][0-9]{1,3}[ /-][0-9]{6,8}(?![0-9]|[./-][0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,}|[0-9]{4}(?<gap>[ -])(?:[0-9]{4}\k<gap>[0-9]{4}\k<gap>[0-9]{1,7}|[0-9]{6}\k<gap>[0-9]{4,5}))(?![0-9])",
}
ORDER = ("email", "secret", "iban", "date", "ip", "ssn", "card", "phone")
COUNTED = ("email", "secret", "iban", "date", "ip", "ssn", "card", "number", "phone")
ANY = "|".join(f"(?:{KINDS[k]})" for k in ORDER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it, as it also would be inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def prf(key: str, tweak: Column, i: Column, half: Column) -> Column:
    """60 pseudo-random bits from the key, the format, the round and the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """A permutation of the pairs left < a, right < b, as struct(l, r)."""

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        new_l = F.when(even, F.pmod(s["l"] + F.pmod(prf(key, tweak, i, s["r"]), a), a)).otherwise(s["l"])
        new_r = F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(prf(key, tweak, i, s["l"]), b), b))
        return F.struct(new_l.alias("l"), new_r.alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def ten_to(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permuted_digits(d: Column, key: str, kind: str | Column) -> Column:
    """The digit string d (at most 31 digits: the halves fit a long), permuted among all strings of its length."""
    n = F.length(d)
    h = F.floor(n / 2).cast("int")
    both = feistel(F.coalesce(F.try_to_number(F.concat(F.lit("0"), F.substring(d, F.lit(1), h)), F.lit("9" * 16)), F.lit(0)), F.substring(d, h + 1, n - h).cast("long"), ten_to(h), ten_to(n - h), F.concat(F.lit(kind) if isinstance(kind, str) else kind, n.cast("string")), key)
    return let(both, lambda st: F.concat(F.when(h > 0, F.lpad(st["l"].cast("string"), h, "0")).otherwise(""), F.lpad(st["r"].cast("string"), n - h, "0")))


def number(d: Column, key: str) -> Column:
    """A digit string of any length: up to 31 digits at once, longer ones in parts of 18, each by its place."""
    part = lambda i: let(F.substring(d, i * 18 + 1, F.lit(18)), lambda x: permuted_digits(x, key, F.concat(F.lit("number"), i.cast("string"))))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.length(d) - 1) / 18).cast("int")), part)
    return F.when(F.length(d) <= 31, permuted_digits(d, key, "number")).otherwise(F.array_join(parts, ""))


def in_shape(m: Column, d: Column) -> Column:
    """m with its digits replaced, in order, by those of d, which is m where m is digits alone, as values of any length are."""
    spread = lambda v: F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c.rlike("^[0-9]$"), F.substring(v, F.length(digits_of(F.substring(m, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")
    return let(d, lambda v: F.when(F.length(v) == F.length(m), v).otherwise(spread(v)))


def luhn_sum(d: Column) -> Column:
    """Luhn sum of the digits d; the last one counts once."""
    n = F.length(d)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 0, F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(d, i, F.lit(1)).cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def card(m: Column, key: str) -> Column:
    d = digits_of(m)
    check = lambda body: F.pmod(10 - luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    new = let(permuted_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"), lambda body: F.concat(body, check(body).cast("string")))
    return in_shape(m, new)


def phone(m: Column, key: str) -> Column:
    d = digits_of(m)
    keep = F.greatest(F.length(d) - 10, F.lit(0))
    return in_shape(m, F.concat(F.substring(d, F.lit(1), keep), permuted_digits(F.substring(d, keep + 1, F.length(d)), key, "phone")))


def mod97(s: Column) -> Column:
    """The IBAN's rest: letters count as 10 to 35."""
    return F.aggregate(F.split(s, ""), F.lit(0), lambda r, c: F.when(c.rlike("^[0-9]$"), (r * 10 + F.try_to_number(F.concat(F.lit("0"), F.when(c.rlike("^[0-9]$"), c).otherwise("0")), F.lit("99")).cast("int")) % 97).when(c == "", r).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    tail = F.substring(plain, F.lit(5), F.length(plain))
    d = digits_of(tail)
    changed = F.when(F.length(d) > 0, in_shape(tail, permuted_digits(d, key, "iban"))).otherwise(tail)
    check = lambda new: 98 - mod97(F.concat(new, F.substring(plain, 1, 2), F.lit("00")))
    whole = let(changed, lambda new: F.concat(F.substring(plain, 1, 2), F.lpad(check(new).cast("string"), 2, "0"), new))
    return let(whole, lambda w: F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(w, F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), " ", "")), F.lit(1)))), ""))


def ip(m: Column, key: str) -> Column:
    p = F.split(m, "\\.")
    part = lambda i: F.element_at(p, i).cast("int")
    both = feistel(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), F.lit("ip"), key)
    return let(both, lambda st: F.concat_ws(".", F.floor(st["l"] / 256).cast("string"), (st["l"] % 256).cast("string"), F.floor(st["r"] / 256).cast("string"), (st["r"] % 256).cast("string")))


DATE_FORMS = (("^[0-9]{4}-", "yyyy-MM-dd", "yyyy-MM-dd"), ("\\.", "d.M.yyyy", "dd.MM.yyyy"), ("/", "M/d/yyyy", "MM/dd/yyyy"), ("/", "d/M/yyyy", "dd/MM/yyyy"))


def date(m: Column, key: str) -> Column:
    """Null where m is no date; the shape of m is kept."""
    a, b = CYCLE
    out = F.lit(None).cast("string")
    for mark, form, shape in reversed(DATE_FORMS):
        start = F.lit("1900-01-01").cast("date")

        def moved(day: Column) -> Column:
            cycle, place = F.floor(day / (a * b)), F.pmod(day, F.lit(a * b))
            both = feistel(F.floor(place / b), place % b, F.lit(a), F.lit(b), F.lit("date"), key)
            return let(both, lambda st: F.date_add(start, (cycle * (a * b) + st["l"] * b + st["r"]).cast("int")))

        new = let(F.datediff(F.try_to_date(m, form), start), moved)
        out = F.when(m.rlike(mark) & F.try_to_date(m, form).isNotNull(), F.date_format(new, shape)).otherwise(out)
    return out


def email(m: Column, key: str) -> Column:
    h = F.sha2(F.concat(F.lit(key + "|email|"), F.lower(m)), 256)
    return F.concat(F.substring(h, 1, 12), F.lit("@"), F.substring(h, 13, 8), F.lit(".example"))


def secret(m: Column, key: str) -> Column:
    h = F.sha2(F.concat(F.lit(key + "|secret|"), F.lower(m)), 256)
    h = F.when(m.rlike("[A-F]"), F.upper(h)).otherwise(h)
    return F.when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16)))).otherwise(F.substring(h, F.lit(1), F.length(m)))


def kind_of(m: Column) -> Column:
    """The validated kind of a found value; null if none."""
    only = lambda k: m.rlike(f"^(?:{KINDS[k]})$")
    d = digits_of(m)
    plain = F.regexp_replace(m, " ", "")
    return (F.when(F.contains(m, F.lit("@")), "email")
            .when(only("secret") & m.rlike("[A-Fa-f]"), "secret")
            .when(only("secret"), "number")
            .when(m.rlike("^[A-Z]{2}"), F.when(mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1, F.lit("iban")))
            .when(only("date"), F.when(F.coalesce(*(F.try_to_date(m, f) for mark, f, _ in DATE_FORMS)).isNotNull(), F.lit("date")))
            .when(only("ip"), F.when(~m.rlike("(?:^|\\.)(?:25[6-9]|2[6-9][0-9]|[3-9][0-9][0-9])(?:\\.|$)"), F.lit("ip")))
            .when(only("ssn"), "ssn")
            .when(only("card"), F.when((F.length(d) <= 19) & (luhn_sum(d) % 10 == 0), "card").otherwise("number"))
            .when((F.length(d) >= 7) & (F.length(d) <= 15), "phone"))


def pseudonym(kind: Column, m: Column, key: str) -> Column:
    return let(digits_of(m), lambda d: pseudonym_of(kind, m, d, key))


def pseudonym_of(kind: Column, m: Column, d: Column, key: str) -> Column:
    return (F.when(kind == "email", email(m, key)).when(kind == "secret", secret(m, key)).when(kind == "iban", iban(m, key)).when(kind == "date", F.coalesce(date(m, key), m))
            .when(kind == "ip", ip(m, key)).when(kind == "ssn", in_shape(m, permuted_digits(d, key, "ssn"))).when(kind == "card", card(m, key))
            .when(kind == "number", in_shape(m, number(d, key))).when(kind == "phone", phone(m, key)).otherwise(m))


def pseudonymise(documents: DataFrame, key: str, column: str = "text") -> DataFrame:
    """The input with column changed and pii_kinds, the kinds of the values changed, in their order."""
    text = F.col(column)
    some = text.rlike("[0-9@]|[0-9A-Fa-f]{32}")
    found = F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    step = documents.withColumn("_pii_found", found)
    step = step.withColumn("_pii_found", F.transform("_pii_found", lambda m: F.struct(m.alias("m"), kind_of(m).alias("k"))))
    new = F.transform("_pii_found", lambda x: pseudonym(x["k"], x["m"], key))
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, ANY, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    kinds = F.filter(F.transform("_pii_found", lambda x: x["k"]), lambda k: k.isNotNull())
    return step.withColumn(column, F.when(F.size("_pii_found") > 0, joined).otherwise(text)).withColumn("pii_kinds", kinds).drop("_pii_found")

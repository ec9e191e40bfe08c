"""Pseudonyms: an independent Feistel in Python, formats, links, and what stays."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from outfold.llm import pii

KEY = "a test key, with 'quotes' and \\ back"


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def word(label, w, alphabet):
    a, b = w[:len(w) // 2], w[len(w) // 2:]
    for r in range(pii.ROUNDS):
        stream = "".join(sha(KEY, label, r, len(a), b, j) for j in range((len(a) + 7) // 8))
        a, b = b, "".join(alphabet[(alphabet.index(c) + int(stream[8 * i:8 * i + 8], 16)) % len(alphabet)]
                          for i, c in enumerate(a))
    return a + b


def pair(label, a, b, na, nb):
    for r in range(pii.ROUNDS):
        a, b = b, (a + int(sha(KEY, label, r, b)[:13], 16)) % (nb if r % 2 else na)
    return a, b


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def back(shape, new, pattern):
    it = iter(new)
    return re.sub(pattern, lambda m: next(it), shape)


def card(m):
    body = word("card", re.sub(r"\D", "", m)[:-1], pii.DIGITS)
    return back(m, body + next(c for c in pii.DIGITS if luhn(body + c)), r"\d")


def phone(m):
    d = re.sub(r"\D", "", m)
    return back(m, d[:-10] + word("phone", d[-10:], pii.DIGITS), r"\d")


def address(m):
    o = list(map(int, m.split(".")))
    a, b = pair("address", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def date(m, fmt="%Y-%m-%d"):
    n = (datetime.datetime.strptime(m, fmt).date() - datetime.date(1800, 1, 1)).days
    a, b = pair("date", n // pii.DAYS_B, n % pii.DAYS_B, pii.DAYS_A, pii.DAYS_B)
    return (datetime.date(1800, 1, 1) + datetime.timedelta(days=a * pii.DAYS_B + b)).strftime(fmt)


def day_first(m):
    """The pair permutation, again and again until the day is above 12."""
    first = datetime.date(1800, 1, 1)
    n = (datetime.datetime.strptime(m, "%d/%m/%Y").date() - first).days
    while True:
        a, b = pair("day first", n // pii.DAYS_B, n % pii.DAYS_B, pii.DAYS_A, pii.DAYS_B)
        n = a * pii.DAYS_B + b
        if (first + datetime.timedelta(days=n)).day > 12:
            return (first + datetime.timedelta(days=n)).strftime("%d/%m/%Y")


def social(m):
    x, y, z = map(int, m.split("-"))
    a, b = pair("social", (x - (2 if x > 666 else 1)) * 99 + y - 1, z - 1, 898 * 99, 9999)
    v = a // 99 + 1
    return f"{v + (v >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def email(m):
    u, host = m.split("@")
    return back(u.lower(), word("email", re.sub("[^a-z0-9]", "", u.lower()), pii.WORD), "[a-z0-9]") + "@" + host


CASES = [
    ("4111 1111 1111 1111", card), ("4111111111111111", card), ("5500-0000-0000-0004", card),
    ("378282246310005", card), ("3782-822463-10005", card), ("+1 (743) 555-3824", phone), ("743-555-3824", phone),
    ("152.143.123.131", address), ("0.0.0.0", address), ("255.255.255.255", address),
    ("2024-02-29", date), ("1800-01-01", date), ("2199-12-31", date),
    ("29.02.2024", lambda m: date(m, "%d.%m.%Y")), ("02/29/2024", lambda m: date(m, "%m/%d/%Y")),
    ("29/02/2024", lambda m: day_first(m)), ("123-45-6789", social), ("899-99-9999", social),
    ("665-01-0001", social), ("667-01-0001", social), ("that.92@mail2.example.com", email),
    ("A_b-9@x.org", email), ("24be64439e3e49cf46b2d7c90f3602a3d0b907ff", lambda m: word("hex", m, pii.HEXES)),
]
STAY = ["1234567890123456", "256.1.1.1", "2023-02-29", "1799-12-31", "31.04.2024", "000-12-3456",
        "666-12-3456", "900-12-3456", "123-00-4567", "12345", "1.2.3", "a@b", "deadbeef", "",
        "13/13/2024", "1.2.3.4.5", "99 bottles"]


@pytest.fixture(scope="module")
def moved(spark):
    def run(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        out = pii.pseudonymise(df.selectExpr("*", "1 m", "2 d", "3 s", "'x' p"), KEY)
        assert out.columns == ["doc_id", "text", "m", "d", "s", "p"]
        return [r["text"] for r in out.orderBy("doc_id").collect()]
    return run


def test_each_kind_matches_python(moved):
    got = moved([f"left {m} right, twice {m}." for m, _ in CASES])
    for (m, f), g in zip(CASES, got, strict=True):
        assert g == f"left {f(m)} right, twice {f(m)}.", m
        assert f(m) != m


def test_neighbouring_numbers(moved):
    a, b = "4111111111111111", "5500000000000004"
    assert moved([f"{a} {b} 123", f"{a} 12", f"12 {a}-1"]) == [f"{card(a)} {card(b)} 123", f"{card(a)} 12",
                                                            f"12 {card(a)}-1"]


def test_separated_cards_behind_numbers(moved):
    for sep in " -":
        a, b = (sep.join(c) for c in (["4111", "1111", "1111", "1111"], ["5500", "0000", "0000", "0004"]))
        amex = sep.join(["3782", "822463", "10005"])
        for year in ("2024", "1999", "1234"):
            got = moved([f"paid {year}{sep}{a}", f"{year}{sep}{year}{sep}{b}{sep}12", f"{year}{sep}{amex} x",
                         f"{year}{sep}{a}{sep}{b}", f"2024-01-05 {a}"])
            assert got == [f"paid {year}{sep}{card(a)}", f"{year}{sep}{year}{sep}{card(b)}{sep}12",
                           f"{year}{sep}{card(amex)} x", f"{year}{sep}{card(a)}{sep}{card(b)}",
                           f"{date('2024-01-05')} {card(a)}"]


def test_wrong_digits_with_a_right_check_digit(moved):
    a = "4111 1111 1111 1111"
    year = next(str(y) for y in range(1990, 2030) if luhn(f"{y}41111111" + "1111"))
    assert moved([f"{year} {a}", f"{year} 4111 1111 1111"]) == [f"{year} {card(a)}", card(f"{year} 4111 1111 1111")]


def test_upper_case_tokens(moved):
    low = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    new = word("hex", low, pii.HEXES)
    mixed = low[:20] + low[20:].upper()
    got = moved([f"TOKEN = \"{low.upper()}\"", f"{low} {low.upper()}", mixed])
    assert got[:2] == [f"TOKEN = \"{new.upper()}\"", f"{new} {new.upper()}"]
    assert got[2].lower() == new and mixed not in got[2]


def test_phones_with_blanks(moved):
    a = "4111 1111 1111 1111"
    assert moved(["call 743 555 3824.", "+1 743 555 3824", "743.555 3824", f"743 555 3824 {a}",
                  f"743 555 {a}", f"743-555-{a}"]) == [
        f"call {phone('743 555 3824')}.", phone("+1 743 555 3824"), phone("743.555 3824"),
        f"{phone('743 555 3824')} {card(a)}", f"743 555 {card(a)}", f"743-555-{card(a)}"]


def test_many_cards_in_a_text(moved):
    cards = [f"4{i:014d}" for i in range(3000)]
    cards = [c + next(x for x in pii.DIGITS if luhn(c + x)) for c in cards]
    cards = [" ".join(c[k:k + 4] for k in range(0, 16, 4)) for c in cards]
    assert moved(["; ".join(cards)]) == ["; ".join(map(card, cards))]


def test_formats_hold(moved):
    cards = moved(["4111 1111 1111 1111", "378282246310005"])
    assert all(luhn(re.sub(r"\D", "", c)) for c in cards)
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", cards[0])


def test_what_is_not_valid_stays(moved):
    texts = [f"a {s} b" for s in STAY]
    assert moved(texts) == texts


def test_rows_and_nulls_stay(moved):
    got = moved([None, "", "plain text", "x" * 50_000 + " 743-555-3824", "1" * 30_000])
    assert got[:3] == [None, "", "plain text"]
    assert got[3] == "x" * 50_000 + " " + phone("743-555-3824") and got[4] == "1" * 30_000


def test_permutation_is_one_to_one(spark):
    df = spark.range(3000).select(F.format_string("%03d-%02d-%04d", F.lit(123), F.lit(45), F.col("id") + 1).alias("text"))
    assert pii.pseudonymise(df, KEY).distinct().count() == 3000
    days = spark.range(3000).select(F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("text"))
    assert pii.pseudonymise(days, KEY).distinct().count() == 3000


def test_no_key(spark):
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame([("x",)], "text string"), "")


def test_plan_is_native(spark):
    df = pii.pseudonymise(spark.range(1).selectExpr("cast(id as string) text"), KEY)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan

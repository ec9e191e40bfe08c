"""Format-preserving pseudonyms for personal numbers and dates.

Found values are validated (card numbers by their check digit, addresses by
range, dates by the calendar, social numbers by their areas) and then permuted
by a keyed Feistel network inside their own format: digits stay digits,
separators stay where they are, a card number keeps a right check digit, a date
stays a date. The permutation depends on the key and the value alone, so equal
values have equal pseudonyms in all documents and different values of a format
different ones. Only SQL functions are used; there is no join and no shuffle. They
are put together as columns, not as SQL text: the parser would keep some 40 MB for
so long a text on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed pattern of each kind. A match is told apart by these, in this order.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,9}\.[A-Za-z]{2,}"
HEX = r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])"
DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])|(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z.-])(?:\+[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
ANY = "|".join([EMAIL, HEX, DATE, ADDRESS, SOCIAL, PHONE, CARD])
#: Every start of what looks like a card number, also inside another one.
CARD_AT = CARD.replace("(?<![0-9])", "(?<![0-9])(?=(", 1) + "))"
#: First digits that card issuers use.
ISSUER = "^(?:3|4|5[0-8]|6|222[1-9]|22[3-9]|2[3-6]|27[01]|2720)"
#: ``ANY`` with the valid card numbers of a text, joined by |, at <cards>: what
#: fails the check digit takes no text from a match behind it. Those with other
#: first digits than an issuer's (<other>) give way to an issuer's (<known>) at
#: one of their groups. The last group of a telephone number may not begin a
#: card, unless one begins right after.
VALID = r"(?:<cards>)(?![0-9])"
ANY_VALID = "|".join([EMAIL, HEX, DATE, ADDRESS, SOCIAL, PHONE.replace(
    "[0-9]{4}(?![0-9])", rf"(?:(?=[0-9]{{4}}[^0-9]{VALID})|(?!{VALID}))[0-9]{{4}}(?![0-9])"),
    r"(?<![0-9])(?=[0-9]{4})(?:(?:<known>)(?![0-9])|(?![0-9]{4}[ -](?:[0-9]{4}[ -]){0,2}(?:<known>)(?![0-9]))"
    r"(?:<other>)(?![0-9]))"])
ROUNDS = 8

DIGITS = "0123456789"
HEXES = "0123456789abcdef"
WORD = "abcdefghijklmnopqrstuvwxyz0123456789"
#: 1800-01-01 .. 2199-12-31 is one 400-year cycle of 146,097 = 27 * 5411 days.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 27, 5411


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _at(text: Column, i: Column) -> Column:
    return F.substr(text, i, F.lit(1))


def permute_pair(key: str, label: str, a: Column, b: Column, size_a: int, size_b: int) -> Column:
    """Struct (a, b): a keyed permutation of Z_size_a x Z_size_b. Each round
    adds a hash of one half to the other and swaps them."""
    def turn(s: Column, r: Column) -> Column:
        hashed = F.conv(F.substr(F.sha2(F.concat_ws(
            "|", F.lit(key), F.lit(label), r.cast("string"), s["b"].cast("string")), 256),
            F.lit(1), F.lit(13)), 16, 10).cast("long")
        size = F.when(r % 2 == 0, F.lit(size_a).cast("long")).otherwise(F.lit(size_b).cast("long"))
        return F.struct(s["b"].alias("a"), ((s["a"] + hashed) % size).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
                       F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def permute_word(key: str, label: str, word: Column, alphabet: str) -> Column:
    """A keyed permutation of the words of one length over ``alphabet``. The word
    is cut in two; each round adds a keyed stream made from one half to the
    symbols of the other and swaps them."""
    def turn(s: Column, r: Column) -> Column:
        size = F.length(s["a"])
        stream = F.concat_ws("", F.transform(F.sequence(F.lit(0), _div(size - 1, 8)), lambda j: F.sha2(
            F.concat_ws("|", F.lit(key), F.lit(label), r.cast("string"), size.cast("string"), s["b"],
                        j.cast("string")), 256)))

        def moved(st: Column) -> Column:
            def symbol(i: Column) -> Column:
                step = F.conv(F.substr(st, (i - 1) * 8 + 1, F.lit(8)), 16, 10).cast("long")
                place = F.position(_at(s["a"], i), F.lit(alphabet)) - 1 + step
                return _at(F.lit(alphabet), (place % len(alphabet)).cast("int") + 1)
            return F.concat_ws("", F.transform(F.sequence(F.lit(1), size), symbol))

        return F.struct(s["b"].alias("a"), F.when(size == 0, "").otherwise(_let(stream, moved)).alias("b"))

    def halves(w: Column) -> Column:
        half = _div(F.length(w), 2)
        return F.struct(F.substr(w, F.lit(1), half).alias("a"), F.substr(w, half + 1).alias("b"))

    return _let(word, lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves(w), turn,
                                            lambda s: F.concat(s["a"], s["b"])))


def put_back(shape: Column, symbols: Column, pattern: str) -> Column:
    """``shape`` with its characters of class ``pattern`` replaced in turn by ``symbols``."""
    def character(i: Column) -> Column:
        seen = F.regexp_replace(F.substr(shape, F.lit(1), i), f"[^{pattern[1:-1]}]", "")
        return F.when(_at(shape, i).rlike(pattern), _at(symbols, F.length(seen))).otherwise(_at(shape, i))
    return F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(shape)), character))


def check_digit(body: Column) -> Column:
    """The last digit that makes ``body`` and it a valid card number."""
    def add(t: Column, i: Column) -> Column:
        digit = _at(body, F.length(body) + 1 - i).cast("int")
        twice = F.lit(2) * digit - F.when(digit > 4, 9).otherwise(0)
        return t + F.when(i % 2 == 1, twice).otherwise(digit)
    total = F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), add)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def _body(d: Column) -> Column:
    return F.substr(d, F.lit(1), F.length(d) - 1)


def _last(d: Column) -> Column:
    return F.right(d, F.lit(1))


def _valid(card: Column) -> Column:
    return _let(_digits(card), lambda d: _last(d) == check_digit(_body(d)))


def _card(key: str, m: Column) -> Column:
    def moved(body: Column) -> Column:
        return _let(permute_word(key, "card", body, DIGITS), lambda p: _let(
            F.concat(p, check_digit(p)), lambda n: put_back(m, n, "[0-9]")))
    return _let(_digits(m), lambda d: _let(_body(d), lambda body: F.when(
        _last(d) != check_digit(body), F.lit(None)).otherwise(moved(body))))


def _hex(key: str, m: Column) -> Column:
    """The digits move as lower case; upper case stays upper case."""
    def cased(p: Column) -> Column:
        mixed = F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(
            _at(m, i).rlike("[A-F]"), F.upper(_at(p, i))).otherwise(_at(p, i))))
        return F.when(m == F.lower(m), p).when(m == F.upper(m), F.upper(p)).otherwise(mixed)
    return _let(permute_word(key, "hex", F.lower(m), HEXES), cased)


def _phone(key: str, m: Column) -> Column:
    """The last ten digits move; a country code stays."""
    return _let(_digits(m), lambda d: _let(
        F.concat(F.substr(d, F.lit(1), F.length(d) - 10),
                 permute_word(key, "phone", F.right(d, F.lit(10)), DIGITS)),
        lambda n: put_back(m, n, "[0-9]")))


#: Most steps of a walk; an image outside the format after all of them has
#: probability below 1e-30.
WALK = 80


def walk(start: Column, step: Callable[[Column], Column], inside: Callable[[Column], Column]) -> Column:
    """``step`` applied to ``start`` until ``inside`` holds: a permutation of the
    values inside, as ``step`` is one of a larger set."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), F.struct(start.alias("v"), F.lit(False).alias("done")),
        lambda w, i: F.when(w["done"], w).otherwise(_let(_let(w["v"], step), lambda v: F.struct(
            v.alias("v"), inside(v).alias("done")))),
        lambda w: w["v"])


def _address(key: str, m: Column) -> Column:
    """Plain addresses move among themselves, and those of four three-digit parts
    with a leading zero among these; other paddings stay."""
    def step(label: str) -> Callable[[Column], Column]:
        def parts(p: Column) -> Column:
            return F.array(_div(p["a"], 256).cast("int"), (p["a"] % 256).cast("int"),
                           _div(p["b"], 256).cast("int"), (p["b"] % 256).cast("int"))
        return lambda v: _let(permute_pair(key, label, v[0] * 256 + v[1], v[2] * 256 + v[3], 65536, 65536), parts)

    def moved(o: Column) -> Column:
        plain = _let(_let(o, step("address")), lambda n: F.array_join(
            F.transform(n, lambda x: x.cast("string")), "."))
        wide = _let(walk(o, step("padded address"), lambda v: F.exists(v, lambda x: x < 100)),
                    lambda n: F.array_join(F.transform(n, lambda x: F.lpad(x.cast("string"), 3, "0")), "."))
        return (F.when(F.exists(o, lambda x: x > 255), F.lit(None)).when(~m.rlike("(^|[.])0[0-9]"), plain)
                .when(F.length(m) == 15, wide))

    return _let(F.transform(F.split(m, "[.]"), lambda x: x.cast("int")), moved)


def _social(key: str, m: Column) -> Column:
    """Areas 001-899 but 666, groups 01-99, serials 0001-9999."""
    area, group, serial = (F.substr(m, F.lit(at), F.lit(n)).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    pair = permute_pair(key, "social", (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1,
                        serial - 1, 898 * 99, 9999)

    def written(p: Column) -> Column:
        return _let(_div(p["a"], 99).cast("int") + 1, lambda v: F.format_string(
            "%03d-%02d-%04d", F.when(v >= 666, v + 1).otherwise(v), (p["a"] % 99).cast("int") + 1,
            p["b"].cast("int") + 1))

    return F.when(area.isin(0, 666) | (area > 899) | (group == 0) | (serial == 0), F.lit(None)
                  ).otherwise(_let(pair, written))


def _date(key: str, m: Column) -> Column:
    """Year first, day.month.year, or month/day/year. Slash dates that are none
    of the last, with a day above 12 first, move among themselves."""
    fmt = (F.when(_at(m, F.lit(5)) == "-", "yyyy-MM-dd").when(_at(m, F.lit(3)) == ".", "dd.MM.yyyy")
           .when(F.substr(m, F.lit(1), F.lit(2)).cast("int") <= 12, "MM/dd/yyyy").otherwise("dd/MM/yyyy"))
    first = F.lit(FIRST_DAY).cast("date")
    day = F.datediff(F.try_to_timestamp(m, fmt).cast("date"), first)

    def moved(label: str) -> Callable[[Column], Column]:
        return lambda t: _let(permute_pair(key, label, _div(t, DAYS_B), t % DAYS_B, DAYS_A, DAYS_B),
                              lambda p: (p["a"] * DAYS_B + p["b"]).cast("int"))

    def new(t: Column) -> Column:
        late = walk(t, moved("day first"), lambda v: F.dayofmonth(F.date_add(first, v)) > 12)
        return F.when(fmt == "dd/MM/yyyy", late).otherwise(moved("date")(t))

    return _let(day, lambda t: F.when(t.isNull() | (t < 0) | (t >= DAYS_A * DAYS_B), F.lit(None)).otherwise(
        F.call_function("date_format", F.date_add(first, new(t)), fmt)))


def _email(key: str, m: Column) -> Column:
    """Letters and digits before the @ move, in lower case; the host stays."""
    return _let(F.lower(F.substring_index(m, "@", 1)), lambda u: _let(
        F.regexp_replace(u, "[^a-z0-9]", ""), lambda w: _let(
            permute_word(key, "email", w, WORD), lambda n: F.concat(
                put_back(u, n, "[a-z0-9]"), F.lit("@"), F.substring_index(m, "@", -1)))))


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of the found string ``m``; null if it is not valid."""
    def full(p: str) -> Column:
        return m.rlike("^(?:" + p + ")$")
    return (F.when(full(EMAIL), _email(key, m)).when(full(HEX), _hex(key, m)).when(full(DATE), _date(key, m))
            .when(full(ADDRESS), _address(key, m)).when(full(SOCIAL), _social(key, m))
            .when(full(PHONE), _phone(key, m)).otherwise(_card(key, m)))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal values of ``text_col`` replaced in place; all
    columns and rows stay.

    Kinds: e-mail addresses (user part), hexadecimal tokens of 32 digits or
    more in either case (at least one letter and one of 0-9), dates 1800 to 2199,
    IPv4 addresses (plain, or all four parts with three digits), social numbers, telephone numbers (3-3-4 digits with blanks, dots
    or hyphens between them), card numbers with a right check digit. A string
    that looks like one but fails its check stays as it is. Of several overlapping
    groups of digits with a right check digit one with an issuer's first digits
    moves rather than one without, else the leftmost. Null text stays null, empty text empty; repeated rows
    and equal values get equal pseudonyms. Keep ``key`` secret: it undoes the
    permutation.
    """
    if not key:
        raise ValueError("an empty key gives no protection")
    text = F.col(f"`{text_col.replace('`', '``')}`")
    cards = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(CARD_AT), F.lit(1))), _valid)

    def valid(cs: Column) -> Column:
        pattern = F.lit(ANY_VALID)
        for mark, some in (("cards", cs), ("known", F.filter(cs, lambda c: c.rlike(ISSUER))),
                           ("other", F.filter(cs, lambda c: ~c.rlike(ISSUER)))):
            joined = F.coalesce(F.nullif(F.array_join(some, "|"), F.lit("")), F.lit("(?!)"))
            pattern = F.replace(pattern, F.lit(f"<{mark}>"), joined)
        return pattern

    def rebuilt(pattern: Column) -> Column:
        moved = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)),
                            lambda m: F.coalesce(pseudonym(key, m), m))
        return F.concat_ws("", F.flatten(F.zip_with(
            F.split(text, pattern, -1), moved, lambda p, q: F.array(p, F.coalesce(q, F.lit(""))))))

    # Most texts hold nothing: one look decides before the text is taken apart.
    return docs.withColumn(text_col, F.when(
        text.rlike("[0-9]|@") & text.rlike(ANY), _let(_let(cards, valid), rebuilt)).otherwise(text))

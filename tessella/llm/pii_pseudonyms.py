"""Format-preserving pseudonyms of personal numbers, dates and addresses.

A value that matches a pattern and passes its check is replaced by the image of
a keyed permutation of all values of that format, so equal values get equal
pseudonyms in all documents and different values different ones:

* card numbers (Luhn): all digits but the last are permuted, the last is the
  check digit of the result; separators stay where they were;
* account numbers (IBAN, modulus 97): the digits after the check digits are
  permuted, letters stay, the check digits are those of the result;
* telephone numbers of the form 3-3-4 with area and exchange from 200 on;
  international ones (``+``, 8 to 15 digits) and pairs of digits after ``0x``:
  all digits but the first two;
* IPv4 addresses, and numbers of the form 3-2-4;
* dates ``yyyy-mm-dd``, ``dd/mm/yyyy`` and ``d.m.yyyy`` from 1900 to 2099 that
  exist: year and day of the year are permuted, 29 February among leap years.
  A date has one pseudonym in all three forms.

The permutation is a Feistel network over a pair of residues, ``ROUNDS`` rounds
of adding a keyed digest of one half to the other.  E-mail addresses have no
fixed format to permute; their local part becomes a keyed digest and the host
``example.com``.  What matches but fails its check stays as it is.

Whoever knows the key can undo the permutations, so there is no default key.

Everything is one projection of built-in functions.  A null text stays null,
texts without a digit or ``@`` are passed on untouched, repeated rows give
repeated results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._native import let

ROUNDS = 8

#: The patterns, in the order in which they are tried at a place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
ISO_DATE = r"(?<![0-9])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9])"
DAY_DATE = r"(?<![0-9])[0-3][0-9]/[01][0-9]/(?:19|20)[0-9]{2}(?![0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
THREE_TWO_FOUR = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
DOT_DATE = r"(?<![0-9.])[0-3]?[0-9]\.[01]?[0-9]\.(?:19|20)[0-9]{2}(?![0-9]|\.[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
INTERNATIONAL = r"(?<![0-9+])\+[1-9](?:[ .-]?[0-9]){7,14}(?![0-9])"
PAIRS = r"(?<![0-9+.-])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9])"
ANY = "|".join((EMAIL, ISO_DATE, DAY_DATE, DOT_DATE, IPV4, THREE_TWO_FOUR, PHONE, IBAN, INTERNATIONAL, PAIRS, CARD))


def _digest(*parts: Column) -> Column:
    """60 bits of a digest as a whole number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, m: Column, n: Column, label: str, key: str) -> Column:
    """A keyed permutation of pairs (a, b) with 0 <= a < m and 0 <= b < n, as a struct of a and b."""

    def step(s: Column, i: Column) -> Column:
        name = F.concat(F.lit(f"{key}|{label}|"), i.cast("string"))
        left = F.pmod(s["a"] + F.pmod(_digest(name, s["b"].cast("string")), m), m)
        right = F.pmod(s["b"] + F.pmod(_digest(name, s["a"].cast("string")), n), n)
        return F.when(i % 2 == 0, F.struct(left.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), right.alias("b")))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        return F.when(
            c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))

    return F.aggregate(F.split(value, ""), start, step, lambda s: s["out"])


def _luhn(digits: Column, skip: int) -> Column:
    """Luhn sum of a string of digits; ``skip`` 0 doubles every second from the right, 1 from the last on."""
    at = F.sequence(F.lit(0), F.length(digits) - 1)

    def one(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when((i + skip) % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(at, F.lit(0), lambda s, i: s + one(i))


def _permuted(d: Column, label: str, key: str) -> Column:
    """The image of a string of 2 to 34 digits among all strings of its length."""
    left = F.floor(F.length(d) / 2).cast("int")
    right = F.length(d) - left
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    pair = feistel(F.substring(d, F.lit(1), left).cast("long"), F.substring(d, left + 1, right).cast("long"), ten(left), ten(right), label, key)
    return let(pair, lambda p: F.concat(_padded(p["a"], left), _padded(p["b"], right)))


def _card(v: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        new = _permuted(F.substring(d, F.lit(1), F.length(d) - 1), "card", key)
        return F.when(_luhn(d, 0) % 10 == 0, let(new, lambda x: _refill(v, F.concat(x, F.pmod(-_luhn(x, 1), F.lit(10)).cast("string"))))).otherwise(v)

    return let(_digits(v), body)


def _mod97(value: Column) -> Column:
    """Of letters and digits, letters as the numbers from 10 on."""

    def step(s: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(value, ""), F.lit(0), step)


def _iban(v: Column, key: str) -> Column:
    def body(x: Column) -> Column:
        country, rest = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x) - 4)
        digits = _digits(rest)
        valid = F.length(x).between(15, 34) & (_mod97(F.concat(rest, F.substring(x, 1, 4))) == 1) & (F.length(digits) > 1)

        def filled(new: Column) -> Column:
            check = 98 - _mod97(F.concat(_refill(rest, new), country, F.lit("00")))
            return _refill(v, F.concat(_padded(check, 2), new))

        return F.when(valid, let(_permuted(digits, "iban", key), filled)).otherwise(v)

    return let(F.translate(v, " ", ""), body)


def _tail(v: Column, label: str, key: str) -> Column:
    """All digits but the first two permuted."""
    return let(_digits(v), lambda d: _refill(v, F.concat(F.substring(d, 1, 2), _permuted(F.substring(d, F.lit(3), F.length(d) - 2), label, key))))


def _phone(v: Column, key: str) -> Column:
    def body(d: Column) -> Column:
        area, exchange = F.substring(d, -10, 3).cast("long"), F.substring(d, -7, 3).cast("long")
        pair = feistel(area - 200, (exchange - 200) * 10000 + F.substring(d, -4, 4).cast("long"), F.lit(800), F.lit(8_000_000), "phone", key)
        new = let(
            pair,
            lambda p: F.concat(
                F.substring(d, F.lit(1), F.length(d) - 10), (p["a"] + 200).cast("string"), _padded(p["b"] + 2_000_000, 7)
            ),
        )
        return F.when((area >= 200) & (exchange >= 200), _refill(v, new)).otherwise(v)

    return let(_digits(v), body)


def _ipv4(v: Column, key: str) -> Column:
    o = F.transform(F.split(v, "\\."), lambda x: x.cast("long"))
    part = lambda x, at: (F.shiftright(x, at).bitwiseAND(F.lit(255).cast("long"))).cast("string")
    pair = lambda x: feistel(F.get(x, 0) * 256 + F.get(x, 1), F.get(x, 2) * 256 + F.get(x, 3), F.lit(65536), F.lit(65536), "ipv4", key)
    new = lambda x: let(pair(x), lambda p: F.concat_ws(".", part(p["a"], 8), part(p["a"], 0), part(p["b"], 8), part(p["b"], 0)))
    return let(o, lambda x: F.when(F.array_max(x) <= 255, new(x)).otherwise(v))


def _three_two_four(v: Column, key: str) -> Column:
    area, group, serial = (F.substring(v, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    pair = feistel(area - 1, (group - 1) * 9999 + serial - 1, F.lit(899), F.lit(99 * 9999), "324", key)
    new = let(
        pair,
        lambda p: F.concat(
            _padded(p["a"] + 1, 3), F.lit("-"), _padded(F.floor(p["b"] / 9999).cast("long") + 1, 2), F.lit("-"), _padded(p["b"] % 9999 + 1, 4)
        ),
    )
    return F.when((area.between(1, 899)) & (group > 0) & (serial > 0), new).otherwise(v)


def _date(v: Column, pattern: str, key: str, written: Callable[[Column], Column] | None = None) -> Column:
    """``written`` gives a date's text, by default that of ``pattern``."""
    written = written or (lambda day: F.date_format(day, pattern))

    def body(day: Column) -> Column:
        year = F.year(day).cast("long")
        plain = F.make_date(F.lit(2001), F.month(day), F.dayofmonth(day))
        pair = feistel(year - 1900, F.dayofyear(F.coalesce(plain, F.lit("2001-01-01").cast("date"))).cast("long") - 1, F.lit(200), F.lit(365), "date", key)

        def dated(p: Column) -> Column:
            at = F.date_add(F.lit("2001-01-01").cast("date"), p["b"].cast("int"))
            return F.make_date((p["a"] + 1900).cast("int"), F.month(at), F.dayofmonth(at))

        # 29 February: the 49 leap years from 1904 to 2096, seven by seven
        at = F.floor((year - 1904) / 4)
        leap = feistel(F.floor(at / 7), at % 7, F.lit(7), F.lit(7), "leap", key)
        year_of = lambda p: ((p["a"] * 7 + p["b"]) * 4 + 1904).cast("int")
        moved = F.when(F.date_format(day, "MM-dd") == "02-29", let(leap, lambda p: F.make_date(year_of(p), F.lit(2), F.lit(29))))
        return F.when(day.isNull(), v).otherwise(let(moved.otherwise(let(pair, dated)), written))

    return let(F.try_to_timestamp(v, F.lit(pattern)).cast("date"), body)


def _dot_date(v: Column, key: str) -> Column:
    """Written with two digits for day and month if the value has them."""
    wide = F.length(v) == 10
    return _date(v, "d.M.yyyy", key, lambda day: F.when(wide, F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "d.M.yyyy")))


def _email(v: Column, key: str) -> Column:
    return F.concat(F.lit("user-"), F.substring(F.md5(F.concat(F.lit(f"{key}|email|"), F.lower(v))), 1, 16), F.lit("@example.com"))


def _kind(v: Column) -> Column:
    tests = (("email", "@"), ("iso", f"^{ISO_DATE}$"), ("day", f"^{DAY_DATE}$"), ("dot", f"^{DOT_DATE}$"), ("ipv4", f"^{IPV4}$"),
             ("324", f"^{THREE_TWO_FOUR}$"), ("phone", f"^{PHONE}$"), ("iban", f"^{IBAN}$"), ("intl", f"^{INTERNATIONAL}$"), ("pairs", f"^{PAIRS}$"))
    out = F.lit("card")
    for name, pattern in reversed(tests):
        out = F.when(v.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of one matched value; the value itself if it fails its format's check."""
    kinds = {
        "email": _email(v, key), "iso": _date(v, "yyyy-MM-dd", key), "day": _date(v, "dd/MM/yyyy", key), "ipv4": _ipv4(v, key),
        "324": _three_two_four(v, key), "phone": _phone(v, key), "dot": _dot_date(v, key), "iban": _iban(v, key), "intl": _tail(v, "intl", key),
        "pairs": _tail(v, "pairs", key),
    }

    def chosen(k: Column) -> Column:
        out = _card(v, key)
        for name, value in kinds.items():
            out = F.when(k == name, value).otherwise(out)
        return out

    return let(_kind(v), chosen)


def pseudonymised(text: Column, key: str) -> Column:
    """A struct of the new text, the number of values replaced and of values that failed their check."""

    def body(found: Column) -> Column:
        def replaced(new: Column) -> Column:
            pieces = F.zip_with(F.split(text, ANY, -1), new, lambda gap, x: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(x, F.lit(""))))
            changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
            return F.struct(
                F.array_join(pieces, "").alias("text"), changed.cast("long").alias("n_replaced"), (F.size(found) - changed).cast("long").alias("n_kept")
            )

        return let(F.transform(found, lambda v: pseudonym(v, key)), replaced)

    none = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_replaced"), F.lit(0).cast("long").alias("n_kept"))
    some = let(F.regexp_extract_all(text, F.lit(ANY), 0), lambda found: F.when(F.size(found) > 0, body(found)).otherwise(none))
    return F.when(text.rlike("[0-9@]"), some).otherwise(none)


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, n_replaced, n_kept`` for each row of ``docs(doc_id, text)``; an empty key raises."""
    if not key:
        raise ValueError("pseudonyms need a key")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), pseudonymised(F.col("text"), key).alias("_new"))
    return out.select("doc_id", "_new.*")

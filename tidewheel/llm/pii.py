"""Format-preserving Feistel pseudonyms of personal numbers, dates and addresses. DataFrame functions only.

One pattern finds candidates; each kind is validated: payment cards by their check digit, IBANs by
theirs, IPv4 by its octets, US social security numbers by their ranges, dates by the calendar
(1900 to 2099), phones and e-mail addresses by form. A valid one is permuted within its format by a
keyed Feistel network, whose halves are numbers modulo the sizes of the two parts, so every valid
value has one pseudonym of the same kind, equal values stay linked across documents, however their
separators are written, and ``inverse=True`` with the key gives the value back. Check digits are
recomputed; separators, country codes, domains and letter case stay. What fails validation stays. The separators
known are spaces and hyphens in cards, spaces between groups of four in IBANs, and - or / in dates;
a card with other digits a space or hyphen away is validated together with them, and so stays. A
domain has 128 labels at most, as the name system allows: no pattern nests without a bound.

It is one narrow projection: no shuffle, no state, text stays in the JVM.

Defined results: null texts stay null and empty ones empty, with counts of 0; equal values get equal
pseudonyms in any row; addresses that differ in case get pseudonyms that differ in case alone; other
columns are kept as they are, and a count whose name is taken gets an underscore before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

KINDS: dict[str, str] = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++){0,126}\.\p{L}{2,}",
    "ip": r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])",
    "date": r"(?<![\p{L}\p{N}\-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![\p{N}\-])|(?<!/)(?:(?:19|20)[0-9]{2}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![\p{N}/]))",
    "ssn": r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}\-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .\-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![\p{N}\-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}\-])[0-9](?:[ \-]?[0-9]){12,18}(?![\p{N}\-])",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
ROUNDS = 8


def _hash(key: str, tweak: Column | str, r: Column, value: Column) -> Column:
    """56 bits of a keyed hash."""
    text = F.concat_ws("|", F.lit(key), tweak if isinstance(tweak, Column) else F.lit(tweak), r.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")


def feistel(x: Column, y: Column, mx: Column, my: Column, key: str, tweak: Column | str, inverse: bool) -> Column:
    """Struct (x, y) of the pair's image; x stays below mx and y below my. An even number of rounds."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), mx.cast("long").alias("mx"), my.cast("long").alias("my"))

    def forth(s: Column, r: Column) -> Column:
        moved = F.pmod(s["x"] + F.pmod(_hash(key, tweak, r, s["y"]), s["mx"]), s["mx"])
        return F.struct(s["y"].alias("x"), moved.alias("y"), s["my"].alias("mx"), s["mx"].alias("my"))

    def back(s: Column, r: Column) -> Column:
        moved = F.pmod(s["y"] - F.pmod(_hash(key, tweak, r, s["x"]), s["my"]), s["my"])
        return F.struct(moved.alias("x"), s["x"].alias("y"), s["my"].alias("mx"), s["mx"].alias("my"))

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, start, back if inverse else forth)


def _bind(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(d: Column, key: str, tweak: str, inverse: bool) -> Column:
    """A string of 2 to 36 digits to another of the same length."""
    n = F.length(d)
    a = F.floor(n / 2).cast("int")
    x, y = d.substr(F.lit(1), a).cast("long"), d.substr(a + 1, n - a).cast("long")
    out = feistel(x, y, _power(a), _power(n - a), key, F.concat_ws(":", F.lit(tweak), n.cast("string")), inverse)
    return _bind(out, lambda s: F.concat(F.lpad(s["x"].cast("string"), a, F.lit("0")), F.lpad(s["y"].cast("string"), n - a, F.lit("0"))))


def _laid_out(form: Column, digits: Column) -> Column:
    """The digits of ``form`` replaced in order by ``digits``."""

    def filled(d: Column) -> Column:
        one = lambda i: F.when(form.substr(i, F.lit(1)).rlike("[0-9]"), d.substr(F.length(_digits(form.substr(F.lit(1), i))), F.lit(1))).otherwise(form.substr(i, F.lit(1)))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")

    return _bind(digits, filled)


def _luhn(d: Column) -> Column:
    """Sum of the check-digit rule, the last digit being the check digit."""
    n = F.length(d)

    def one(i: Column) -> Column:
        v = d.substr(i, F.lit(1)).cast("int")
        return F.when((n - i) % 2 == 1, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda s, v: s + v)


def _mod97(iban: Column) -> Column:
    iban = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(iban.substr(F.lit(5), F.length(iban)), iban.substr(F.lit(1), F.lit(4)))
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _card(m: Column, key: str, inverse: bool) -> Column:
    def new(d: Column) -> Column:
        body = permute_digits(d.substr(F.lit(1), F.length(d) - 1), key, "card", inverse)
        return _bind(body, lambda b: F.concat(b, F.pmod(-_luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    return _laid_out(m, _bind(_digits(m), new))


def _phone(m: Column, key: str, inverse: bool) -> Column:
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3}[ .\-])?", 0)
    rest = m.substr(F.length(code) + 1, F.length(m))
    return F.concat(code, _laid_out(rest, permute_digits(_digits(rest), key, "phone", inverse)))


def _ip(m: Column, key: str, inverse: bool) -> Column:
    part = F.split(m, r"\.")
    o = lambda i: F.element_at(part, i).cast("long")
    out = feistel(o(1) * 256 + o(2), o(3) * 256 + o(4), F.lit(65536), F.lit(65536), key, "ip", inverse)
    halves = lambda v: (F.floor(v / 256).cast("string"), (v % 256).cast("string"))
    return _bind(out, lambda s: F.concat_ws(".", *halves(s["x"]), *halves(s["y"])))


def _day(m: Column) -> Column:
    """The day of yyyy-mm-dd, yyyy/mm/dd or dd/mm/yyyy; null if there is none."""
    iso = F.when(m.rlike("^[0-9]{2}/"), F.concat_ws("-", m.substr(F.lit(7), F.lit(4)), m.substr(F.lit(4), F.lit(2)), m.substr(F.lit(1), F.lit(2)))).otherwise(F.translate(m, "/", "-"))
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")


def _date(m: Column, key: str, inverse: bool) -> Column:
    # 73,049 days from 1900 to 2099 are 17 times 4297
    n = F.datediff(_day(m), F.lit("1900-01-01").cast("date"))
    out = feistel(F.floor(n / 4297), n % 4297, F.lit(17), F.lit(4297), key, "date", inverse)
    new = lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["x"] * 4297 + s["y"]).cast("int"))
    form = lambda d: F.when(m.rlike("^[0-9]{2}/"), F.date_format(d, "dd/MM/yyyy")).when(m.contains("/"), F.date_format(d, "yyyy/MM/dd")).otherwise(d.cast("string"))
    return _bind(out, lambda s: form(new(s)))


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    # areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999
    area, group, serial = (m.substr(F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    x = (area - 1 - (area > 666).cast("int")) * 99 + group - 1
    out = feistel(x, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn", inverse)
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    back = lambda a: a + 1 + (a >= 665).cast("int")
    return _bind(out, lambda s: F.concat_ws("-", pad(back(F.floor(s["x"] / 99)), 3), pad(s["x"] % 99 + 1, 2), pad(s["y"] + 1, 4)))


def _iban(m: Column, key: str, inverse: bool) -> Column:
    body = m.substr(F.lit(5), F.length(m))
    new = F.when(F.length(_digits(body)) > 1, _laid_out(body, permute_digits(_digits(body), key, "iban", inverse))).otherwise(body)
    land = m.substr(F.lit(1), F.lit(2))
    return _bind(new, lambda b: F.concat(land, F.lpad((98 - _mod97(F.concat(land, F.lit("00"), b))).cast("string"), 2, "0"), b))


def _email(m: Column, key: str, inverse: bool) -> Column:
    """Local part: two halves of characters; letters a-z and digits are shifted by a hash of the other half, whatever its case."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    a = F.floor(F.length(local) / 2).cast("int")

    def shifted(half: Column, other: Column, r: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), r.cast("string"), F.lower(other)), 256)

        def one(c: Column, i: Column) -> Column:
            k = F.conv(stream.substr(i % 61 + 1, F.lit(3)), 16, 10).cast("int")
            k = -k if inverse else k
            code = F.ascii(c)
            turn = lambda base, size: F.char((F.pmod(code - base + k, F.lit(size)) + base).cast("long"))
            return F.when(c.rlike("^[a-z]$"), turn(97, 26)).when(c.rlike("^[A-Z]$"), turn(65, 26)).when(c.rlike("^[0-9]$"), turn(48, 10)).otherwise(c)

        return F.when(F.length(half) > 0, F.array_join(F.transform(F.split(half, ""), one), "")).otherwise(half)

    def swap(s: Column, r: Column) -> Column:
        if inverse:
            return F.struct(shifted(s["y"], s["x"], r).alias("x"), s["x"].alias("y"))
        return F.struct(s["y"].alias("x"), shifted(s["x"], s["y"], r).alias("y"))

    start = F.struct(local.substr(F.lit(1), a).alias("x"), local.substr(a + 1, F.length(local)).alias("y"))
    rounds = F.sequence(F.lit(4), F.lit(1)) if inverse else F.sequence(F.lit(1), F.lit(4))
    return F.concat(F.aggregate(rounds, start, swap, lambda s: F.concat(s["x"], s["y"])), F.lit("@"), domain)


def _valid(kind: str, m: Column) -> Column:
    whole = m.rlike("^(?:" + KINDS[kind] + ")$")
    if kind == "card":
        return whole & (_luhn(_digits(m)) % 10 == 0)
    if kind == "iban":
        return whole & (_mod97(m) == 1)
    if kind == "ip":
        return whole & F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255)
    if kind == "date":
        return whole & _day(m).isNotNull()
    if kind == "ssn":
        return whole & ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    return whole


_MAKE = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "iban": _iban, "card": _card}


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and a column ``n_<kind>`` of what was replaced, for each kind."""
    text = F.col(text_col)
    some = text.rlike("[0-9@]")  # nothing is found without one of these
    found = F.when(some, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def one(m: Column) -> Column:
        kind = F.coalesce(*[F.when(_valid(k, m), F.lit(k)) for k in KINDS], F.lit(""))

        def new(k: Column) -> Column:
            value = m
            for name, make in _MAKE.items():
                value = F.when(k == name, make(m, key, inverse)).otherwise(value)
            return F.struct(k.alias("kind"), value.alias("value"))

        return _bind(kind, new)

    held = unused(docs, "_found")
    done = docs.withColumn(held, F.transform(found, one))
    pieces = F.split(text, PATTERN, -1)
    values = F.concat(F.col(f"{held}.value"), F.array(F.lit("")))
    changed = F.when(F.size(held) > 0, F.array_join(F.zip_with(pieces, values, lambda p, v: F.concat(p, v)), "")).otherwise(text)
    of_kind = lambda k: F.filter(f"{held}.kind", lambda x: x == k)
    counts = {unused(docs, f"n_{k}"): F.coalesce(F.size(of_kind(k)), F.lit(0)).cast("long") for k in KINDS}
    return done.withColumns({text_col: changed} | counts).drop(held)

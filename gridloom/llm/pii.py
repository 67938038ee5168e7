"""Format-preserving pseudonyms for personal data.

One pattern finds e-mail and IPv4 addresses, phone, card, social security and
bank account (IBAN) numbers, and dates. Numbers and dates are validated first (octets, Luhn
digit, area and group ranges, mod-97 digits, calendar); other matches stay as
they are.

A validated value is split into two halves and sent through ``ROUNDS`` rounds of
an alternating Feistel network over the halves' own ranges, keyed by SHA-2 of
the key, kind, length, round and other half. So the pseudonym is of the same
format and valid again, different values keep different pseudonyms, and equal
values (whatever their punctuation) stay linked across documents. Dates move
within the 146,097 days from 1700 to 2099. Of an e-mail address the letters and digits of
the name, and those of the domain before its last label, are permuted as strings of base 36,
whatever their case; the name's network is keyed by the domain, too, and signs and the last label stay.
The key is the caller's; without it the pseudonyms can't be told from random ones, with it they can be undone.

A null text stays null and counts nothing, an empty one stays empty; an empty table gives
an empty result. Matches that could be of several kinds are of the first one in ``PATTERNS``.
Repeated rows give repeated results; very long texts are read whole. Columns other than
doc_id and text are not read. All steps are DataFrame expressions; texts without a
digit or an at sign skip them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
# The formats, in the order in which they are tried.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "date": r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z]|-[0-9])|(?<![0-9A-Za-z/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9A-Za-z]|/[0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
KINDS = tuple(PATTERNS)
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"
#: 400 Gregorian years: 773 * 189 days.
DAYS, DAY_HALVES, FIRST_DAY = 146_097, (773, 189), "1700-01-01"


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def feistel(left: Column, right: Column, left_range: Column, right_range: Column, tweak: Column, key: Column) -> Column:
    """struct<l, r>: a permutation of all pairs below the two ranges."""
    def shift(r: Column, other: Column) -> Column:
        seed = F.concat_ws("|", key, tweak, r.cast("string"), other.cast("string"))
        return F.conv(F.substring(F.sha2(seed.cast("binary"), 256), 1, 15), 16, 10).cast("long")

    def step(a: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(((a["l"] + shift(r, a["r"])) % left_range).alias("l"), a["r"].alias("r"))).otherwise(F.struct(a["l"].alias("l"), ((a["r"] + shift(r, a["l"])) % right_range).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i) for i in range(16)]), n.cast("int") + 1).cast("long")


def permuted_digits(number: Column, kind: str, key: Column) -> Column:
    """Digits of the same length, 2 to 30 of them; leading zeros count."""
    n = F.length(number)
    a = F.floor(n / 2).cast("int")
    halves = feistel(F.substr(number, F.lit(1), a).cast("long"), F.substr(number, a + 1, n - a).cast("long"), _power(a), _power(n - a), F.concat_ws("|", F.lit(kind), n.cast("string")), key)
    return _let(halves, lambda h: F.concat(F.lpad(h["l"].cast("string"), a, "0"), F.lpad(h["r"].cast("string"), n - a, "0")))


def luhn_digit(payload: Column) -> Column:
    """The check digit that Luhn's rule puts behind the payload."""
    values = F.transform(F.reverse(F.split(payload, "")), lambda d, i: _let(d.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.pmod(-F.aggregate(values, F.lit(0), lambda a, x: a + x), F.lit(10))


def mod97(text: Column) -> Column:
    """Of digits and capitals (A is 10), as a number."""
    def step(a: Column, c: Column) -> Column:
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def refill(shape: Column, number: Column) -> Column:
    """The shape with its digits replaced in order by those of the number."""
    def step(a: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(a["s"], F.when(is_digit, F.substr(number, a["i"], F.lit(1))).otherwise(c)).alias("s"), F.when(is_digit, a["i"] + 1).otherwise(a["i"]).alias("i"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), step)["s"]


def permuted_letters(text: Column, tweak: Column, key: Column) -> Column:
    """Lower-case letters and digits of any number, permuted as two strings of base 36 that move each other sign by sign."""
    n = F.length(text)
    a = F.floor(n / 2).cast("int")

    def moved(own: Column, other: Column, r: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(own), F.lit(1)) - 1) / 32).cast("int")), lambda b: F.sha2(F.concat_ws("|", key, tweak, n.cast("string"), r.cast("string"), b.cast("string"), other).cast("binary"), 512))
        by = lambda stream, i: F.conv(F.substr(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int")
        sign = lambda c, k: F.substr(F.lit(BASE36), F.pmod(F.instr(F.lit(BASE36), c) - 1 + k, F.lit(36)) + 1, F.lit(1))
        return _let(F.array_join(blocks, ""), lambda stream: F.array_join(F.transform(F.filter(F.split(own, ""), lambda c: c != ""), lambda c, i: sign(c, by(stream, i))), ""))

    def step(x: Column, r: Column) -> Column:
        even = F.struct(moved(x["l"], x["r"], r).alias("l"), x["r"].alias("r"))
        return F.when(r % 2 == 0, even).otherwise(F.struct(x["l"].alias("l"), moved(x["r"], x["l"], r).alias("r")))

    start = F.struct(F.substr(text, F.lit(1), a).alias("l"), F.substr(text, a + 1, n - a).alias("r"))
    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda h: F.concat(h["l"], h["r"]))


def _relettered(shape: Column, tweak: Column, key: Column) -> Column:
    """The shape with its letters and digits permuted and its other signs in place."""
    plain = F.regexp_replace(shape, "[^a-z0-9]", "")

    def fill(new: Column) -> Column:
        def step(a: Column, c: Column) -> Column:
            own = c.rlike("^[a-z0-9]$")
            return F.struct(F.concat(a["s"], F.when(own, F.substr(new, a["i"], F.lit(1))).otherwise(c)).alias("s"), F.when(own, a["i"] + 1).otherwise(a["i"]).alias("i"))

        return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), step)["s"]

    return _let(permuted_letters(plain, tweak, key), fill)


def _email(m: Column, key: Column) -> Column:
    whole = F.lower(m)
    name, domain = F.substring_index(whole, "@", 1), F.substring_index(whole, "@", -1)
    last = F.substring_index(domain, ".", -1)
    labels = F.substr(domain, F.lit(1), F.length(domain) - F.length(last) - 1)
    return F.concat(_relettered(name, F.concat_ws("|", F.lit("email"), domain), key), F.lit("@"), _relettered(labels, F.lit("domain"), key), F.lit("."), last)


def _ip(m: Column, key: Column) -> Column:
    part = lambda i: F.get(F.split(m, r"\."), F.lit(i)).cast("long")
    halves = feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), F.lit("ip"), key)
    return _let(halves, lambda h: F.concat_ws(".", *[x.cast("string") for v in (h["l"], h["r"]) for x in (F.floor(v / 256), v % 256)]))


def _iban(m: Column, key: Column) -> Column:
    body = F.substr(m, F.lit(5), F.length(m) - 4)
    own = digits(body)
    moved = F.when(F.length(own) >= 2, refill(body, permuted_digits(own, "iban", key))).otherwise(body)
    country = F.substring(m, 1, 2)
    made = _let(moved, lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
    return F.when(mod97(F.concat(body, F.substring(m, 1, 4))) == 1, made).otherwise(m)


def _ssn(m: Column, key: Column) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    index = F.when(area < 666, area - 1).otherwise(area - 2)  # 898 areas
    halves = feistel(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key)
    place = lambda h: F.floor(h["l"] / 99)
    made = _let(halves, lambda h: F.concat_ws("-", F.lpad(F.when(place(h) + 1 < 666, place(h) + 1).otherwise(place(h) + 2).cast("string"), 3, "0"), F.lpad((h["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((h["r"] + 1).cast("string"), 4, "0")))
    return F.when(valid, made).otherwise(m)


def _date(m: Column, key: Column) -> Column:
    def moved(pattern: str) -> Column:
        day = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(pattern))), F.lit(FIRST_DAY).cast("date"))
        a, b = DAY_HALVES
        halves = feistel(F.floor(day / b), day % b, F.lit(a), F.lit(b), F.lit("date"), key)
        made = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), _let(halves, lambda h: (h["l"] * b + h["r"]).cast("int"))), pattern)
        return F.when(day.between(0, DAYS - 1), made).otherwise(m)

    return F.when(m.contains("-"), moved("yyyy-MM-dd")).otherwise(moved("dd/MM/yyyy"))


def _phone(m: Column, key: Column) -> Column:
    own = digits(m)
    n = F.length(own)
    keep = F.greatest(n - 10, F.when(m.startswith("+"), 1).otherwise(0))
    return refill(m, F.concat(F.substr(own, F.lit(1), keep), permuted_digits(F.substr(own, keep + 1, n - keep), "phone", key)))


def _card(m: Column, key: Column) -> Column:
    own = digits(m)
    payload, last = F.substr(own, F.lit(1), F.length(own) - 1), F.right(own, F.lit(1)).cast("int")
    made = _let(permuted_digits(payload, "card", key), lambda p: refill(m, F.concat(p, luhn_digit(p).cast("string"))))
    return F.when(luhn_digit(payload) == last, made).otherwise(m)


MAKERS = {"email": _email, "ip": _ip, "iban": _iban, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}


def kind_of(m: Column) -> Column:
    """The first format that the whole match has; looks around don't see neighbours here."""
    found = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        found = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(found)
    return found


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """Every row: doc_id, text with pseudonyms, and the number of values replaced of each kind. The key must be secret and not empty."""
    if not key:
        raise ValueError("pseudonyms need a key")
    union = "|".join(f"(?:{p})" for p in PATTERNS.values())
    text, secret = F.col("text"), F.lit(key)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("found", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(union), F.lit(0))))
    rows = rows.withColumn("found", F.when(F.size("found") > 0, F.transform("found", lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))))

    def made(x: Column) -> Column:
        out = x["m"]
        for kind, maker in MAKERS.items():
            out = F.when(x["kind"] == kind, F.coalesce(maker(x["m"], secret), x["m"])).otherwise(out)
        return F.struct(x["m"].alias("m"), x["kind"].alias("kind"), out.alias("to"))

    rows = rows.withColumn("found", F.transform("found", made))
    pieces = F.split(text, union, -1)
    whole = F.array_join(F.flatten(F.zip_with(pieces, F.col("found"), lambda p, x: F.array(p, F.coalesce(x["to"], F.lit(""))))), "")
    counts = [F.when(F.col("found").isNull(), 0).otherwise(F.size(F.filter("found", _replaced(k)))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", F.when(F.col("found").isNotNull(), whole).otherwise(text).alias("text"), *counts)


def _replaced(kind: str):
    return lambda x: (x["kind"] == kind) & (x["to"] != x["m"])

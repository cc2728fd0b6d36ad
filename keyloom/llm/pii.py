"""Format-preserving Feistel pseudonyms for private numbers, addresses, keys and dates, in DataFrame functions alone.

A value is found by its format, validated, and permuted with a key within its format, so a pseudonym is valid
again and equal values stay linked across documents, whatever separators they are written with:

- cards: 13 to 19 digits, grouped or not, with a right Luhn digit; the first digit stays, the last is set anew
- phones: North American numbers; with +1 or brackets any digit is in front of area and exchange, else 2 to 9; each
  keeps 2 to 9, or 0 to 1, in front
- social security numbers: ddd-dd-dddd, permuted as numbers of the assigned ranges (areas 001 to 899 but 666, groups
  from 01, serials from 0001)
- IPv4 addresses: four octets up to 255, permuted as one 32-bit number
- e-mail addresses: the local part, letters as letters and digits as digits; the domain stays
- access keys and values of password, secret, token and the like with a digit: digits as digits, letters as letters of
  their case, hexadecimal values as such
- dates: yyyy-mm-dd, dd/mm/yyyy, mm/dd/yyyy and dd.mm.yyyy that exist, permuted as day numbers within 400 years

Digits and letters go through eight alternating Feistel rounds: the one half shifts each character of the other
within its alphabet, by a SHA-512 of key, kind, round and half. Day numbers (189 x 773 of them in 400 years),
addresses (2^16 x 2^16) and social security numbers (898 x 99 by 9999) go through the same rounds as pairs of numbers.

Whoever has the key can undo a pseudonym: it is a parameter, and queries take it from spark.keyloom.pii.key.
No pattern repeats a group more than 126 times (a host has at most 127 labels), so no text exhausts the stack.

Edge cases: null stays null, empty stays empty. A value that fails validation is left alone. A local part of one
character may map to itself. Texts of any length are rewritten whole; equal texts give equal results.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted

#: Formats, tried in this order where several fit. No group of the whole captures.
_NAMED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[ ]?[=:][ ]?[\"']?"
PATTERNS = {
    "secret": rf"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{{16}}|{_NAMED}(?=[A-Za-z+/_-]*\d)[A-Za-z0-9+/_-]{{8,1024}})(?![A-Za-z0-9+/_-])",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,62}@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "date": r"(?<![\d.,/-])(?:\d{4}-\d\d-\d\d|\d\d?/\d\d?/\d{4}|\d\d?\.\d\d?\.\d{4})(?![\d/-])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\dA-Za-z])(?:\+1[ .-]?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}|(?:1[ .-]?)?(?:\(\d{3}\) ?\d{3}|[2-9]\d\d[ .-][2-9]\d\d))[ .-]\d{4}(?!\d)",
    "card": r"(?<![\dA-Za-z.-])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 8
PUBLIC_KEY = "keyloom"
_ALPHABETS = {"9": "0123456789", "N": "23456789", "O": "01", "x": "0123456789abcdef", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def key_of(spark: SparkSession) -> str:
    """The key of spark.keyloom.pii.key; where that is unset a public one, for tests and measurements alone."""
    key = spark.conf.get("spark.keyloom.pii.key", None) or spark.sparkContext.getConf().get("spark.keyloom.pii.key")
    if key is None:
        warnings.warn("spark.keyloom.pii.key is not set: pseudonyms made with the public key can be undone by anyone", stacklevel=2)
    return key or PUBLIC_KEY


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _int16(digest: Column, i: Column) -> Column:
    """The i-th number (from 0) of four hexadecimal digits; digests hold 32 of them."""
    return F.conv(F.substring(digest, i % 32 * 4 + 1, 4), 16, 10).cast("int")


def _digest(key: str, kind: str, step: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), half), 512)


def _alphabet(m: Column) -> Column:
    out = F.lit("")
    for name, alphabet in _ALPHABETS.items():
        out = F.when(m == name, F.lit(alphabet)).otherwise(out)
    return out


def _shifted(chars: Column, alphabets: Column, digest: Column) -> Column:
    """Each character moved on in its alphabet; those with none stay."""

    def one(d: Column) -> Column:
        def moved(pair: Column, i: Column) -> Column:
            n = F.length(pair["a"])
            place = F.pmod(F.instr(pair["a"], pair["c"]) - 1 + _int16(d, i), n) + 1
            return F.when(n > 0, F.substring(pair["a"], place, F.lit(1))).otherwise(pair["c"])

        return F.transform(F.arrays_zip(chars.alias("c"), alphabets.alias("a")), moved)

    return _let(digest, one)


def feistel_text(value: Column, mask: Column, key: str, kind: str) -> Column:
    """value permuted within the format of mask (a string as long, of names of alphabets or '.' for what stays)."""
    parts = F.struct(F.split(value, "").alias("chars"), F.transform(F.split(mask, ""), _alphabet).alias("masks"), F.length(value).alias("n"))
    return _let(parts, lambda p: _feistel(p["chars"], p["masks"], p["n"], key, kind))


def _feistel(chars: Column, masks: Column, n: Column, key: str, kind: str) -> Column:
    half = F.floor(n / 2).cast("int")
    lm, rm = F.slice(masks, 1, half), F.slice(masks, half + 1, n - half)

    def step(acc: Column, i: Column) -> Column:
        left = _shifted(acc["l"], lm, _digest(key, kind, i, F.array_join(acc["r"], "")))
        right = _shifted(acc["r"], rm, _digest(key, kind, i, F.array_join(acc["l"], "")))
        return F.when(i % 2 == 0, F.struct(left.alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), right.alias("r")))

    start = F.struct(F.slice(chars, 1, half).alias("l"), F.slice(chars, half + 1, n - half).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda a: F.array_join(F.concat(a["l"], a["r"]), ""))


def feistel_pair(number: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A number below a * b permuted there."""

    def step(acc: Column, i: Column) -> Column:
        left = F.pmod(acc["l"] + _big(_digest(key, kind, i, acc["r"].cast("string"))), F.lit(a))
        right = F.pmod(acc["r"] + _big(_digest(key, kind, i, acc["l"].cast("string"))), F.lit(b))
        return F.when(i % 2 == 0, F.struct(left.alias("l"), acc["r"].alias("r"))).otherwise(F.struct(acc["l"].alias("l"), right.alias("r")))

    start = F.struct(F.floor(number / b).cast("bigint").alias("l"), F.pmod(number, F.lit(b)).cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: acc["l"] * b + acc["r"])


def _big(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits that ends with its check digit."""
    n = F.length(digits)

    def one(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        double = d * 2 - F.when(d > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), one)


def _laid(original: Column, digits: Column) -> Column:
    """The digits in the places that original has digits in."""

    def one(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        put = F.when(is_digit, F.substring(digits, acc["i"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["s"], put).alias("s"), (acc["i"] + is_digit.cast("int")).alias("i"))

    return F.aggregate(F.split(original, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), one, lambda a: a["s"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(m: Column, key: str) -> Column:
    def new(digits: Column) -> Column:
        n = F.length(digits)
        return feistel_text(F.substring(digits, F.lit(1), n - 1), F.concat(F.lit("."), F.repeat(F.lit("9"), n - 2)), key, "card")

    def checked(body: Column) -> Column:
        return _laid(m, F.concat(body, F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))

    return _let(_digits(m), lambda d: F.when(F.pmod(_luhn(d), F.lit(10)) == 0, _let(new(d), checked)).otherwise(m))


def _phone(m: Column, key: str) -> Column:
    def new(digits: Column) -> Column:
        area, exchange = (F.when(F.substring(F.right(digits, F.lit(10)), i, 1) < "2", F.lit("O99")).otherwise(F.lit("N99")) for i in (1, 4))
        ten = feistel_text(F.right(digits, F.lit(10)), F.concat(area, exchange, F.lit("9999")), key, "phone")
        return _let(F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), ten), lambda x: _laid(m, x))

    return _let(_digits(m), new)


def _ssn(m: Column, key: str) -> Column:
    def parts(digits: Column) -> Column:
        return F.struct(*[F.substring(digits, at, n).cast("bigint").alias(name) for name, at, n in (("area", 1, 3), ("group", 4, 2), ("serial", 6, 4))])

    def number(p: Column) -> Column:
        valid = p["area"].between(1, 899) & (p["area"] != 666) & (p["group"] > 0) & (p["serial"] > 0)
        place = p["area"] - 1 - (p["area"] > 666).cast("bigint")
        return F.when(valid, (place * 99 + p["group"] - 1) * 9999 + p["serial"] - 1)

    def text(new: Column) -> Column:
        place = F.floor(new / (99 * 9999)).cast("bigint")
        area, group, serial = place + 1 + (place >= 665).cast("bigint"), F.pmod(F.floor(new / 9999), F.lit(99)) + 1, F.pmod(new, F.lit(9999)) + 1
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (group, 2), (serial, 4))])

    def permuted(n: Column) -> Column:
        return F.when(n.isNull(), m).otherwise(_let(feistel_pair(n, 898 * 99, 9999, key, "ssn"), text))

    return _let(_let(parts(_digits(m)), number), permuted)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.try_cast("bigint"))
    number = F.aggregate(octets, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)

    def text(new: Column) -> Column:
        return F.concat_ws(".", *[F.pmod(F.shiftright(new, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])

    return F.when(F.forall(octets, lambda x: x < 256), _let(feistel_pair(number, 1 << 16, 1 << 16, key, "ip"), text)).otherwise(m)


def _classes(text: Column) -> Column:
    """The mask of a text by the class of each character."""
    for pattern, name in (("[^A-Za-z0-9]", "."), ("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "9")):
        text = F.regexp_replace(text, pattern, name)
    return text


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, f"^(?:AKIA|{_NAMED})", 0)
    value = F.substring(m, F.length(head) + 1, F.length(m))
    mask = F.when(value.rlike("^[0-9a-f]+$"), F.repeat(F.lit("x"), F.length(value))).otherwise(_classes(value))
    return F.concat(head, feistel_text(value, mask, key, "secret"))


def _email(m: Column, key: str) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(feistel_text(local, _classes(local), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _date(m: Column, key: str) -> Column:
    iso, slash = m.contains("-"), m.contains("/")

    def read(part: Column) -> Column:
        a, b, c = (F.get(part, i).try_cast("int") for i in range(3))
        american = slash & (b > 12)  # mm/dd/yyyy where dd/mm/yyyy can't be
        return F.struct(
            F.when(iso, a).otherwise(c).alias("y"), F.when(iso, b).when(american, a).otherwise(b).alias("m"), F.when(iso, c).when(american, b).otherwise(a).alias("d"),
            american.alias("american"), (F.length(F.get(part, 0)) == 2).alias("wide"),
        )

    def permuted(p: Column) -> Column:
        date = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"]), F.lit("yyyy-MM-dd")).cast("date")
        # 400 years of the Gregorian calendar are 146097 = 189 x 773 days: of 1800 to 2199, or 400s from there.
        cycle = F.floor((p["y"] - 1800) / 400).cast("bigint") * 146097
        origin = F.lit("1800-01-01").cast("date")
        number = F.datediff(date, origin).cast("bigint") - cycle
        return F.when(date.isNotNull() & (p["y"] >= 1), F.date_add(origin, (feistel_pair(number, 189, 773, key, "date") + cycle).cast("int")))

    def written(p: Column, new: Column) -> Column:
        y, mo, d = (F.lpad(f(new).cast("string"), n, "0") for f, n in ((F.year, 4), (F.month, 2), (F.dayofmonth, 2)))
        short = lambda x: F.when(p["wide"], x).otherwise(F.regexp_replace(x, "^0", ""))
        text = F.when(iso, F.concat_ws("-", y, mo, d)).when(p["american"], F.concat_ws("/", short(mo), short(d), y))
        text = text.when(slash, F.concat_ws("/", short(d), short(mo), y)).otherwise(F.concat_ws(".", short(d), short(mo), y))
        return F.coalesce(text, m)

    return _let(_let(F.split(m, r"[-/.]"), read), lambda p: _let(permuted(p), lambda new: F.when(new.isNotNull(), written(p, new)).otherwise(m)))


def kind_of(m: Column) -> Column:
    """Which format a match has."""
    out = F.when(m.rlike(f"^(?:AKIA[0-9A-Z]{{16}}$|{_NAMED})"), F.lit("secret")).when(m.contains("@"), F.lit("email"))
    for name, pattern in list(PATTERNS.items())[2:]:
        bare = pattern
        while bare.startswith("(?<!"):
            bare = bare[bare.index(")") + 1 :]
        bare = bare[: bare.rindex("(?!")]
        out = out.when(m.rlike(f"^(?:{bare})$"), F.lit(name))
    return out


def pseudonym(m: Column, key: str) -> Column:
    made = {"secret": _secret, "email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}

    def by_kind(kind: Column) -> Column:
        out = m
        for name, f in made.items():
            out = F.when(kind == name, f(m, key)).otherwise(out)
        return F.coalesce(out, m)

    return _let(kind_of(m), by_kind)


def changes_of(text: Column, key: str) -> Column:
    """An array of (kind, value, pseudonym) for each value found, changed or not; null where nothing can be found."""
    # One look for a digit or an @ spares the other texts the patterns.
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    return F.transform(found, lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value"), pseudonym(m, key).alias("pseudonym")))


def rewritten(text: Column, changes: Column) -> Column:
    gaps = F.split(text, ANY, -1)
    put = F.zip_with(gaps, changes["pseudonym"], lambda g, p: F.concat(g, F.coalesce(p, F.lit(""))))
    return F.when(F.size(changes) > 0, F.array_join(put, "")).otherwise(text)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with their text rewritten; columns as in docs."""
    text = F.col("text").cast("string")
    new = _let(changes_of(text, key), lambda c: rewritten(text, c))
    return docs.select(*[new.alias(c) if c.lower() == "text" else F.col(quoted(c)) for c in docs.columns])


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (rewritten), n_found, n_changed, kinds (of the changed, sorted, distinct)."""
    text = F.col("text").cast("string")

    def result(c: Column) -> Column:
        changed = F.filter(c, lambda x: x["value"] != x["pseudonym"])
        kinds = F.array_join(F.array_sort(F.array_distinct(changed["kind"])), ",")
        return F.struct(rewritten(text, c).alias("text"), F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias("n_found"), F.greatest(F.coalesce(F.size(changed), F.lit(0)), F.lit(0)).alias("n_changed"), F.coalesce(kinds, F.lit("")).alias("kinds"))

    return docs.select(F.col("doc_id"), _let(changes_of(text, key), result).alias("r")).select("doc_id", "r.*")

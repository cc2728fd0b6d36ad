"""Column expressions that several operators share. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Radius of the earth in metres, limits of the coordinates, metres in a unit.
EARTH_RADIUS = 6372797.560856
LON_LIMIT, LAT_LIMIT = 180.0, 85.05112878
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"
GEO_BITS = 26


def range_norm(length: Column, start: int, stop: int, formal: bool = False) -> tuple[Column, Column]:
    """First and last index (inclusive) of a slice with negative indexes from the end; empty where first > last.
    formal: a stop before the beginning still keeps the first element."""
    first = F.greatest(length + start if start < 0 else F.lit(start), F.lit(0))
    last = length + stop if stop < 0 else F.lit(stop)
    if formal:
        last = F.greatest(last, F.lit(0))
    return first.cast("bigint"), F.least(last, length - 1).cast("bigint")


def score_bound(score: Column, bound: str | float, lower: bool) -> Column:
    """score within a bound: a number, '(number' for an exclusive one, '-inf' or '+inf'."""
    text = str(bound)
    open_ = text.startswith("(")
    text = text[1:] if open_ else text
    if text in ("-inf", "+inf", "inf"):
        return F.lit((text == "-inf") == lower)
    value = F.lit(float(text))
    if lower:
        return score > value if open_ else score >= value
    return score < value if open_ else score <= value


def lex_bound(member: Column, bound: str, lower: bool) -> Column:
    """member within '[text', '(text', '-' or '+', by bytes."""
    if bound in "-+":
        return F.lit((bound == "-") == lower)
    if bound[0] not in "[(":
        raise ValueError("min or max not valid string range item")
    value = F.lit(bound[1:])
    if lower:
        return member > value if bound[0] == "(" else member >= value
    return member < value if bound[0] == "(" else member <= value


def glob(text: Column, pattern: str) -> Column:
    """Only the first '*' is a wildcard; the rest is a literal beginning and a literal end that don't overlap."""
    head, star, tail = pattern.partition("*")
    if not star:
        return text == pattern
    return text.startswith(head) & text.endswith(tail) & (F.length(text) >= len(head) + len(tail))


def live(expire_at_ms: Column, now_ms: int) -> Column:
    return expire_at_ms.isNull() | (expire_at_ms > now_ms)


def visible(governance: Column, allowed: list[str] | None = None) -> Column:
    """Governed rows are seen only by those who may see their governance."""
    return governance.isNull() | (governance.isin(allowed) if allowed else F.lit(False))


def ttl(present: Column, expire_at_ms: Column, now_ms: int, seconds: bool = True) -> Column:
    """-2 missing, -1 without a deadline, else what is left (seconds rounded up)."""
    left = expire_at_ms - now_ms
    return F.when(~present, F.lit(-2)).when(expire_at_ms.isNull(), F.lit(-1)).otherwise(F.ceil(left / 1000) if seconds else left).cast("bigint")


def expire_gate(old: Column, new: Column, flag: str | None) -> Column:
    """Whether a conditional deadline applies: without one, NX and LT pass, XX and GT fail."""
    if flag == "NX":
        return old.isNull()
    if flag == "XX":
        return old.isNotNull()
    if flag == "GT":
        return old.isNotNull() & (new > old)
    if flag == "LT":
        return old.isNull() | (new < old)
    return F.lit(True)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where lengths differ or a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norms = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(dot / norms)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two places."""
    u, v = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return F.lit(2.0 * EARTH_RADIUS) * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v))


def rounded(x: Column, digits: int = 0) -> Column:
    """round(x, digits) to the bit, in plain arithmetic but where x is next to a half: Spark rounds by decimal text."""
    whole = F.rint(x * 10**digits)
    return F.when((F.abs(x) < 1e9) & (F.abs(x * 10**digits - whole) < 0.4999), whole / 10**digits).otherwise(F.round(x, digits))


def geo_encode(lon: Column, lat: Column) -> Column:
    """26 bits of longitude above 26 of latitude, not interleaved."""
    top = (1 << GEO_BITS) - 1

    def bits(x: Column, limit: float) -> Column:
        return rounded((x + limit) / (2 * limit) * top).cast("bigint")

    return F.shiftleft(bits(lon, LON_LIMIT), GEO_BITS).bitwiseOR(bits(lat, LAT_LIMIT))


def geo_decode(score: Column) -> tuple[Column, Column]:
    top = (1 << GEO_BITS) - 1
    lon = F.shiftright(score, GEO_BITS).cast("double") / top * (2 * LON_LIMIT) - LON_LIMIT
    lat = score.bitwiseAND(F.lit(top)).cast("double") / top * (2 * LAT_LIMIT) - LAT_LIMIT
    return lon, lat


def geohash(score: Column) -> Column:
    """Eleven characters of five bits each, from bit 50 of the score down to its last bits."""
    parts = [F.shiftright(score, shift) for shift in range(50, -1, -5)]
    return F.concat(*[F.substring(F.lit(GEOHASH), p.bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for p in parts])


def json_field(path: str) -> str | None:
    """The field of a one-level path; '' for the root, None for a path that resolves to nothing."""
    name = path.removeprefix("$").removeprefix(".")
    return None if "." in name else name


def json_get(doc: Column, path: str) -> Column:
    """The JSON text at a path, null where nothing is there."""
    name = json_field(path)
    if name is None:
        return F.lit(None).cast("string")
    if name == "":
        return F.to_json(F.try_parse_json(doc))
    return F.to_json(F.try_variant_get(F.try_parse_json(doc), f"$.{name}", "variant"))


def json_type(doc: Column, path: str) -> Column:
    text = json_get(doc, path)
    head = F.substring(text, 1, 1)
    return (
        F.when(text.isNull(), F.lit(None)).when(head == "{", "object").when(head == "[", "array").when(head == '"', "string")
        .when(text.isin("true", "false"), "boolean").when(text == "null", "null").otherwise("number")
    )


def bytes_of(value: Column) -> Column:
    """Bytes of a value as an array of numbers."""
    text = F.hex(value)
    n = F.octet_length(value)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substring(text, i * 2 - 1, F.lit(2)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def popcount(value: Column) -> Column:
    return F.aggregate(bytes_of(value), F.lit(0), lambda s, b: s + F.bit_count(b))


def bit_at(value: Column, offset: int) -> Column:
    """The bit at an offset, most significant bit of the first byte first; 0 past the end."""
    byte = F.conv(F.hex(F.substring(value.cast("binary"), offset // 8 + 1, 1)), 16, 10).cast("int")
    return F.when(F.octet_length(value) > offset // 8, F.shiftright(byte, 7 - offset % 8).bitwiseAND(F.lit(1))).otherwise(F.lit(0))

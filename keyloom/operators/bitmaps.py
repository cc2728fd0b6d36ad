"""Bit strings as values, and bitmaps as relations (key, bit): counts, positions and algebra (also roaring sets)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bit_at, bytes_of, popcount, range_norm
from .state import matching


def getbit(value: Column, offset: int) -> Column:
    return bit_at(value, offset)


def bitcount(value: Column, start: int = 0, stop: int = -1) -> Column:
    """Bits set in bytes start to stop."""
    data = value.cast("binary")
    first, last = range_norm(F.octet_length(data), start, stop, formal=True)
    return F.when(first <= last, popcount(F.substring(data, (first + 1).cast("int"), (last - first + 1).cast("int")))).otherwise(0)


def bitpos(value: Column, bit: int) -> Column:
    """Position of the first such bit: -1 for no set bit; all bits set give the length for a clear one."""
    data = bytes_of(value.cast("binary"))
    skip = 255 if bit == 0 else 0
    at = F.array_position(F.transform(data, lambda b: b != skip), F.lit(True)) - 1
    byte = F.get(data, at.cast("int"))
    inside = F.lit(8) - F.length(F.conv((F.lit(255) - byte if bit == 0 else byte).cast("string"), 10, 2))
    return F.when(at >= 0, at * 8 + inside).otherwise(F.octet_length(value) * 8 if bit == 0 else F.lit(-1)).cast("bigint")


def bitop(op: str, a: Column, b: Column | None = None) -> Column:
    """Bytes combined, the shorter padded with zeros, in hexadecimal."""
    x = bytes_of(a.cast("binary"))
    if op == "NOT":
        out = F.transform(x, lambda v: F.lit(255) - v)
    else:
        f = {"AND": lambda u, v: u.bitwiseAND(v), "OR": lambda u, v: u.bitwiseOR(v), "XOR": lambda u, v: u.bitwiseXOR(v)}[op]
        out = F.zip_with(x, bytes_of(b.cast("binary")), lambda u, v: f(F.coalesce(u, F.lit(0)), F.coalesce(v, F.lit(0))))
    return F.array_join(F.transform(out, lambda v: F.lpad(F.hex(v), 2, "0")), "")


def bitfield_get(value: Column, offset: int, width: int, signed: bool = False) -> Column:
    """A packed number of up to 63 bits from a bit offset."""
    out = F.lit(0).cast("bigint")
    for i in range(width):
        out = F.shiftleft(out, 1).bitwiseOR(bit_at(value, offset + i).cast("bigint"))
    return F.when(out >= (1 << (width - 1)), out - F.lit(1 << width)).otherwise(out) if signed and width < 63 else out


def cardinality(bits: DataFrame) -> DataFrame:
    """key, n: R.BITCOUNT, R.STAT. Bits are distinct, so a count does."""
    return bits.groupBy("key").agg(F.count("*").alias("n"))


def edges(bits: DataFrame) -> DataFrame:
    """key, least, most."""
    return bits.groupBy("key").agg(F.min("bit").alias("least"), F.max("bit").alias("most"))


def bit_array(bits: DataFrame) -> DataFrame:
    """key, text of zeros and ones up to the greatest bit (R.GETBITARRAY). The text is one value; for large bits take the rows."""
    sets = bits.groupBy("key").agg(F.sort_array(F.collect_set("bit")).alias("on"))
    every = F.sequence(F.lit(0).cast("bigint"), F.element_at("on", -1))
    return sets.select("key", F.array_join(F.transform(every, lambda i: F.array_contains(F.col("on"), i).cast("int").cast("string")), "").alias("text"))


def get_bits(bits: DataFrame, probes: DataFrame) -> DataFrame:
    """key, bit, is_set (1 or 0) of probes (R.GETBITS, R.GETBIT)."""
    keys = ["key", "bit"]
    found = probes.join(matching(bits, probes, keys).select(*keys, F.lit(1).alias("f")).distinct(), keys, "left")
    return found.select(*keys, F.coalesce("f", F.lit(0)).alias("is_set"))


def set_bits(bits: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """bits with the numbers of values (bit) as the whole set of a key (R.SETINTARRAY, R.SETBITARRAY)."""
    return bits.filter(F.col("key") != key).unionByName(values.select(F.lit(key).alias("key"), "bit").distinct())


def members_between(bits: DataFrame, start: int, stop: int) -> DataFrame:
    return bits.filter(F.col("bit").between(start, stop))


def first_gap(bits: DataFrame) -> DataFrame:
    """key, gap: the least number from 0 that is not in the set."""
    w = Window.partitionBy("key").orderBy("bit")
    runs = bits.withColumn("next", F.lead("bit").over(w)).withColumn("rn", F.row_number().over(w) - 1)
    ends = runs.filter((F.col("bit") == F.col("rn")) & (F.col("next").isNull() | (F.col("next") > F.col("bit") + 1)))
    gaps = ends.groupBy("key").agg((F.min("bit") + 1).alias("gap"))
    return bits.select("key").distinct().join(gaps, "key", "left").select("key", F.coalesce("gap", F.lit(0)).alias("gap"))


def combine(bits: DataFrame, op: str, keys: list[str]) -> DataFrame:
    """bit of AND, OR, XOR (of the sets in turn) or DIFF (the first without the rest) of the keys: one grouping by bit
    over tagged sets, however many there are."""
    rows = bits.filter(F.col("key").isin(keys))
    n = F.lit(len(set(keys)))
    first = F.max((F.col("key") == keys[0]).cast("int"))
    grouped = rows.groupBy("bit").agg(F.count_distinct("key").alias("n"), first.alias("first"))
    test = {"AND": F.col("n") == n, "OR": F.lit(True), "XOR": F.col("n") % 2 == 1, "DIFF": (F.col("n") == 1) & (F.col("first") == 1)}
    return grouped.filter(test.get(op, F.lit(True))).select("bit")


def jaccard(bits: DataFrame, a: str, b: str) -> DataFrame:
    """One row; 1.0 for two empty sets."""
    grouped = bits.filter(F.col("key").isin(a, b)).groupBy("bit").agg(F.count_distinct("key").alias("n"))
    both, all_ = F.count(F.when(F.col("n") == (1 if a == b else 2), 1)), F.count("*")
    return grouped.agg(F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_).alias("jaccard"))


def set_range(spark, key: str, start: int, stop: int, most: int = 100_000) -> DataFrame:
    if stop - start + 1 > most:
        raise ValueError("range too large")
    return spark.range(start, stop + 1).select(F.lit(key).alias("key"), F.col("id").alias("bit"))


def bitfield_incr(value: Column, offset: int, width: int, delta: int, overflow: str = "WRAP", signed: bool = False) -> Column:
    """A packed number of up to 62 bits after an addition: WRAP goes round, SAT stops at the ends, FAIL gives null."""
    low, high = (-(1 << width - 1), (1 << width - 1) - 1) if signed else (0, (1 << width) - 1)
    new = bitfield_get(value, offset, width, signed) + F.lit(delta).cast("bigint")
    if overflow == "SAT":
        return F.least(F.greatest(new, F.lit(low)), F.lit(high))
    if overflow == "FAIL":
        return F.when(new.between(low, high), new)
    return F.pmod(new - low, F.lit(1 << width)) + low


def bitfield_set(value: Column, offset: int, width: int, number: Column) -> Column:
    """The bytes with a packed number written at a bit offset, longer by zeros where needed."""
    need = -(-(offset + width) // 8) * 8
    bits = F.array_join(F.transform(bytes_of(value.cast("binary")), lambda b: F.lpad(F.bin(b), 8, "0")), "")
    padded = F.rpad(bits, F.greatest(F.length(bits), F.lit(need)), F.lit("0"))
    low = F.right(F.concat(F.lit("0" * width), F.bin(number.cast("bigint"))), F.lit(width))
    written = F.concat(F.substring(padded, 1, offset), low, F.substring(padded, offset + width + 1, 1 << 30))
    parts = F.transform(F.sequence(F.lit(0), (F.length(written) / 8).cast("int") - 1), lambda i: F.lpad(F.conv(F.substring(written, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
    return F.unhex(F.array_join(parts, ""))

"""I-Match fingerprints in DataFrame functions alone.

Terms are runs of letters and digits, lower-cased. The lexicon keeps terms whose document frequency over the
whole corpus is within a band of shares (a band of inverse document frequency). Each of eight randomised
lexicons holds about 70 % of it, by the term's MD5. A fingerprint has one MD5 for each randomised lexicon: of
the document's distinct terms in it, sorted. The likeness of two fingerprints is the share of equal hashes.

The lexicon's size is bounded: terms in at least the share `rare` of documents are at most the mean number of
distinct terms of a document divided by `rare`, however many documents there are. It is kept as one array of
cells of about four hashes that every task can look up, so no document is shuffled for its fingerprint.

Edge cases: null counts as the empty text. A document with no term in a lexicon gets the MD5 of its whole text
there, so equal texts always agree and others don't. doc_ids may span all 64 bits. Null doc_ids come last in descending
order, equal ones by the hash of their text. Other columns are ignored. One document alone is its own next document.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, partitions, quoted, released, stage_table

SETS = 8
_SPLIT = r"[^\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), _SPLIT)), lambda t: t != "")


def lexicon(docs: DataFrame, rare: float = 0.002, common: float = 0.2) -> DataFrame:
    """One row: cells, an array of arrays of (hash of a term without its low byte) | its sets."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = texts.count()
    frequency = texts.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = frequency.filter((F.col("df") >= F.lit(rare * n)) & (F.col("df") <= F.lit(max(common * n, 1.0))))
    digest = F.md5("term")
    bits = [F.when(F.conv(F.substring(digest, 2 * j + 1, 2), 16, 10).cast("int") < 179, 1 << j).otherwise(0) for j in range(SETS)]
    sets = bits[0]
    for b in bits[1:]:
        sets = sets + b
    h = F.xxhash64("term")
    band = stage_table(band.select(h.alias("h"), h.bitwiseAND(F.lit(-256)).bitwiseOR(sets.cast("bigint")).alias("entry")), "band")
    n_cells = max(16, band.count() // 4)
    entries = band.select(F.pmod("h", F.lit(n_cells)).cast("int").alias("cell"), "entry")
    cells = entries.groupBy("cell").agg(F.sort_array(F.collect_list("entry")).alias("entries"))
    every = docs.sparkSession.range(n_cells).select(F.col("id").cast("int").alias("cell"))
    full = every.join(cells, "cell", "left").select("cell", F.coalesce("entries", F.array().cast("array<bigint>")).alias("entries"))
    table = full.agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "entries"))), lambda x: x["entries"]).alias("cells"))
    return stage_table(table, "lexicon")


def fingerprint(text: Column, cells: Column) -> Column:
    """The array of hashes of a text under a lexicon's cells."""

    def sets(h: Column) -> Column:
        bare = h.bitwiseAND(F.lit(-256))
        hit = F.filter(F.element_at(cells, (F.pmod(h, F.size(cells)) + 1).cast("int")), lambda e: e.bitwiseAND(F.lit(-256)) == bare)
        return F.coalesce(F.get(hit, 0).bitwiseAND(F.lit(255)), F.lit(0).cast("bigint"))

    hashed = F.transform(terms_of(text), lambda t: F.struct(t.alias("t"), F.xxhash64(t).alias("h")))
    marked = F.transform(hashed, lambda x: F.struct(x["t"].alias("t"), sets(x["h"]).alias("s")))
    inside = F.sort_array(F.filter(marked, lambda x: x["s"] > 0))

    def hashes(found: Column) -> Column:
        def one(mine: Column) -> Column:
            return F.md5(F.when(F.size(mine) > 0, F.array_join(mine, " ")).otherwise(F.concat(F.lit("text:"), text)))

        return F.array(*[F.transform(F.array(F.filter(found, lambda x: x["s"].bitwiseAND(F.lit(1 << j)) != 0)["t"]), one)[0] for j in range(SETS)])

    return F.transform(F.array(inside), hashes)[0]


def with_fingerprint(rows: DataFrame, name: str, text: str, cells: DataFrame) -> DataFrame:
    """rows with the fingerprint of a text column. A scalar subquery can't be written inside a lambda, so the cells
    (some 14 bytes for each term of the lexicon) are a column for a moment."""
    kept = [F.col(quoted(c)) for c in rows.columns]
    return rows.select(*kept, cells.scalar().alias("__cells")).select(*kept, fingerprint(F.col(text), F.col("__cells")).alias(name))


def likeness(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("double")), F.lit(0.0), lambda s, x: s + x) / SETS


def fingerprints(docs: DataFrame, **band) -> DataFrame:
    """docs with the array `fingerprint` (the lexicon is that of docs)."""
    cells = lexicon(docs, **band)
    rows = carried(docs, text=F.coalesce(F.col("text").cast("string"), F.lit("")))
    return released(with_fingerprint(rows, "fingerprint", "text", cells), docs.columns, fingerprint=F.col("fingerprint"))


def _literal(values: list[int]) -> Column:
    """An array of numbers folded to one literal, unlike an array of literals."""
    return F.split(F.lit(",".join(map(str, values)) or "0"), ",").cast("array<bigint>")


def _first_from(values: list[int], x: Column) -> Column:
    """How many of the sorted values are below x, by halving."""

    def step(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["lo"] + acc["hi"], 1)
        right = F.struct((middle + 1).alias("lo"), acc["hi"].alias("hi"))
        left = F.struct(acc["lo"].alias("lo"), middle.alias("hi"))
        return F.when(acc["lo"] >= acc["hi"], acc).when(F.element_at(_literal(values), middle + 1) < x, right).otherwise(left)

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(values)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(values).bit_length())), start, step, lambda acc: acc["lo"])


def ranged(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text, ...) with none, down and tie, which sort them by descending doc_id, and part, their range in
    that order; and the number of ranges.

    Bounds are quantiles of the doc_ids; rows of one doc_id that is several bounds (or null) are spread by the hash
    of their text. The driver holds a bound for each shuffle partition.
    """
    n = partitions(docs.sparkSession)
    # In ascending order: ids reversed bit by bit (which can't overflow), nulls last, then hashes.
    rows = docs.withColumn("none", F.col("doc_id").isNull().cast("int")).withColumn("down", F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("bigint"))).withColumn("tie", F.xxhash64("text"))
    quantiles = F.percentile_approx(F.when(F.col("none") == 0, F.col("down")), [i / n for i in range(1, n)], max(10_000, 4 * n))
    total, nulls, bounds = rows.agg(F.count("*"), F.coalesce(F.sum("none"), F.lit(0)), quantiles).first()
    bounds = sorted(bounds or [])
    distinct = sorted(set(bounds))
    before, times = [bounds.index(b) for b in distinct], [bounds.count(b) for b in distinct]
    last = max(1, -(-nulls * n // max(1, total)))  # ranges for nulls, after the n of the others

    def spread(ways: Column) -> Column:
        """0 to ways - 1, as the hash rises."""
        return F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * ways).cast("int"), ways - 1)

    at = _first_from(distinct, F.col("down")) + 1
    hit = F.try_element_at(_literal(distinct), at) == F.col("down") if distinct else F.lit(False)
    own_part = F.coalesce(F.try_element_at(_literal(before), at).cast("int"), F.lit(len(bounds))) + F.when(hit, spread(F.try_element_at(_literal(times), at).cast("int") + 1)).otherwise(0)
    part = F.when(F.col("none") == 1, F.lit(n) + spread(F.lit(last))).otherwise(own_part) if distinct else F.lit(n) + spread(F.lit(last))
    return rows.withColumn("part", part), n + last


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of docs (doc_id, text, ...) with next_<column>: those of the next row by descending doc_id (ties by
    hash and text), of the first after the last. Each range gets a copy of the row that follows its last one."""
    rows, n = ranged(docs)
    tops = {r.part: r.top for r in rows.groupBy("part").agg(F.min(F.struct("down", "tie")).alias("top")).collect()}
    # The first row of a range follows the range before it; the first of all follows the last range.
    parts = sorted(tops)
    above = {p: parts[i - 1] for i, p in enumerate(parts)}
    down, tie = (_literal([tops[p][i] if p in tops else 0 for p in range(n)]) for i in (0, 1))
    to_above = _literal([above.get(p, 0) for p in range(n)])
    place = F.col("part") + 1
    own = F.struct(F.col("part").cast("bigint").alias("part"), F.lit(0).alias("copy"))
    copy = F.struct(F.element_at(to_above, place).alias("part"), F.lit(1).alias("copy"))
    first = (F.col("down") == F.element_at(down, place)) & (F.col("tie") == F.element_at(tie, place))
    rows = rows.withColumn("to", F.explode(F.when(first, F.array(own, copy)).otherwise(F.array(own))))
    rows = rows.withColumn("part", F.col("to.part").cast("int")).withColumn("copy", F.col("to.copy")).drop("to").repartitionById(n, F.col("part"))
    order = Window.partitionBy("part").orderBy("copy", "none", "down", "tie", "text")
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return rows.filter("copy = 0").drop("part", "copy", "none", "down", "tie")


def edited_fingerprints(docs: DataFrame, **band) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends with the beginning of the next document's, in place of its own second half.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    cells = lexicon(docs, **band)
    rows = with_next(with_fingerprint(texts, "print", "text", cells), ["text", "print"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "print", "next_print")
    rows = with_fingerprint(rows, "edited_print", "edited", cells)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("print", "-").alias("fingerprint"), F.array_join("edited_print", "-").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


#: The same in DuckDB, for small tables.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT count(*) AS n FROM d),
t AS (SELECT doc_id, text, lead(text) OVER (ORDER BY doc_id DESC) AS after, first_value(text) OVER (ORDER BY doc_id DESC) AS top FROM d),
e AS (SELECT doc_id, text, coalesce(after, top) AS next_text, left(text, length(text) - length(text) // 2) || left(coalesce(after, top), length(text) // 2) AS edited FROM t),
v AS (SELECT doc_id, 0 AS kind, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e UNION ALL SELECT doc_id, 2, next_text FROM e),
w AS (SELECT DISTINCT doc_id, kind, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS term FROM v),
lex AS (SELECT term FROM w, n WHERE kind = 0 AND term <> '' GROUP BY term, n.n HAVING count(*) >= 0.002 * n.n AND count(*) <= greatest(0.2 * n.n, 1)),
sets AS (SELECT term, j FROM lex, range(8) AS r(j) WHERE CAST('0x' || substr(md5(term), CAST(2 * j + 1 AS INT), 2) AS INT) < 179),
h AS (SELECT doc_id, kind, j, md5(string_agg(term, ' ' ORDER BY term)) AS hash FROM w JOIN sets USING (term) GROUP BY ALL),
f AS (SELECT v.doc_id, v.kind, r.j, coalesce(h.hash, md5('text:' || v.text)) AS hash FROM v CROSS JOIN range(8) AS r(j) LEFT JOIN h ON h.doc_id = v.doc_id AND h.kind = v.kind AND h.j = r.j),
p AS (SELECT a.doc_id, string_agg(a.hash, '-' ORDER BY a.j) AS fingerprint, string_agg(b.hash, '-' ORDER BY a.j) AS edited_fingerprint,
  sum(CAST(a.hash = b.hash AS DOUBLE)) / 8 AS near_edited, sum(CAST(a.hash = c.hash AS DOUBLE)) / 8 AS near_next
  FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.j = b.j AND b.kind = 1 JOIN f c ON a.doc_id = c.doc_id AND a.j = c.j AND c.kind = 2 WHERE a.kind = 0 GROUP BY a.doc_id)
SELECT e.doc_id, CAST(length(e.text) AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256, p.fingerprint, p.edited_fingerprint, p.near_edited, p.near_next FROM e JOIN p USING (doc_id)
"""

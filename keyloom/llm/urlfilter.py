"""URL filters with redirect equivalence.

A rule (verdict, host, path) fits its host and all subdomains where the url's path starts with its path; of those
that fit, the longest wins and decides. Other pages ask their aliases, which are the components of a graph of urls.
Its edges are canonical links and refresh redirects of pages, seen from their urls, given redirects, and the redirect
of a url to its normal form (no scheme, www. or m., fragment, tracking parameters, last slash or .html). Edges of the
last kind are stars around a normal form, the address; they are contracted to it, so that only edges between addresses
go through the rounds of components(). A component with a page that a rule allows is allowed; else one with a page
that a rule blocks is blocked; else it is allowed. So a page's own rule comes before its aliases', and an explicit
allow before a block.

Edge cases: of equally long rules an allow wins, then the lesser path; repeated rules count once. Rules' hosts are
lower-cased (A-Z); a rule without a host fits nothing. A null url, or one without `://`, has no host, fits no rule,
has no alias and is allowed. A null page text links nothing. Repeated rows get the same verdict. Other columns pass
through. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, released, stage_table
from .components import components

#: Up to so many rules are tested one by one in an expression; more are joined by host.
INLINE = 64
#: Up to so many rows of addresses and their verdicts (some 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"
_CANONICAL = r"""(?i)<link\b[^>]*\brel=["']?canonical["']?[^>]*>"""
_HREF = r"""(?i)\bhref=["']?([^"'\s>]+)"""
_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv=["']?refresh\b[^>]*>"""
_TO = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What urls have in common that redirect to one another; null without a host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"\.html?$", ""), r"/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), _TRACKING, ""), "^&", "")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def _linked(html: Column) -> Column:
    """What all canonical links and refreshes of a page name."""

    def named(tag: str, value: str) -> Column:
        return F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, value, 1))

    return F.filter(F.array_distinct(F.concat(named(_CANONICAL, _HREF), named(_REFRESH, _TO))), lambda x: x != "")


def resolved(target: Column, host: Column, path: Column) -> Column:
    """A link's url, as seen from a page; null where it leads to no address."""
    to = F.regexp_extract(target, "^[^?#]*", 0)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^.*/", 0), F.lit("")), F.lit("/"))
    whole = F.when(to.startswith("/"), to).when(to == "", path).otherwise(F.concat(folder, to))

    def step(acc: Column, x: Column) -> Column:
        return F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))

    parts = F.aggregate(F.split(F.regexp_replace(whole, "^/", ""), "/"), F.array().cast("array<string>"), step)
    own = F.concat(F.lit("https://"), host, F.lit("/"), F.array_join(parts, "/"), F.regexp_extract(target, r"\?[^#]*", 0))
    return F.when(target.rlike(f"{_SCHEME}//"), target).when(target.startswith("//"), F.concat(F.lit("https:"), target)).when(~target.rlike(_SCHEME) & ~target.startswith("#"), own)


def _by_rules(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rows (host, path) with rule and ruled (its verdict), null where none fits: the longest, then allow before
    block, then by path. Both ways keep this order."""
    clean = {(verdict, host.translate(str.maketrans(_UPPER, _LOWER)), path) for verdict, host, path in rules if host}
    best = sorted(clean, key=lambda r: (-len(r[1] + r[2]), r[0], r[2]))
    host, path = F.col("host"), F.col("path")
    if len(best) <= INLINE:
        hits = [(((host == h) | host.endswith(f".{h}")) & path.startswith(p), h + p, verdict) for verdict, h, p in best]
        found = F.coalesce(F.lit(None).cast("struct<rule:string,ruled:string>"), *[F.when(c, F.struct(F.lit(r).alias("rule"), F.lit(v).alias("ruled"))) for c, r, v in hits])
        return rows.withColumn("hit", found).select("*", "hit.rule", "hit.ruled").drop("hit")
    table = rows.sparkSession.createDataFrame([(h, -len(h + p), v, p, h + p) for v, h, p in best], "at string, n int, ruled string, path string, rule string")
    hosts = rows.select("host").distinct()
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = hosts.select("host", F.explode(ends).alias("at")).join(table, "at")
    per_host = own.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("n", "ruled", "path", "rule"))).alias("rules"))
    joined = rows.join(per_host.toDF("h", "rules"), F.col("host") == F.col("h"), "left")
    hit = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["path"])), 0)
    return joined.withColumn("hit", hit).select(*rows.columns, "hit.rule", "hit.ruled")


def _small(df: DataFrame) -> DataFrame:
    """df for all tasks if its rows are few, else as it is: then a hot component's join is split by adaptive execution."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], links: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule and verdict. links: further redirects as urls (a, b)."""
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    rows = carried(pages, host=host_of(url), path=path_of(url), address=address(url), targets=_linked(html), url=url)
    rows = _by_rules(rows, rules)
    linked = rows.filter("address IS NOT NULL").select("address", "host", "path", F.explode("targets").alias("target"))
    edges = linked.select(F.col("address").alias("a"), address(resolved(F.col("target"), F.col("host"), F.col("path"))).alias("b")).filter("b IS NOT NULL AND a <> b")
    if links is not None:
        edges = edges.union(links.select(address(F.col("a")).alias("a"), address(F.col("b")).alias("b")))
    edges = stage_table(edges.distinct(), "links")
    known = rows.select("address", "ruled").filter("address IS NOT NULL AND ruled IS NOT NULL").distinct()
    place = F.col("address")
    if edges.limit(1).count():
        labels = _small(components(edges)).toDF("node", "component")
        rows = rows.join(labels, F.col("address") == F.col("node"), "left").drop("node")
        known = known.join(labels, F.col("address") == F.col("node"), "left")
        place = F.coalesce("component", "address")
    # "allow" sorts before "block": the least verdict of a component is the one that counts.
    decided = stage_table(known.groupBy(place.alias("at")).agg(F.min("ruled").alias("aliased")), "decided")
    rows = rows.join(_small(decided), place == F.col("at"), "left")
    verdict = F.coalesce("ruled", "aliased", F.lit("allow"))
    return released(rows, pages.columns, host=F.col("host"), path=F.col("path"), rule=F.col("rule"), verdict=verdict)

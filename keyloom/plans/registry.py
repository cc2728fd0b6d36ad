"""Queries by name, each with the statement it is held against where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import arrays, bitmaps, control, geo, hashes, jsondocs, keyspace, lists, modules, scripting, sets, sketches, state, streams, strings, timeseries, vectors, zsets
from ..sources import io
from ..sources.catalog import Catalog
from ..streaming import changelog
from . import requests
from .relations import statement

NOW = 500_000
_QUERIES: dict[str, Callable[[Catalog], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, build: Callable[[Catalog], DataFrame], relations: str = "", sql: str | None = None) -> None:
    _QUERIES[name] = build
    if sql is not None:
        _SQL[name] = statement(relations, sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, build=build: build(Catalog(spark, sf_dir))) for name, build in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def values(c: Catalog, schema: str, *rows: tuple) -> DataFrame:
    return c.spark.createDataFrame([tuple(r) for r in rows], schema)


C = F.col

# Keyspace
_KEYS = lambda c: keyspace.keyspace(string=c.kv(NOW), hash=c.h, set=c.s, zset=c.z)
_KEYS_SQL = ", ks AS (SELECT DISTINCT key, 'string' AS type FROM kv UNION ALL SELECT DISTINCT key, 'hash' FROM h UNION ALL SELECT DISTINCT key, 'set' FROM s UNION ALL SELECT DISTINCT key, 'zset' FROM z) "
_PROBES = [(1, "cust:1"), (2, "cust:7"), (3, "cust:700"), (4, "nobody"), (5, "cust:1"), (6, "cust:22"), (7, "cust:9")]
_PROBES_SQL = ", probes(ord, key) AS (VALUES " + ", ".join(f"({o}, '{k}')" for o, k in _PROBES) + ") "
_probes = lambda c: values(c, "ord int, key string", *_PROBES)

query("scan", lambda c: keyspace.scan(_KEYS(c), "cust:1*5", "string", "cust:1", 50), "kv h s z", _KEYS_SQL + "SELECT key, type FROM ks WHERE type = 'string' AND key > 'cust:1' AND key LIKE 'cust:1%5' AND length(key) >= 7 ORDER BY key LIMIT 50")
query("keys_glob", lambda c: keyspace.scan(_KEYS(c), "cust:12*"), "kv h s z", _KEYS_SQL + "SELECT key, type FROM ks WHERE starts_with(key, 'cust:12')")
query("entry_snapshot", lambda c: keyspace.entries(c.kv(NOW), "cust:3").select("key", "value", "expire_at_ms"), "kv", "SELECT key, value, expire_at_ms FROM kv WHERE key >= 'cust:3'")
query("visit_keys", lambda c: keyspace.entries(c.kv(NOW).select("key"), count=40), "kv", "SELECT key FROM kv ORDER BY key LIMIT 40")
query("dbsize", lambda c: keyspace.dbsize(_KEYS(c)), "kv h s z", _KEYS_SQL + "SELECT count(*) AS size FROM ks")
query("type", lambda c: keyspace.types(keyspace.keyspace(string=c.kv(NOW)), _probes(c)), "kv", _PROBES_SQL + "SELECT ord, key, CASE WHEN key IN (SELECT key FROM kv) THEN 'string' ELSE 'none' END AS type FROM probes")
query("exists", lambda c: keyspace.exists(c.kv(NOW), _probes(c)), "kv", _PROBES_SQL + "SELECT count(*) AS n FROM probes WHERE key IN (SELECT key FROM kv)")
query("del_count", lambda c: keyspace.removed(c.kv(NOW), _probes(c)), "kv", _PROBES_SQL + "SELECT count(*) AS n FROM kv WHERE key IN (SELECT key FROM probes)")
query("del", lambda c: state.delete(c.kv(NOW), _probes(c), ["key"]).select("key"), "kv", _PROBES_SQL + "SELECT key FROM kv WHERE key NOT IN (SELECT key FROM probes)")
query("ttl", lambda c: keyspace.ttls(c.kv(NOW), _probes(c), NOW), "kv", _PROBES_SQL + """SELECT p.ord, p.key, CAST(CASE WHEN kv.key IS NULL THEN -2 WHEN expire_at_ms IS NULL THEN -1 ELSE ceil((expire_at_ms - 500000) / 1000) END AS BIGINT) AS ttl,
 CAST(CASE WHEN kv.key IS NULL THEN -2 WHEN expire_at_ms IS NULL THEN -1 ELSE expire_at_ms - 500000 END AS BIGINT) AS pttl,
 CAST(CASE WHEN kv.key IS NULL THEN -2 WHEN expire_at_ms IS NULL THEN -1 ELSE expire_at_ms // 1000 END AS BIGINT) AS expiretime,
 CAST(CASE WHEN kv.key IS NULL THEN -2 WHEN expire_at_ms IS NULL THEN -1 ELSE expire_at_ms END AS BIGINT) AS pexpiretime FROM probes p LEFT JOIN kv ON kv.key = p.key""")
for _flag, _cond in ((None, "TRUE"), ("NX", "expire_at_ms IS NULL"), ("XX", "expire_at_ms IS NOT NULL"), ("GT", "coalesce(900000 > expire_at_ms, FALSE)"), ("LT", "coalesce(900000 < expire_at_ms, TRUE)")):
    query(
        f"expireat{'_' + _flag.lower() if _flag else ''}", lambda c, f=_flag: keyspace.expire(c.kv(NOW), c.kv(NOW).filter("value LIKE '%5'").select("key"), F.lit(900_000).cast("bigint"), NOW, f).select("key", "expire_at_ms"),
        "kv", f"SELECT key, CASE WHEN value LIKE '%5' AND {_cond} THEN 900000 ELSE expire_at_ms END AS expire_at_ms FROM kv",
    )
query("expire_past", lambda c: keyspace.expire(c.kv(NOW), _probes(c).select("key").distinct(), F.lit(1).cast("bigint"), NOW).select("key"), "kv", _PROBES_SQL + "SELECT key FROM kv WHERE key NOT IN (SELECT key FROM probes)")
query("persist", lambda c: keyspace.persist(c.kv(NOW), c.kv(NOW).filter("value LIKE '%4'").select("key")).select("key", "expire_at_ms"), "kv", "SELECT key, CASE WHEN value LIKE '%4' THEN NULL ELSE expire_at_ms END AS expire_at_ms FROM kv")
query("copy", lambda c: keyspace.copy(c.kv(NOW), "cust:1", "cust:2", True).select("key", "value"), "kv", "SELECT key, CASE WHEN key = 'cust:2' THEN (SELECT value FROM kv WHERE key = 'cust:1') ELSE value END AS value FROM kv")
query("rename", lambda c: keyspace.rename(c.kv(NOW), "cust:1", "moved").select("key", "value"), "kv", "SELECT CASE WHEN key = 'cust:1' THEN 'moved' ELSE key END AS key, value FROM kv")
query("renamenx", lambda c: keyspace.rename(c.kv(NOW), "cust:1", "cust:2", True).select("key", "value"), "kv", "SELECT key, value FROM kv")
query("sort_limit", lambda c: keyspace.sort(c.s, desc=True, offset=2, count=5).select("key", "member", C("rn").cast("bigint").alias("rn")), "s", "SELECT key, member, rn FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CAST(member AS DOUBLE) DESC, member DESC) - 1 AS rn FROM s) WHERE rn BETWEEN 2 AND 6")
query("sort_alpha", lambda c: keyspace.sort(c.s, alpha=True, count=7).select("key", "member"), "s", "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS rn FROM s) WHERE rn <= 7")
query("dump_restore", lambda c: keyspace.restore(keyspace.dump(c.kv(NOW))), "kv", "SELECT key, value, expire_at_ms FROM kv")
query("randomkey", lambda c: keyspace.randomkey(c.kv(NOW)).select("key"))

# Strings
query("mget", lambda c: strings.mget(c.kv(NOW), _probes(c)), "kv", _PROBES_SQL + "SELECT p.ord, p.key, kv.value FROM probes p LEFT JOIN kv ON kv.key = p.key")
query("batch_get_governed", lambda c: strings.mget(c.kv(NOW, ["g1"]), _probes(c)), "kv_all", _PROBES_SQL + "SELECT p.ord, p.key, k.value FROM probes p LEFT JOIN (SELECT * FROM kv_all WHERE (expire_at_ms IS NULL OR expire_at_ms > 500000) AND (governance IS NULL OR governance = 'g1')) k ON k.key = p.key")
query("strlen", lambda c: c.table("documents").select("doc_id", F.octet_length("text").cast("bigint").alias("n")), "", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n FROM documents")
query("getrange", lambda c: c.kv(NOW).select("key", strings.getrange(C("value"), 2, -3).alias("piece")), "kv", "SELECT key, substr(value, 3, length(value) - 4) AS piece FROM kv")
query("getrange_before", lambda c: c.kv(NOW).select("key", strings.getrange(C("value"), 0, -99).alias("piece")), "kv", "SELECT key, substr(value, 1, 1) AS piece FROM kv")
query("setrange_kv", lambda c: strings.set_range(c.kv(NOW), 3, "XY").select("key", "value", "expire_at_ms"), "kv", "SELECT key, substr(value, 1, 3) || 'XY' || substr(value, 6) AS value, CAST(NULL AS BIGINT) AS expire_at_ms FROM kv")
query("setrange", lambda c: c.kv(NOW).select("key", strings.setrange(C("value"), 3, "XY").alias("value")), "kv", "SELECT key, substr(value, 1, 3) || 'XY' || substr(value, 6) AS value FROM kv")
query("append", lambda c: strings.appended(c.items.select("key", "seq", C("item").alias("piece"))).select("key", "bytes", F.md5("value").alias("digest")), "items", "SELECT key, CAST(strlen(v) AS INT) AS bytes, md5(v) AS digest FROM (SELECT key, string_agg(item, '' ORDER BY seq) AS v FROM items GROUP BY key)")
query("incr_running", lambda c: strings.running(c.counters), "counters", "SELECT key, seq, CAST(sum(delta) OVER (PARTITION BY key ORDER BY seq) AS BIGINT) AS value FROM counters")
query("incrby", lambda c: strings.totals(c.counters), "counters", "SELECT key, CAST(sum(delta) AS BIGINT) AS value FROM counters GROUP BY key")
query("decrby", lambda c: strings.totals(c.counters.select("key", "seq", (-C("delta")).alias("delta"))), "counters", "SELECT key, CAST(-sum(delta) AS BIGINT) AS value FROM counters GROUP BY key")
query("incrbyfloat", lambda c: c.events.groupBy(C("user_id").cast("string").alias("key")).agg(F.round(F.sum("value"), 6).alias("value")), "ev", "SELECT CAST(user_id AS VARCHAR) AS key, round(sum(value), 6) AS value FROM ev GROUP BY 1")
query(
    "increx", lambda c: strings.bounded(c.counters.select("key", "seq", F.when(C("seq") % 2 == 0, -C("delta")).otherwise(C("delta")).alias("delta")), -50, 200), "counters",
    """, o AS (SELECT key, CASE WHEN seq % 2 = 0 THEN -delta ELSE delta END AS d, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM counters),
 f AS (SELECT key, rn, greatest(least(d, 200), -50) AS v FROM o WHERE rn = 1 UNION ALL SELECT f.key, o.rn, greatest(least(f.v + o.d, 200), -50) FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
 SELECT key, CAST(max_by(v, rn) AS BIGINT) AS value FROM f GROUP BY key""",
)
query(
    "increx_calls", lambda c: strings.increx(c.counters.select("key", "seq", F.when(C("seq") % 2 == 0, -C("delta")).otherwise(C("delta")).alias("delta")), -50, 200, saturate=False), "counters",
    """, o AS (SELECT key, seq, CASE WHEN seq % 2 = 0 THEN -delta ELSE delta END AS d, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM counters),
 f AS (SELECT key, seq, rn, CASE WHEN d BETWEEN -50 AND 200 THEN d ELSE 0 END AS value, CASE WHEN d BETWEEN -50 AND 200 THEN d ELSE 0 END AS applied FROM o WHERE rn = 1
 UNION ALL SELECT f.key, o.seq, o.rn, CASE WHEN f.value + o.d BETWEEN -50 AND 200 THEN f.value + o.d ELSE f.value END, CASE WHEN f.value + o.d BETWEEN -50 AND 200 THEN o.d ELSE 0 END FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
 SELECT key, seq, CAST(value AS BIGINT) AS value, CAST(applied AS BIGINT) AS applied FROM f""",
)
query("incrbyfloat_kv", lambda c: strings.incr_by_float(c.h.filter("field IN ('cents', 'name')").select(F.concat_ws("/", "key", "field").alias("key"), "value", F.lit(9).cast("bigint").alias("expire_at_ms")), c.h.filter("field IN ('cents', 'name')").select(F.concat_ws("/", "key", "field").alias("key"), F.lit(0.5).alias("delta"))), "h", """SELECT key || '/' || field AS key, CASE WHEN field = 'name' THEN value ELSE CAST(CAST(value AS BIGINT) + 0.5 AS VARCHAR) END AS value, CASE WHEN field = 'name' THEN CAST(9 AS BIGINT) END AS expire_at_ms FROM h WHERE field IN ('cents', 'name')""")
query("getset_lag", lambda c: strings.getset(c.counters.select("key", "seq", C("delta").alias("value"))), "counters", "SELECT key, seq, delta AS value, lag(delta) OVER (PARTITION BY key ORDER BY seq) AS old FROM counters")
_NEW = [("cust:1", "one"), ("fresh", "two"), ("cust:4", "three")]
_NEW_SQL = ", new(key, value) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _NEW) + ") "
_new = lambda c: values(c, "key string, value string", *_NEW)
query("set", lambda c: strings.set_if(c.kv(NOW), _new(c)).select("key", "value", "expire_at_ms"), "kv", _NEW_SQL + "SELECT key, value, expire_at_ms FROM kv WHERE key NOT IN (SELECT key FROM new) UNION ALL SELECT key, value, NULL FROM new")
query("set_xx", lambda c: strings.set_if(c.kv(NOW), _new(c), "XX").select("key", "value"), "kv", _NEW_SQL + "SELECT kv.key, coalesce(new.value, kv.value) AS value FROM kv LEFT JOIN new ON new.key = kv.key")
query("setnx", lambda c: strings.setnx(c.kv(NOW), _new(c)).select("key", "value"), "kv", _NEW_SQL + "SELECT key, value FROM kv UNION ALL SELECT key, value FROM new WHERE key NOT IN (SELECT key FROM kv)")
query("msetnx", lambda c: strings.msetnx(c.kv(NOW).select("key", "value"), _new(c)), "kv", "SELECT key, value FROM kv")
_LAST = ", o AS (SELECT key, arg_max(value, seq) AS last, arg_min(value, seq) AS first, max(seq) AS top FROM writes GROUP BY key) "
query("set_repeated", lambda c: strings.set_if(c.kv(NOW), c.writes).select("key", "value", "expire_at_ms"), "kv writes", _LAST + "SELECT key, value, expire_at_ms FROM kv WHERE key NOT IN (SELECT key FROM o) UNION ALL SELECT key, last, NULL FROM o")
query("set_xx_repeated", lambda c: strings.set_if(c.kv(NOW), c.writes, "XX").select("key", "value"), "kv writes", _LAST + "SELECT kv.key, coalesce(o.last, kv.value) AS value FROM kv LEFT JOIN o ON o.key = kv.key")
query("setnx_repeated", lambda c: strings.setnx(c.kv(NOW), c.writes).select("key", "value"), "kv writes", _LAST + "SELECT key, value FROM kv UNION ALL SELECT key, first FROM o WHERE key NOT IN (SELECT key FROM kv)")
query("set_ifeq", lambda c: strings.set_if(c.kv(NOW), c.writes.join(c.kv(NOW).select("key", C("value").alias("old")), "key", "left").select("key", "value", "seq", F.when(C("seq") % 2 == 0, C("old")).otherwise("none").alias("expect")), "IFEQ").select("key", "value"), "kv writes", ", m AS (SELECT writes.key, arg_min(writes.value, seq) AS value FROM writes JOIN kv ON kv.key = writes.key WHERE seq % 2 = 0 GROUP BY writes.key) SELECT kv.key, coalesce(m.value, kv.value) AS value FROM kv LEFT JOIN m ON m.key = kv.key")
query("lcs_idx", lambda c: strings.lcs_idx(c.table("part").select(C("p_partkey").alias("id"), C("p_name").alias("a"), C("p_type").alias("b")), 2))
query("digest", lambda c: c.kv(NOW).select("key", strings.digest(C("value")).alias("digest")))
query("lcs", lambda c: strings.lcs(c.table("part").select(C("p_partkey").alias("id"), C("p_name").alias("a"), C("p_type").alias("b"))))

# Bits
query("getbit", lambda c: c.kv(NOW).select("key", bitmaps.getbit(C("value"), 10).alias("bit")), "kv", "SELECT key, CAST((ascii(substr(value, 2, 1)) >> 5) & 1 AS INT) AS bit FROM kv")
query("bitcount", lambda c: c.kv(NOW).select("key", bitmaps.bitcount(C("value")).cast("bigint").alias("n")), "kv", "SELECT key, CAST(bit_count(CAST(encode(value) AS BIT)) AS BIGINT) AS n FROM kv")
query("bitpos", lambda c: c.kv(NOW).select("key", bitmaps.bitpos(C("value"), 1).alias("at")), "kv", "SELECT key, CAST(bit_position('1'::BIT, CAST(encode(value) AS BIT)) - 1 AS BIGINT) AS at FROM kv")
query("bitop_xor", lambda c: c.kv(NOW).select("key", bitmaps.bitop("XOR", C("value"), C("key")).alias("hex")), "kv", "SELECT key, array_to_string(list_transform(range(1, greatest(length(key), length(value)) + 1), lambda i: printf('%02X', xor(CASE WHEN i <= length(value) THEN ascii(value[i]) ELSE 0 END, CASE WHEN i <= length(key) THEN ascii(key[i]) ELSE 0 END))), '') AS hex FROM kv")
query("bitfield_get", lambda c: c.kv(NOW).select("key", bitmaps.bitfield_get(C("value"), 0, 8).alias("u8")), "kv", "SELECT key, CAST(ascii(value) AS BIGINT) AS u8 FROM kv")
query(
    "bitfield_incr", lambda c: c.kv(NOW).select("key", *[bitmaps.bitfield_incr(C("value"), 0, 8, 200, o).alias(o.lower()) for o in ("WRAP", "SAT", "FAIL")]),
    "kv", "SELECT key, CAST((ascii(value) + 200) % 256 AS BIGINT) AS wrap, CAST(least(ascii(value) + 200, 255) AS BIGINT) AS sat, CAST(CASE WHEN ascii(value) + 200 <= 255 THEN ascii(value) + 200 END AS BIGINT) AS fail FROM kv",
)
query("bitfield_set", lambda c: c.kv(NOW).select("key", bitmaps.bitfield_set(C("value"), 8, 8, F.lit(65)).cast("string").alias("value")), "kv", "SELECT key, substr(value, 1, 1) || 'A' || substr(value, 3) AS value FROM kv")
for _op, _sql in (("AND", "SELECT bit FROM bits WHERE key = 'click' INTERSECT SELECT bit FROM bits WHERE key = 'view'"), ("OR", "SELECT bit FROM bits WHERE key IN ('click', 'view')  GROUP BY bit"), ("XOR", "SELECT bit FROM bits WHERE key IN ('click', 'view') GROUP BY bit HAVING count(*) = 1"), ("DIFF", "SELECT bit FROM bits WHERE key = 'click' EXCEPT SELECT bit FROM bits WHERE key = 'view'")):
    query(f"r_bitop_{_op.lower()}", lambda c, op=_op: bitmaps.combine(c.bits, op, ["click", "view"]), "bits", _sql)
query("r_bitcount", lambda c: bitmaps.cardinality(c.bits), "bits", "SELECT key, count(*) AS n FROM bits GROUP BY key")
query("r_getbitarray", lambda c: bitmaps.bit_array(c.bits), "bits", "SELECT k.key, string_agg(CASE WHEN b.bit IS NULL THEN '0' ELSE '1' END, '' ORDER BY g) AS text FROM (SELECT key, max(bit) AS top FROM bits GROUP BY key) k CROSS JOIN range(0, (SELECT max(bit) + 1 FROM bits)) AS t(g) LEFT JOIN bits b ON b.key = k.key AND b.bit = g WHERE g <= k.top GROUP BY k.key")
query("r_getintarray", lambda c: c.bits.filter("key = 'click'").select("bit"), "bits", "SELECT bit FROM bits WHERE key = 'click'")
query("r_getbits", lambda c: bitmaps.get_bits(c.bits, c.table("customer").select(F.lit("view").alias("key"), C("c_custkey").cast("bigint").alias("bit"))), "bits", "SELECT 'view' AS key, CAST(c_custkey AS BIGINT) AS bit, CASE WHEN bits.key IS NULL THEN 0 ELSE 1 END AS is_set FROM customer LEFT JOIN bits ON bits.key = 'view' AND bits.bit = c_custkey")
query("r_setintarray", lambda c: bitmaps.set_bits(c.bits, "view", c.table("customer").select(C("c_nationkey").cast("bigint").alias("bit"))), "bits", "SELECT key, bit FROM bits WHERE key <> 'view' UNION ALL SELECT DISTINCT 'view', CAST(c_nationkey AS BIGINT) FROM customer")
query("r_min_max", lambda c: bitmaps.edges(c.bits), "bits", "SELECT key, min(bit) AS least, max(bit) AS most FROM bits GROUP BY key")
query("r_rangeintarray", lambda c: bitmaps.members_between(c.bits, 10, 40), "bits", "SELECT key, bit FROM bits WHERE bit BETWEEN 10 AND 40")
query("r_bitpos_gap", lambda c: bitmaps.first_gap(c.bits), "bits", "SELECT k.key, (SELECT min(g) FROM (SELECT 0 AS g UNION ALL SELECT bit + 1 FROM bits b WHERE b.key = k.key) WHERE g NOT IN (SELECT bit FROM bits b WHERE b.key = k.key)) AS gap FROM (SELECT DISTINCT key FROM bits) k")
query("r_jaccard", lambda c: bitmaps.jaccard(c.bits, "signup", "error"), "bits", "SELECT CAST(count(*) FILTER (n = 2) AS DOUBLE) / count(*) AS jaccard FROM (SELECT bit, count(*) AS n FROM bits WHERE key IN ('signup', 'error') GROUP BY bit)")
query("r_setrange", lambda c: bitmaps.set_range(c.spark, "r", 5, 60), "", "SELECT 'r' AS key, g AS bit FROM range(5, 61) AS t(g)")
query("r_appendintarray", lambda c: c.bits.unionByName(bitmaps.set_range(c.spark, "click", 100, 200)).distinct(), "bits", "SELECT key, bit FROM bits UNION SELECT 'click', g FROM range(100, 201) AS t(g)")

# Hashes
query("hgetall", lambda c: hashes.hgetall(c.h).select("key", F.to_json("pairs").alias("pairs")), "h", """SELECT key, '{' || string_agg('"' || field || '":"' || value || '"', ',' ORDER BY field) || '}' AS pairs FROM h GROUP BY key""")
_HP = [("cust:1", "name"), ("cust:1", "none"), ("cust:5", "segment"), ("x", "name"), ("cust:15", "segment"), ("cust:900", "segment")]
_HP_SQL = ", hp(key, field) AS (VALUES " + ", ".join(f"('{k}', '{f}')" for k, f in _HP) + ") "
_hp = lambda c: values(c, "key string, field string", *_HP)
query("hmget", lambda c: hashes.hmget(c.h, _hp(c)), "h", _HP_SQL + "SELECT hp.key, hp.field, h.value FROM hp LEFT JOIN h ON h.key = hp.key AND h.field = hp.field")
query("hlen", lambda c: hashes.hlen(hashes.alive(c.h, NOW)), "h", "SELECT key, count(*) AS n FROM h WHERE field_expire_at_ms IS NULL OR field_expire_at_ms > 500000 GROUP BY key")
query("hkeys", lambda c: c.h.select("key", "field"), "h", "SELECT key, field FROM h")
query("hstrlen", lambda c: hashes.hstrlen(c.h, "name"), "h", "SELECT key, CAST(strlen(value) AS INT) AS n FROM h WHERE field = 'name'")
query("hincrby", lambda c: hashes.hincrby(c.h, c.h.filter("field = 'cents'").select("key", "field", F.lit(25).cast("bigint").alias("delta"))), "h", "SELECT key, field, CAST(value AS BIGINT) + 25 AS value FROM h WHERE field = 'cents'")
query("hset", lambda c: hashes.hset(c.h, _hp(c).withColumn("value", F.lit("v"))).select("key", "field", "value"), "h", _HP_SQL + "SELECT h.key, h.field, h.value FROM h LEFT JOIN hp ON h.key = hp.key AND h.field = hp.field WHERE hp.key IS NULL UNION ALL SELECT key, field, 'v' FROM hp")
query("hset_created", lambda c: hashes.hset_created(c.h, _hp(c)), "h", _HP_SQL + "SELECT hp.key, count(*) FILTER (h.key IS NULL) AS created FROM hp LEFT JOIN h ON h.key = hp.key AND h.field = hp.field GROUP BY hp.key")
query("hsetnx", lambda c: hashes.hsetnx(c.h, _hp(c).withColumn("value", F.lit("v"))).select("key", "field", "value"), "h", _HP_SQL + "SELECT key, field, value FROM h UNION ALL SELECT hp.key, hp.field, 'v' FROM hp LEFT JOIN h ON h.key = hp.key AND h.field = hp.field WHERE h.key IS NULL")
query("hdel", lambda c: hashes.hdel(c.h, _hp(c)).select("key", "field"), "h", _HP_SQL + "SELECT h.key, h.field FROM h LEFT JOIN hp ON h.key = hp.key AND h.field = hp.field WHERE hp.key IS NULL")
for _flag, _cond in ((None, "TRUE"), ("NX", "field_expire_at_ms IS NULL"), ("GT", "coalesce(600000 > field_expire_at_ms, FALSE)")):
    query(f"hexpireat{'_' + _flag.lower() if _flag else ''}", lambda c, f=_flag: hashes.hexpire(c.h, _hp(c), F.lit(600_000).cast("bigint"), NOW, f), "h", _HP_SQL + f"SELECT hp.key, hp.field, CASE WHEN h.key IS NULL THEN -2 WHEN NOT {_cond} THEN 0 ELSE 1 END AS code FROM hp LEFT JOIN h ON h.key = hp.key AND h.field = hp.field")
query("httl", lambda c: hashes.httl(c.h, _hp(c), 1000), "h", _HP_SQL + """SELECT hp.key, hp.field, CAST(CASE WHEN h.key IS NULL THEN -2 WHEN field_expire_at_ms IS NULL THEN -1 ELSE ceil((field_expire_at_ms - 1000) / 1000) END AS BIGINT) AS httl,
 CAST(CASE WHEN h.key IS NULL THEN -2 WHEN field_expire_at_ms IS NULL THEN -1 ELSE field_expire_at_ms - 1000 END AS BIGINT) AS hpttl FROM hp LEFT JOIN h ON h.key = hp.key AND h.field = hp.field""")
query("hrandfield", lambda c: hashes.hrandfield(c.h, 2), "h", "SELECT key, field, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY field) AS m FROM h) WHERE m <= 2")
_HW = lambda c: c.writes.select("key", F.when(C("seq") % 2 == 0, "name").otherwise("new").alias("field"), "value", "seq")
_HW_SQL = ", hw AS (SELECT key, CASE WHEN seq % 2 = 0 THEN 'name' ELSE 'new' END AS field, arg_max(value, seq) AS value FROM writes GROUP BY 1, 2) "
query("hset_repeated", lambda c: hashes.hset(c.h, _HW(c)).select("key", "field", "value"), "h writes", _HW_SQL + "SELECT h.key, h.field, h.value FROM h LEFT JOIN hw ON h.key = hw.key AND h.field = hw.field WHERE hw.key IS NULL UNION ALL SELECT key, field, value FROM hw")
query("hset_created_repeated", lambda c: hashes.hset_created(c.h, _HW(c)), "h writes", _HW_SQL + "SELECT hw.key, count(*) FILTER (h.key IS NULL) AS created FROM hw LEFT JOIN h ON h.key = hw.key AND h.field = hw.field GROUP BY hw.key")

# Lists
query("lrange", lambda c: lists.lrange(c.l, 0, 1), "lr", "SELECT key, i, value FROM lr WHERE i BETWEEN 0 AND 1")
query("lrange_tail", lambda c: lists.lrange(c.l, -2, -1), "lr", "SELECT key, i, value FROM lr WHERE i >= n - 2")
query("ltrim", lambda c: lists.lrange(c.l, 1, -2), "lr", "SELECT key, i, value FROM lr WHERE i >= 1 AND i <= n - 2")
query("lindex", lambda c: lists.lindex(c.l, -1), "lr", "SELECT key, value FROM lr WHERE i = n - 1")
query("llen", lambda c: lists.llen(c.l), "l", "SELECT key, count(*) AS n FROM l GROUP BY key")
query("lpos", lambda c: lists.lpos(c.l, "3"), "lr", "SELECT key, min(i) AS i FROM lr WHERE value = '3' GROUP BY key")
query("lpos_all_rev", lambda c: lists.lpos(c.l, "3", -1, 0), "lr", "SELECT key, i FROM lr WHERE value = '3'")
query("lrem", lambda c: lists.lrem(c.l, -1, "3").select("key", "pos"), "l", "SELECT key, pos FROM (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY pos DESC) AS m FROM l) WHERE value <> '3' OR m > 1")
query("linsert", lambda c: lists.linsert(c.l, "3", "new"), "lr", """, p AS (SELECT key, min(i) AS place FROM lr WHERE value = '3' GROUP BY key), u AS (SELECT key, CAST(i AS DOUBLE) AS i, value FROM lr UNION ALL SELECT key, place - 0.5, 'new' FROM p)
 SELECT key, row_number() OVER (PARTITION BY key ORDER BY i) - 1 AS i, value FROM u""")
query("lset", lambda c: lists.lset(c.l, -1, "last"), "lr", "SELECT key, i, CASE WHEN i = n - 1 THEN 'last' ELSE value END AS value FROM lr")
query("lset_replies", lambda c: lists.lset_replies(c.l, 3), "l", "SELECT key, CASE WHEN count(*) > 3 THEN 'OK' ELSE 'ERR index out of range' END AS reply FROM l GROUP BY key")
query("rpush", lambda c: lists.push(c.l, ["a", "b"]), "l", "SELECT key, pos, value FROM l UNION ALL SELECT key, max(pos) + 1, 'a' FROM l GROUP BY key UNION ALL SELECT key, max(pos) + 2, 'b' FROM l GROUP BY key")
query("lpush", lambda c: lists.push(c.l, ["a", "b"], left=True), "l", "SELECT key, pos, value FROM l UNION ALL SELECT key, min(pos) - 1, 'a' FROM l GROUP BY key UNION ALL SELECT key, min(pos) - 2, 'b' FROM l GROUP BY key")
query("lpop", lambda c: lists.pop(c.l, 2)[0], "l", "SELECT key, pos, value FROM l WHERE pos < 2")
query("rpop_rest", lambda c: lists.pop(c.l, 1, left=False)[1], "lr", "SELECT key, pos, value FROM lr WHERE i < n - 1")
query("lmove", lambda c: lists.move(c.l, 1, 2, True, False), "lr", """, k AS (SELECT min(key) AS a FROM l)
 SELECT key, pos, value FROM lr WHERE NOT (key = 1 AND pos = 0) UNION ALL SELECT 2, coalesce((SELECT max(pos) + 1 FROM l WHERE key = 2), 0), value FROM lr WHERE key = 1 AND pos = 0""")
query("lmpop", lambda c: lists.mpop(c.l, [-5, 3, 4], 2), "l", "SELECT key, pos, value FROM l WHERE key = (SELECT CASE WHEN count(*) FILTER (key = 3) > 0 THEN 3 ELSE 4 END FROM l) AND pos < 2")

# Sets
query("scard", lambda c: sets.scard(c.s), "s", "SELECT key, count(*) AS n FROM s GROUP BY key")
query("sunion", lambda c: sets.algebra(c.s, "union", ["click", "view"]), "s", "SELECT DISTINCT member FROM s WHERE key IN ('click', 'view')")
query("sinter", lambda c: sets.algebra(c.s, "inter", ["click", "view", "error"]), "s", "SELECT member FROM s WHERE key IN ('click', 'view', 'error') GROUP BY member HAVING count(*) = 3")
query("sdiff", lambda c: sets.algebra(c.s, "diff", ["view", "signup", "error"]), "s", "SELECT member FROM s WHERE key = 'view' EXCEPT SELECT member FROM s WHERE key IN ('signup', 'error')")
query("sintercard", lambda c: sets.sintercard(c.s, ["click", "view"], 20), "s", "SELECT least(count(*), 20) AS n FROM (SELECT member FROM s WHERE key IN ('click', 'view') GROUP BY member HAVING count(*) = 2)")
query("sunionstore", lambda c: sets.store(c.s, "view", sets.algebra(c.s, "union", ["click", "error"])), "s", "SELECT key, member FROM s WHERE key <> 'view' UNION ALL SELECT DISTINCT 'view', member FROM s WHERE key IN ('click', 'error')")
query("smismember", lambda c: sets.smismember(c.s, values(c, "key string, member string", ("click", "1"), ("click", "-4"), ("none", "1"))), "s", ", p(key, member) AS (VALUES ('click', '1'), ('click', '-4'), ('none', '1')) SELECT p.key, p.member, CASE WHEN s.key IS NULL THEN 0 ELSE 1 END AS found FROM p LEFT JOIN s ON s.key = p.key AND s.member = p.member")
query("sadd_added", lambda c: sets.sadd_added(c.s, values(c, "key string, member string", ("click", "-1"), ("click", "-2"), ("click", "-1"))), "s", "SELECT 'click' AS key, CAST(2 AS BIGINT) AS added")
query("srem", lambda c: sets.srem(c.s, c.s.filter("member LIKE '1%'")), "s", "SELECT key, member FROM s WHERE member NOT LIKE '1%'")
query("smove", lambda c: sets.smove(c.s, "click", "view", "1"), "s", "SELECT key, member FROM s WHERE NOT (key = 'click' AND member = '1') UNION SELECT 'view', member FROM s WHERE key = 'click' AND member = '1'")
query("smembers", lambda c: c.s, "s", "SELECT key, member FROM s")
query("srandmember", lambda c: sets.pick(c.s, -5), "s", "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS rn, count(*) OVER (PARTITION BY key) AS n FROM s) JOIN range(5) AS t(g) ON g % n = rn")

# Sorted sets
query("zset_topk", lambda c: zsets.zrange(c.z, 0, 9, rev=True), "zr", "SELECT key, member, score, rrank AS rank FROM zr WHERE rrank < 10")
query("zrank", lambda c: zsets.zrank(c.z), "zr", "SELECT key, member, score, rank FROM zr")
query("zrevrank", lambda c: zsets.zrank(c.z, True), "zr", "SELECT key, member, score, rrank AS rank FROM zr")
query("zrange_tail", lambda c: zsets.zrange(c.z, -3, -1), "zr", "SELECT key, member, score, rank FROM zr WHERE rank >= n - 3")
query("zrangebyscore", lambda c: zsets.zrangebyscore(c.z, "(0", 1000.5), "z", "SELECT key, member, score FROM z WHERE score > 0 AND score <= 1000.5")
query("zrangebyscore_limit", lambda c: zsets.zrangebyscore(c.z, 0, "+inf", offset=2, count=3), "z", "SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS m FROM z WHERE score >= 0) WHERE m BETWEEN 3 AND 5")
query("zrevrangebyscore_limit", lambda c: zsets.zrangebyscore(c.z, "-inf", 5000, rev=True, count=4), "z", "SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS m FROM z WHERE score <= 5000) WHERE m <= 4")
query("zrangebylex", lambda c: zsets.zrangebylex(c.z, "[c1", "(c2"), "z", "SELECT key, member, score FROM z WHERE member >= 'c1' AND member < 'c2'")
query("zcount", lambda c: zsets.zcount(c.z, "-inf", "(2000"), "z", "SELECT key, count(*) FILTER (score < 2000) AS n FROM z GROUP BY key")
query("zlexcount", lambda c: zsets.zlexcount(c.z, "-", "[c5"), "z", "SELECT key, count(*) FILTER (member <= 'c5') AS n FROM z GROUP BY key")
query("zcard", lambda c: zsets.zcard(c.z), "z", "SELECT key, count(*) AS n FROM z GROUP BY key")
query("zmscore", lambda c: zsets.zmscore(c.z, c.table("customer").filter("c_custkey < 20").select(F.lit("3").alias("key"), F.concat(F.lit("c"), "c_custkey").alias("member"))), "z", "SELECT '3' AS key, 'c' || c_custkey AS member, z.score FROM customer LEFT JOIN z ON z.key = '3' AND z.member = 'c' || c_custkey WHERE c_custkey < 20")
query("zpopmin", lambda c: zsets.zpop(c.z, 3)[0], "zr", "SELECT key, member, score FROM zr WHERE rank < 3")
query("zpopmax_rest", lambda c: zsets.zpop(c.z, 3, True)[1], "zr", "SELECT key, member, score FROM zr WHERE rrank >= 3")
query("zmpop", lambda c: zsets.zmpop(c.z, ["none", "3", "4"], 2), "zr", "SELECT key, member, score FROM zr WHERE key = '3' AND rank < 2")
query("zremrangebyrank", lambda c: zsets.zremrangebyrank(c.z, 2, -3), "zr", "SELECT key, member, score FROM zr WHERE NOT rank BETWEEN 2 AND n - 3")
query("zremrangebyscore", lambda c: zsets.zremrangebyscore(c.z, 0, "(100"), "z", "SELECT key, member, score FROM z WHERE NOT (score >= 0 AND score < 100)")
query("zremrangebylex", lambda c: zsets.zremrangebylex(c.z, "[c1", "+"), "z", "SELECT key, member, score FROM z WHERE member < 'c1'")
_ZD = lambda c: c.z.filter("member LIKE '%5'").select("key", "member", F.lit(500.0).alias("score")).unionByName(values(c, "key string, member string, score double", ("3", "new", 7.0)))
for _n, _kw, _new_sql in (("", {}, "500.0"), ("_nx", {"nx": True}, "score"), ("_gt", {"gt": True}, "greatest(score, 500.0)"), ("_lt", {"lt": True}, "least(score, 500.0)"), ("_gt_incr", {"gt": True, "incr": True}, "CASE WHEN 500.0 > score THEN score + 500.0 ELSE score END")):
    query(f"zadd{_n}", lambda c, kw=_kw: zsets.zadd(c.z, _ZD(c), **kw), "z", f"SELECT key, member, CASE WHEN member LIKE '%5' THEN {_new_sql} ELSE score END AS score FROM z UNION ALL SELECT '3', 'new', 7.0")
query("zadd_xx", lambda c: zsets.zadd(c.z, _ZD(c), xx=True), "z", "SELECT key, member, CASE WHEN member LIKE '%5' THEN 500.0 ELSE score END AS score FROM z")
_ZR = lambda c: c.table("events").select((C("user_id") % 25).cast("string").alias("key"), F.concat(F.lit("c"), C("user_id") % 200).alias("member"), F.round("value").alias("score"), C("event_id").alias("seq"))
_ZR_SQL = ", d AS (SELECT CAST(user_id % 25 AS VARCHAR) AS key, 'c' || (user_id % 200) AS member, round(value) AS score, event_id AS seq FROM events), g AS (SELECT key, member, {agg} AS new FROM d GROUP BY 1, 2) SELECT key, member, {how} AS score FROM z FULL JOIN g USING (key, member)"
for _n, _kw, _a, _h in (("", {}, "arg_max(score, seq)", "coalesce(new, score)"), ("_nx", {"nx": True}, "arg_min(score, seq)", "coalesce(score, new)"), ("_gt", {"gt": True}, "max(score)", "greatest(score, new)"), ("_lt", {"lt": True}, "min(score)", "least(score, new)"), ("_incr", {"incr": True}, "sum(score)", "coalesce(score, 0) + coalesce(new, 0)")):
    query(f"zadd_repeated{_n}", lambda c, kw=_kw: zsets.zadd(c.z, _ZR(c), **kw).withColumn("score", F.round("score", 4)), "z", _ZR_SQL.format(agg=_a, how=f"round({_h}, 4)"))
query("zincrby", lambda c: zsets.zincrby(c.z, c.z.select("key", "member", F.lit(2.5).alias("delta"))), "z", "SELECT key, member, score + 2.5 AS score FROM z")
for _agg in ("sum", "min", "max"):
    query(f"zunion_{_agg}", lambda c, a=_agg: zsets.combine([c.za, c.zb], "union", [2.0, 1.0], a), "za zb", f"SELECT member, {_agg}(score) AS score FROM (SELECT member, score * 2 AS score FROM za UNION ALL SELECT member, score FROM zb) GROUP BY member")
    query(f"zinter_{_agg}", lambda c, a=_agg: zsets.combine([c.za, c.zb], "inter", [1.0, 3.0], a), "za zb", f"SELECT member, {_agg}(score) AS score FROM (SELECT member, score FROM za UNION ALL SELECT member, score * 3 FROM zb) GROUP BY member HAVING count(*) = 2")
query("zinter_twice", lambda c: zsets.combine([c.za, c.za, c.zb], "inter"), "za zb", "SELECT za.member, za.score * 2 + zb.score AS score FROM za JOIN zb ON za.member = zb.member")
query("zdiff", lambda c: zsets.combine([c.za, c.zb.filter("score > 4")], "diff"), "za zb", "SELECT member, score FROM za WHERE member NOT IN (SELECT member FROM zb WHERE score > 4)")
query("zintercard", lambda c: zsets.combine([c.za, c.zb], "inter").agg(F.least(F.count("*"), F.lit(10)).alias("n")), "za zb", "SELECT least(count(*), 10) AS n FROM za JOIN zb ON za.member = zb.member")
query("zrandmember", lambda c: zsets.zrandmember(c.z, 2), "zr", "SELECT key, member, score FROM zr WHERE rank < 2")

# Geo
query("geoadd", lambda c: geo.geoadd(c.places), "geo", "SELECT key, member, score FROM geo")
query("geopos", lambda c: geo.geopos(geo.geoadd(c.places)).select("key", "member", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat")), "pos", "SELECT key, member, round(lon, 6) AS lon, round(lat, 6) AS lat FROM pos")
_HAV = "2 * 6372797.560856 * asin(sqrt(power(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * power(sin((radians({b}lon) - radians({a}lon)) / 2), 2)))"
query("geodist", lambda c: geo.geodist(geo.geoadd(c.places), c.table("customer").select(C("c_custkey").alias("a"), (C("c_custkey") + 1).alias("b")), "km").select("a", "b", F.round("distance", 3).alias("distance")), "pos", f"SELECT c_custkey AS a, c_custkey + 1 AS b, round(({_HAV.format(a='p.', b='q.')}) / 1000, 3) AS distance FROM customer LEFT JOIN pos p ON p.member = c_custkey LEFT JOIN pos q ON q.member = c_custkey + 1")
_G = geo.quantised(10.0, 20.0)
_CENTRE = f", c AS (SELECT CAST({_G[0]!r} AS DOUBLE) AS lon, CAST({_G[1]!r} AS DOUBLE) AS lat) "
query("georadius", lambda c: geo.search_radius(geo.geoadd(c.places), 10.0, 20.0, 5000, "km").select("key", "member", F.round("distance", 3).alias("distance")), "pos", _CENTRE + f"SELECT p.key, p.member, round(({_HAV.format(a='c.', b='p.')}) / 1000, 3) AS distance FROM pos p CROSS JOIN c WHERE ({_HAV.format(a='c.', b='p.')}) <= 5000000")
query("georadius_count", lambda c: geo.search_radius(geo.geoadd(c.places), 10.0, 20.0, 15000, "km", 10).select("member", F.round("distance", 3).alias("distance")), "pos", _CENTRE + f"SELECT p.member, round(({_HAV.format(a='c.', b='p.')}) / 1000, 3) AS distance FROM pos p CROSS JOIN c ORDER BY ({_HAV.format(a='c.', b='p.')}), p.member LIMIT 10")
query("georadiusbymember", lambda c: geo.search_member(geo.geoadd(c.places), 100, 6000, "km").select("key", "member", F.round("distance", 3).alias("distance")), "pos", f", c AS (SELECT lon, lat FROM pos WHERE member = 100) SELECT p.key, p.member, round(({_HAV.format(a='c.', b='p.')}) / 1000, 3) AS distance FROM pos p CROSS JOIN c WHERE ({_HAV.format(a='c.', b='p.')}) / 1000 <= 6000")
query("geosearch_box", lambda c: geo.search_box(geo.geoadd(c.places), 10.0, 20.0, 8000, 6000, "km").select("key", "member", F.round("distance", 3).alias("distance")), "pos", _CENTRE + f", q AS (SELECT p.*, c.lon AS clon, c.lat AS clat FROM pos p CROSS JOIN c) SELECT key, member, round((2 * 6372797.560856 * asin(sqrt(power(sin((radians(lat) - radians(clat)) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * power(sin((radians(lon) - radians(clon)) / 2), 2)))) / 1000, 3) AS distance FROM q WHERE 2 * 6372797.560856 * asin(sqrt(power(cos(radians(clat)) * sin((radians(lon) - radians(clon)) / 2), 2))) <= 4000000 AND 2 * 6372797.560856 * asin(sqrt(power(sin((radians(lat) - radians(clat)) / 2), 2))) <= 3000000")
query("geohash", lambda c: geo.geohashes(geo.geoadd(c.places)), "geo", "SELECT key, member, " + " || ".join(f"substr('{X.GEOHASH}', CAST(((score >> {shift}) & 31) + 1 AS INT), 1)" for shift in range(50, -1, -5)) + " AS geohash FROM geo")
query("geo_join", lambda c: geo.join_radius(geo.geoadd(geo.dealt(c.places)), geo.geoadd(geo.dealt(c.places)), 300_000).select("a_member", "b_member", X.rounded(C("distance"), 2).alias("distance")), "pos", f"SELECT p.member AS a_member, q.member AS b_member, round({_HAV.format(a='p.', b='q.')}, 2) AS distance FROM pos p JOIN pos q ON abs(p.lat - q.lat) < 3 WHERE ({_HAV.format(a='p.', b='q.')}) <= 300000")

# Streams
query("xlen", lambda c: streams.xlen(c.x), "x", "SELECT key, count(*) AS n FROM x GROUP BY key")
query("xrange", lambda c: streams.xrange(c.x, "1704067200000", "1704500000000-9999"), "x", "SELECT key, ms, seq, \"user\", value FROM x WHERE ms >= 1704067200000 AND (ms < 1704500000000 OR (ms = 1704500000000 AND seq <= 9999))")
query("xrange_count", lambda c: streams.xrange(c.x, count=5).select("key", "ms", "seq"), "xn", "SELECT key, ms, seq FROM xn WHERE up <= 5")
query("xrevrange_count", lambda c: streams.xrange(c.x, count=5, rev=True).select("key", "ms", "seq"), "xn", "SELECT key, ms, seq FROM xn WHERE down <= 5")
query("xread", lambda c: streams.xread(c.x, c.x.groupBy("key").agg((F.min("ms") + 86_400_000).alias("c_ms"), F.lit(0).alias("c_seq")), 7).select("key", "ms", "seq"), "x", ", cur AS (SELECT key, min(ms) + 86400000 AS c FROM x GROUP BY key) SELECT key, ms, seq FROM (SELECT x.*, row_number() OVER (PARTITION BY x.key ORDER BY ms, seq) AS m FROM x JOIN cur ON x.key = cur.key WHERE ms > c OR (ms = c AND seq > 0)) WHERE m <= 7")
query("xtrim", lambda c: streams.xtrim(c.x, 100).select("key", "ms", "seq"), "xn", "SELECT key, ms, seq FROM xn WHERE down <= 100")
query("xdel", lambda c: streams.xdel(c.x, c.x.filter("seq % 3 = 0").select("key", "ms", "seq")).select("key", "ms", "seq"), "x", "SELECT key, ms, seq FROM x WHERE seq % 3 <> 0")
query("xinfo", lambda c: streams.xinfo(c.x), "xn", "SELECT key, count(*) AS length, max(ms) FILTER (up = 1) AS first_ms, max(seq) FILTER (up = 1) AS first_seq, max(ms) FILTER (down = 1) AS last_ms, max(seq) FILTER (down = 1) AS last_seq FROM xn GROUP BY key")

# Sparse arrays
query("ar_get_range", lambda c: arrays.argetrange(c.a, 1, 4), "a", "SELECT k.key, g AS idx, a.value FROM (SELECT DISTINCT key FROM a) k CROSS JOIN range(1, 5) AS t(g) LEFT JOIN a ON a.key = k.key AND a.idx = g")
query("ar_scan", lambda c: arrays.arscan(c.a, 2, 6, 2), "a", "SELECT key, idx, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS m FROM a WHERE idx BETWEEN 2 AND 6) WHERE m <= 2")
query("ar_grep", lambda c: arrays.argrep(c.a, 1, 5, [("GLOB", "1*"), ("EXACT", "27")]), "a", "SELECT key, idx, value FROM a WHERE idx BETWEEN 1 AND 5 AND (starts_with(CAST(value AS VARCHAR), '1') OR value = 27)")
query("ar_op", lambda c: arrays.arop(c.a, 1, 5, 10), "a", "SELECT key, count(*) AS used, count(*) FILTER (value = 10) AS matches, CAST(sum(value) AS BIGINT) AS total, min(value) AS least, max(value) AS most, bit_and(value) AS all_and, bit_or(value) AS all_or, bit_xor(value) AS all_xor FROM a WHERE idx BETWEEN 1 AND 5 GROUP BY key")
query("ar_info", lambda c: arrays.arinfo(c.a), "a", "SELECT key, count(*) AS count, max(idx) + 1 AS length FROM a GROUP BY key")
query("ar_del_range", lambda c: arrays.ardelrange(c.a, 2, 3), "a", "SELECT key, idx, value FROM a WHERE idx NOT BETWEEN 2 AND 3")
query("ar_ring", lambda c: arrays.arring(c.items.select("key", "seq", C("item").alias("value")), 8), "items", ", o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) - 1 AS n FROM items) SELECT key, CAST(n % 8 AS BIGINT) AS idx, max_by(item, n) AS value FROM o GROUP BY 1, 2")
query("ar_lastitems", lambda c: arrays.arlastitems(c.items, 3), "items", "SELECT key, item, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS m FROM items) WHERE m <= 3")

# Vectors. The queries of a search are a stated set, the elements divisible by 20, against all.
_QS = lambda c: [(r.element, r.vector) for r in c.v.filter("element % 20 = 0").select("element", "vector").collect()]
_COS = "list_cosine_similarity(q.vector, v.vector)"
query("vsim_topk", lambda c: vectors.vsim(c.v, _QS(c), 10).select("query", "element", F.round("score", 6).alias("score"), C("rank").cast("bigint").alias("rank")), "v", f"SELECT query, element, round(s, 6) AS score, rank FROM (SELECT q.element AS query, v.element, {_COS} AS s, row_number() OVER (PARTITION BY q.element ORDER BY {_COS} DESC, v.element) AS rank FROM v q JOIN v ON q.element % 20 = 0) WHERE rank <= 10")
query("vsim_filter", lambda c: vectors.vsim(c.v, _QS(c), 5, ".label >= 3 && .label != 5").select("query", "element", F.round("score", 6).alias("score")), "v", f"SELECT query, element, round(s, 6) AS score FROM (SELECT q.element AS query, v.element, {_COS} AS s, row_number() OVER (PARTITION BY q.element ORDER BY {_COS} DESC, v.element) AS rank FROM v q JOIN v ON q.element % 20 = 0 AND v.label >= 3 AND v.label <> 5) WHERE rank <= 5")
query("semantic_search", lambda c: vectors.semantic_search(c.v.filter("element % 20 <> 0"), _QS(c), 0.2).select("query", "element", F.round("score", 6).alias("score")), "v", f"SELECT query, element, round(s, 6) AS score FROM (SELECT q.element AS query, v.element, {_COS} AS s, row_number() OVER (PARTITION BY q.element ORDER BY {_COS} DESC, v.element) AS rank FROM v q JOIN v ON q.element % 20 = 0 AND v.element % 20 <> 0 WHERE {_COS} >= 0.2) WHERE rank = 1")
query("semantic_governed", lambda c: vectors.semantic_search(c.v.filter("element % 20 <> 0").withColumn("governance", F.when(C("element") % 3 == 0, F.concat(F.lit("t"), (C("element") % 2).cast("string")))), _QS(c), 0.2, ["t0"]).select("query", "element"), "v", f"SELECT query, element FROM (SELECT q.element AS query, v.element, row_number() OVER (PARTITION BY q.element ORDER BY {_COS} DESC, v.element) AS rank FROM v q JOIN v ON q.element % 20 = 0 AND v.element % 20 <> 0 WHERE {_COS} >= 0.2 AND (v.element % 3 <> 0 OR v.element % 2 = 0)) WHERE rank = 1")
query("vinfo", lambda c: vectors.vinfo(c.v), "v", "SELECT count(*) AS size, CAST(max(len(vector)) AS INT) AS dim FROM v")
query("vreduce", lambda c: c.v.select("element", F.round(vectors.reduced(C("vector"), 64, 4)[1], 6).alias("second")), "v", "SELECT element, round(list_sum(vector[17:32]) / 16, 6) AS second FROM v")
query("vquantise", lambda c: c.v.select("element", F.aggregate(vectors.quantised(C("vector"), "BIN"), F.lit(0), lambda a, x: a + x).alias("positive")), "v", "SELECT element, CAST(len(list_filter(vector, lambda x: x > 0)) AS INT) AS positive FROM v")
query("vrange", lambda c: vectors.vrange(c.v, "[1", "(3"), "v", "SELECT element FROM v WHERE CAST(element AS VARCHAR) >= '1' AND CAST(element AS VARCHAR) < '3'")
query("lsh_candidates", lambda c: vectors.lsh_candidates(c.v, c.v.filter("element % 20 = 0"), 0.7))
query("lsh_search", lambda c: vectors.lsh_search(c.v, c.v.filter("element % 20 = 0"), 0.7).select("query", "element", F.round("score", 6).alias("score")))
_TYPED = [(".f == 5", "e % 6 = 0"), (".f != 5", "e % 6 <> 0 AND e % 6 <> 4"), (".f > 4.5", "e % 6 = 0"), ('.f == "5"', "e % 6 = 1"), (".f == true", "e % 6 = 2"), (".f == null", "e % 6 = 3"), ('.f != "b"', "e % 6 <> 4 AND e % 6 <> 5"), ('.f > "a"', "FALSE"), (".f <= 5 || .f == false", "e % 6 = 0")]
query(
    "vfilter_types", lambda c: c.v.select("element", F.element_at(F.lit(['{"f": 5}', '{"f": "5"}', '{"f": true}', '{"f": null}', '{"g": 1}', '{"f": "b"}']), (C("element") % 6 + 1).cast("int")).alias("attrs")).select("element", *[vectors.attribute_filter(f).alias(f"m{i}") for i, (f, _) in enumerate(_TYPED)]),
    "v", ", t AS (SELECT element, element AS e FROM v) SELECT element, " + ", ".join(f"({cond}) AS m{i}" for i, (_, cond) in enumerate(_TYPED)) + " FROM t",
)

# Exact sketches
query("pfcount_exact", lambda c: sketches.pfcount(c.s), "s", "SELECT key, count(DISTINCT member) AS n FROM s GROUP BY key")
query("pfcount_union", lambda c: sketches.pfcount(c.s, ["click", "signup"]), "s", "SELECT count(DISTINCT member) AS n FROM s WHERE key IN ('click', 'signup')")
query("pfmerge", lambda c: sketches.pfmerge(c.s, "view", ["click", "signup"]), "s", "SELECT key, member FROM s WHERE key <> 'view' UNION ALL SELECT DISTINCT 'view', member FROM s WHERE key IN ('click', 'signup')")
query("bf_add", lambda c: sketches.first_seen(c.items), "items", "SELECT key, item, seq, CASE WHEN row_number() OVER (PARTITION BY key, item ORDER BY seq) = 1 THEN 1 ELSE 0 END AS added FROM items")
_IP = ", p(key, item) AS (VALUES ('click', '1'), ('view', '77'), ('view', 'none')) "
_ip = lambda c: values(c, "key string, item string", ("click", "1"), ("view", "77"), ("view", "none"))
query("bf_exists", lambda c: sketches.contains(c.items, _ip(c)), "items", _IP + "SELECT p.key, p.item, CASE WHEN EXISTS (SELECT 1 FROM items i WHERE i.key = p.key AND i.item = p.item) THEN 1 ELSE 0 END AS found FROM p")
query("bf_card", lambda c: sketches.card(c.items), "items", "SELECT key, count(DISTINCT item) AS n FROM items GROUP BY key")
query("cf_count", lambda c: sketches.counts(c.items), "items", "SELECT key, item, count(*) AS cnt FROM items GROUP BY key, item")
query("cf_del", lambda c: sketches.cuckoo_counts(c.items.withColumn("sign", F.when(C("seq") % 3 == 0, -1).otherwise(1))), "items", """, o AS (SELECT key, item, CASE WHEN seq % 3 = 0 THEN -1 ELSE 1 END AS d, row_number() OVER (PARTITION BY key, item ORDER BY seq) AS rn FROM items),
 f AS (SELECT key, item, rn, greatest(d, 0) AS v FROM o WHERE rn = 1 UNION ALL SELECT f.key, f.item, o.rn, greatest(f.v + o.d, 0) FROM f JOIN o ON o.key = f.key AND o.item = f.item AND o.rn = f.rn + 1)
 SELECT key, item, CAST(max_by(v, rn) AS INT) AS cnt FROM f GROUP BY key, item HAVING max_by(v, rn) > 0""")
query("cms_query", lambda c: sketches.cms_query(c.items, _ip(c)), "items", _IP + "SELECT p.key, p.item, (SELECT count(*) FROM items i WHERE i.key = p.key AND i.item = p.item) AS cnt FROM p")
query("cms_merge", lambda c: sketches.cms_merge(c.items, ["click", "view"]), "items", "SELECT item, count(*) AS cnt FROM items WHERE key IN ('click', 'view') GROUP BY item")
query("cms_info", lambda c: sketches.cms_info(c.items), "items", "SELECT key, greatest(count(DISTINCT item), 1) AS width, 1 AS depth, count(DISTINCT item) AS count FROM items GROUP BY key")
_TOP = ", t AS (SELECT key, item, count(*) AS cnt, min(seq) AS f FROM items GROUP BY key, item), r AS (SELECT key, item, cnt, row_number() OVER (PARTITION BY key ORDER BY cnt DESC, f, item) AS rank FROM t) "
query("topk_list", lambda c: sketches.topk_list(c.items, 5).withColumn("rank", C("rank").cast("bigint")), "items", _TOP + "SELECT key, item, cnt, rank FROM r WHERE rank <= 5")
query("topk_add", lambda c: sketches.topk_expelled(c.items, 5))
query("topk_query", lambda c: sketches.topk_query(c.items, 50, _ip(c)), "items", _TOP + _IP.strip() + " SELECT p.key, p.item, CASE WHEN r.rank <= 50 THEN 1 ELSE 0 END AS found FROM p LEFT JOIN r ON r.key = p.key AND r.item = p.item")
query("tdigest_quantile", lambda c: sketches.quantiles(c.samples, [0.0, 0.5, 0.95, 1.0]), "sr", "SELECT key, CAST(q AS DOUBLE) AS q, value FROM sr JOIN (VALUES (0.0), (0.5), (0.95), (1.0)) AS t(q) ON rn = CAST(round((n - 1) * CAST(q AS DOUBLE)) AS BIGINT)")
query("tdigest_ranks", lambda c: sketches.ranks(c.samples, 50.0), "samples", "SELECT key, avg(CAST(value <= 50.0 AS DOUBLE)) AS cdf, count(*) FILTER (value < 50.0) AS rank, count(*) FILTER (value > 50.0) AS revrank FROM samples GROUP BY key")
query("tdigest_byrank", lambda c: sketches.by_rank(c.samples, 3), "sr", "SELECT key, value FROM sr WHERE rn = 3")
query("tdigest_byrevrank", lambda c: sketches.by_rank(c.samples, 3, True), "sr", "SELECT key, value FROM sr WHERE rn = n - 4")
query("tdigest_trimmed_mean", lambda c: sketches.trimmed_mean(c.samples, 0.1, 0.9).select("key", F.round("mean", 6).alias("mean")), "sr", "SELECT key, round(avg(value), 6) AS mean FROM sr WHERE rn BETWEEN floor((n - 1) * CAST(0.1 AS DOUBLE)) AND ceil((n - 1) * CAST(0.9 AS DOUBLE)) GROUP BY key")
query("tdigest_add", lambda c: sketches.extremes(sketches.tdigest_add(c.samples, c.table("orders").select(F.lit("view").alias("key"), C("o_totalprice").alias("value")))), "samples", "SELECT key, min(value) AS least, max(value) AS most, count(value) AS nodes FROM (SELECT key, value FROM samples UNION ALL SELECT 'view', CAST(o_totalprice AS DOUBLE) FROM orders) GROUP BY key")
query("tdigest_merge", lambda c: sketches.extremes(sketches.tdigest_merge(c.samples, "view", ["click", "error"], override=True)), "samples", "SELECT key, min(value) AS least, max(value) AS most, count(value) AS nodes FROM (SELECT key, value FROM samples WHERE key <> 'view' UNION ALL SELECT 'view', value FROM samples WHERE key IN ('click', 'error')) GROUP BY key")
query("tdigest_min_max", lambda c: sketches.extremes(c.samples), "samples", "SELECT key, min(value) AS least, max(value) AS most, count(value) AS nodes FROM samples GROUP BY key")

# JSON
query("json_get", lambda c: jsondocs.get(c.j, "$.k"), "j", "SELECT key, CAST(json_extract(doc, '$.k') AS VARCHAR) AS value FROM j")
query("json_type", lambda c: jsondocs.types(c.j, ".k"), "j", "SELECT key, CASE WHEN json_type(doc, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN 'number' END AS type FROM j")
query("json_deep_path", lambda c: jsondocs.get(c.j, "$.k.x"), "j", "SELECT key, CAST(NULL AS VARCHAR) AS value FROM j")
query("json_objkeys", lambda c: jsondocs.objkeys(c.j), "j", "SELECT key, unnest(json_keys(doc)) AS field FROM j")
query("json_objlen", lambda c: jsondocs.objlen(c.j), "j", "SELECT key, CAST(len(json_keys(doc)) AS INT) AS n FROM j")
query("json_arrlen", lambda c: jsondocs.arrlen(c.j, ".k"), "j", "SELECT key, 0 AS n FROM j")
query("json_numincrby", lambda c: jsondocs.number(c.j, ".k", 2.5), "j", "SELECT key, CAST(json_extract_string(doc, '$.k') AS DOUBLE) + 2.5 AS value FROM j")
query("json_nummultby", lambda c: jsondocs.number(c.j, ".k", 3.0, True), "j", "SELECT key, CAST(json_extract_string(doc, '$.k') AS DOUBLE) * 3.0 AS value FROM j")
query("json_memory", lambda c: jsondocs.memory(c.j), "j", "SELECT key, CAST(strlen(replace(doc, ' ', '')) AS INT) AS bytes FROM j")
query("json_set", lambda c: jsondocs.set_at(c.j, ".z", 1).select("key", "doc"), "j", "SELECT key, replace(rtrim(doc, '}'), ' ', '') || ',\"z\":1}' AS doc FROM j")
query("json_del", lambda c: jsondocs.removed(c.j, ".k"), "j", "SELECT key, '{}' AS doc, '1' AS reply FROM j")
query("json_merge", lambda c: jsondocs.merged(c.j, {"k": None, "m": {"a": 1}}), "j", "SELECT key, '{\"m\":{\"a\":1}}' AS doc FROM j")
query("json_clear", lambda c: jsondocs.cleared(c.j).select("key", "doc"), "j", "SELECT key, '{}' AS doc FROM j")


def _doc(a: str = "a", b: str = "b", n: str = "n", s: str = "s", more: str = "''") -> str:
    """The documents of Catalog.jd with some parts replaced, as SQL."""
    return f"""'{{"a":[' || array_to_string({a}, ',') || '],"b":' || {b} || ',"n":' || {n} || ',"o":{{"k":1}},"s":"' || {s} || '"' || {more} || '}}'"""


_NOT = "CAST(NULL AS VARCHAR) AS error"
for _name, _call, _made, _reply in (
    ("json_arrappend", lambda j: jsondocs.arr_append(j, ".a", 9, "y"), _doc(a="list_concat(a, ['9', '\"y\"'])"), "CAST(len(a) + 2 AS VARCHAR)"),
    ("json_arrinsert", lambda j: jsondocs.arr_insert(j, ".a", 1, {"k": [1]}), _doc(a="list_concat(list_concat(a[1:1], ['{\"k\":[1]}']), a[2:])"), "CAST(len(a) + 1 AS VARCHAR)"),
    ("json_arrpop", lambda j: jsondocs.arr_pop(j, ".a"), _doc(a="a[1:2]"), "a[3]"),
    ("json_arrtrim", lambda j: jsondocs.arr_trim(j, ".a", 1, 5), _doc(a="a[2:]"), "CAST(greatest(len(a) - 1, 0) AS VARCHAR)"),
    ("json_arrtrim_stop", lambda j: jsondocs.arr_trim(j, ".a", 1, -1), _doc(a="a[2:2]"), "CAST(least(len(a), 1) AS VARCHAR)"),
    ("json_strappend", lambda j: jsondocs.str_append(j, ".s", '"é!"'), _doc(s="s || 'é!'"), "CAST(strlen(s) + 3 AS VARCHAR)"),
    ("json_toggle", lambda j: jsondocs.toggled(j, ".b"), _doc(b="CASE WHEN b = 'true' THEN 'false' ELSE 'true' END"), "CASE WHEN b = 'true' THEN '0' ELSE '1' END"),
    ("json_numincrby_doc", lambda j: jsondocs.changed_number(j, ".n", 2.5), _doc(n="CAST(CAST(n AS DOUBLE) + 2.5 AS VARCHAR)"), "CAST(CAST(n AS DOUBLE) + 2.5 AS VARCHAR)"),
    ("json_set_new", lambda j: jsondocs.set_at(j, ".z", [1, None]), _doc(more="',\"z\":[1,null]'"), "'OK'"),
    ("json_clear_array", lambda j: jsondocs.cleared(j, ".a"), _doc(a="a[1:0]"), "'1'"),
):
    query(_name, lambda c, f=_call: f(c.jd), "jp", f"SELECT key, {_made} AS doc, {_reply} AS reply, {_NOT} FROM jp")
for _name, _call, _error in (("json_arrpop_string", lambda j: jsondocs.arr_pop(j, ".s"), "an array"), ("json_strappend_number", lambda j: jsondocs.str_append(j, ".n", "x"), "a string"), ("json_toggle_array", lambda j: jsondocs.toggled(j, ".a"), "a boolean")):
    query(_name, lambda c, f=_call: f(c.jd), "jp", f"SELECT key, {_doc()} AS doc, CAST(NULL AS VARCHAR) AS reply, 'JSON path is not {_error}' AS error FROM jp")
query("json_arrindex", lambda c: jsondocs.arrindex(c.jd, ".a", '"x"'), "jp", "SELECT key, CAST(coalesce(list_position(a, '\"x\"'), 0) - 1 AS BIGINT) AS at FROM jp")
query("json_strlen", lambda c: jsondocs.strlen(c.jd, ".s"), "jp", "SELECT key, CAST(strlen(s) AS INT) AS n FROM jp")
query("json_strlen_other", lambda c: jsondocs.strlen(c.jd, ".o"), "jp", "SELECT key, 0 AS n FROM jp")
query("json_arrlen_doc", lambda c: jsondocs.arrlen(c.jd, ".a"), "jp", "SELECT key, CAST(len(a) AS INT) AS n FROM jp")
query("json_types_doc", lambda c: jsondocs.types(c.jd, ".o").unionByName(jsondocs.types(c.jd, ".b")), "jp", "SELECT key, 'object' AS type FROM jp UNION ALL SELECT key, 'boolean' FROM jp")
query("json_get_doc", lambda c: jsondocs.get(c.jd, ".a"), "jp", "SELECT key, '[' || array_to_string(a, ',') || ']' AS value FROM jp")
query("json_del_doc", lambda c: jsondocs.removed(c.jd, ".o"), "jp", f"SELECT key, replace({_doc()}, '\"o\":{{\"k\":1}},', '') AS doc, '1' AS reply FROM jp")
query("json_merge_doc", lambda c: jsondocs.merged(c.jd, {"a": None, "o": {"k": None, "m": [1]}}), "jp", "SELECT key, '{\"b\":' || b || ',\"n\":' || n || ',\"o\":{\"m\":[1]},\"s\":\"' || s || '\"}' AS doc FROM jp")

# Time series
query("ts_range", lambda c: timeseries.between(c.ts, 1704067200000, 1704240000000), "ts", "SELECT key, ts, value FROM ts WHERE ts BETWEEN 1704067200000 AND 1704240000000")
query("ts_get", lambda c: timeseries.last(c.ts), "ts", "SELECT key, max(ts) AS ts, arg_max(value, ts) AS value FROM ts GROUP BY key")
query("ts_mget", lambda c: timeseries.mget(c.ts, c.series, length="odd"), "ts", "SELECT key, max(ts) AS ts, arg_max(value, ts) AS value FROM ts WHERE length(key) % 2 = 1 GROUP BY key")
query("ts_mrange", lambda c: timeseries.mrange(c.ts, c.series, 1704067200000, 1704240000000, type="view"), "ts", "SELECT key, ts, value FROM ts WHERE ts BETWEEN 1704067200000 AND 1704240000000 AND key = 'view'")
query("ts_queryindex", lambda c: timeseries.matching(c.series, length="even"), "ts", "SELECT DISTINCT key FROM ts WHERE length(key) % 2 = 0")
query("ts_del", lambda c: timeseries.delete(c.ts, 1704067200000, 1704240000000), "ts", "SELECT key, ts, value FROM ts WHERE ts NOT BETWEEN 1704067200000 AND 1704240000000")
query("ts_incrby", lambda c: timeseries.incrby(c.events.select(C("event_type").alias("key"), C("ms").alias("ts"), C("event_id").alias("seq"), F.lit(1).alias("delta"))), "ev", ", r AS (SELECT event_type AS key, ms AS ts, event_id, sum(1) OVER (PARTITION BY event_type ORDER BY ms, event_id) AS v FROM ev) SELECT key, ts, CAST(max_by(v, event_id) AS BIGINT) AS value FROM r GROUP BY key, ts")
query("ts_info", lambda c: timeseries.info(c.ts), "ts", "SELECT key, count(*) AS samples, count(*) * 16 AS bytes, min(ts) AS first_ts, max(ts) AS last_ts FROM ts GROUP BY key")
query("ts_rollup", lambda c: timeseries.rollup(c.ts, 86_400_000).withColumn("total", F.round("total", 6)), "ts", "SELECT key, ts - ts % 86400000 AS bucket, count(*) AS n, round(sum(value), 6) AS total, min(value) AS least, max(value) AS most FROM ts GROUP BY 1, 2")

# State
query("recovery_fold", lambda c: state.recovery_fold(c.wal), "wal", """, w AS (SELECT key, max((timestamp_ms, sequence)) AS at, max_by(op, (timestamp_ms, sequence)) AS op, max_by(value, (timestamp_ms, sequence)) AS value FROM wal WHERE op IN ('Set', 'Del') GROUP BY key)
 SELECT w.key, w.value, max_by(e.expire_at_ms, (e.timestamp_ms, e.sequence)) AS expire_at_ms FROM w LEFT JOIN wal e ON e.key = w.key AND e.op = 'Expire' AND (e.timestamp_ms, e.sequence) > w.at WHERE w.op = 'Set' GROUP BY w.key, w.value""")
query("eviction_lru", lambda c: state.evict(c.events.groupBy(C("user_id").alias("key")).agg(F.max("ms").alias("touch"), F.sum(F.octet_length("props")).alias("bytes")), 20_000, [C("touch").asc(), C("key").asc()]).select("key", "touch", "bytes"), "ev", """, e AS (SELECT user_id AS key, max(ms) AS touch, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM ev GROUP BY user_id),
 r AS (SELECT *, sum(bytes) OVER (ORDER BY touch, key) AS run, sum(bytes) OVER () AS total FROM e) SELECT key, touch, bytes FROM r WHERE run > total - 20000""")
query("prefix_eviction", lambda c: state.evict_prefixes(c.events.groupBy(C("user_id").alias("key")).agg(F.max("ms").alias("touch"), F.sum(F.octet_length("props")).alias("bytes")).withColumn("prefix", C("key") % 10).withColumn("suffix_len", F.length(C("key").cast("string"))), 20_000).select("key"), "ev", """, e AS (SELECT user_id AS key, max(ms) AS touch, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM ev GROUP BY user_id), g AS (SELECT *, key % 10 AS prefix, length(CAST(key AS VARCHAR)) AS sl, max(touch) OVER (PARTITION BY key % 10) AS grp FROM e),
 r AS (SELECT *, sum(bytes) OVER (ORDER BY grp, prefix, sl DESC, touch, key) AS run, sum(bytes) OVER () AS total FROM g) SELECT key FROM r WHERE run > total - 20000""")
query("throttle", lambda c: state.throttle(c.counters.select("key", "seq", C("delta").alias("qty")), 500), "counters", """, o AS (SELECT key, seq, greatest(delta, 1) AS qty, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM counters),
 f AS (SELECT key, seq, qty, rn, CASE WHEN qty > 500 THEN 1 ELSE 0 END AS limited, CASE WHEN qty > 500 THEN 500 ELSE 500 - qty END AS remaining FROM o WHERE rn = 1
 UNION ALL SELECT o.key, o.seq, o.qty, o.rn, CASE WHEN o.qty > f.remaining THEN 1 ELSE 0 END, CASE WHEN o.qty > f.remaining THEN f.remaining ELSE f.remaining - o.qty END FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1)
 SELECT key, seq, qty, limited, remaining FROM f""")
query("locks", lambda c: state.locks(c.events.select((C("user_id") % 20).cast("string").alias("key"), C("event_id").alias("seq"), C("ms").alias("at_ms"), F.when(C("event_type") == "error", "release").when(C("event_type") == "view", "renew").otherwise("acquire").alias("op"), C("user_id").cast("string").alias("token"), F.lit(86_400_000).alias("ttl_ms"))), "ev", """, o AS (SELECT CAST(user_id % 20 AS VARCHAR) AS key, event_id AS seq, ms AS tm, CASE WHEN event_type = 'error' THEN 'release' WHEN event_type = 'view' THEN 'renew' ELSE 'acquire' END AS op, CAST(user_id AS VARCHAR) AS token, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS rn FROM ev),
 f AS (SELECT key, rn, CASE WHEN op = 'acquire' THEN token END AS token, CASE WHEN op = 'acquire' THEN tm + 86400000 END AS until FROM o WHERE rn = 1
 UNION ALL SELECT f.key, o.rn, CASE WHEN f.token IS NULL OR f.until <= o.tm THEN CASE WHEN o.op = 'acquire' THEN o.token ELSE f.token END WHEN f.token = o.token AND o.op = 'release' THEN NULL ELSE f.token END,
 CASE WHEN f.token IS NULL OR f.until <= o.tm THEN CASE WHEN o.op = 'acquire' THEN o.tm + 86400000 ELSE f.until END WHEN f.token = o.token AND o.op = 'release' THEN NULL WHEN f.token = o.token AND o.op = 'renew' THEN o.tm + 86400000 ELSE f.until END FROM f JOIN o ON o.key = f.key AND o.rn = f.rn + 1),
 n AS (SELECT key, max(tm) AS now_ms FROM o GROUP BY key), e AS (SELECT key, max(rn) AS rn FROM o GROUP BY key)
 SELECT f.key, f.token, CAST(f.until AS BIGINT) AS until FROM f JOIN e ON e.key = f.key AND e.rn = f.rn JOIN n ON n.key = f.key WHERE f.token IS NOT NULL AND f.until > n.now_ms""")
_QUEUED = lambda c: c.events.select((C("event_id") % 500).alias("txn"), C("event_id").alias("ord"), (C("user_id") % 300).cast("string").alias("key"), F.when(C("event_type") == "error", "DEL").otherwise("SET").alias("op"), C("event_type").alias("value"))
_WATCHED = lambda c: c.versions.select((C("key").cast("bigint") % 500).alias("txn"), "key", F.when(C("key").cast("bigint") % 3 == 0, C("version") + 1).otherwise(C("version")).alias("version"))
_EXEC = """, qu AS (SELECT event_id % 500 AS txn, event_id AS ord, CAST(user_id % 300 AS VARCHAR) AS key, CASE WHEN event_type = 'error' THEN 'DEL' ELSE 'SET' END AS op, event_type AS value FROM events),
 wa AS (SELECT CAST(key AS BIGINT) % 500 AS txn, key FROM versions), st AS (SELECT DISTINCT txn FROM wa WHERE CAST(key AS BIGINT) % 3 = 0),
 la AS (SELECT key, arg_max(op, (txn, ord)) AS op, arg_max(value, (txn, ord)) AS w FROM qu WHERE txn NOT IN (SELECT txn FROM st) GROUP BY key) """
query("exec_watch", lambda c: state.transactions(c.versions, _QUEUED(c), _WATCHED(c))[0], "versions", _EXEC + "SELECT key, CASE WHEN op IS NULL THEN value ELSE w END AS value, CAST(CASE WHEN op IS NULL THEN version ELSE coalesce(version, 0) + 1 END AS BIGINT) AS version FROM versions FULL JOIN la USING (key) WHERE op IS NULL OR op = 'SET'")
query("exec_replies", lambda c: state.transactions(c.versions, _QUEUED(c), _WATCHED(c))[1], "versions", _EXEC + "SELECT txn, txn NOT IN (SELECT txn FROM st) AS committed FROM (SELECT txn FROM qu UNION SELECT txn FROM wa)")
query("flushdb", lambda c: state.flushed(c.kv(NOW).select("key", "value")), "kv", "SELECT key, value FROM kv WHERE FALSE")


def _recovered(c: Catalog) -> DataFrame:
    """The change log's first half as a snapshot, all of it as segments, and what is recovered from both files."""
    at = io.scratch(c.spark)
    middle = 1_704_500_000_000
    io.write_snapshot(state.recovery_fold(c.wal.filter(C("timestamp_ms") < middle)), f"{at}/snapshot", middle)
    io.append_wal(c.wal, f"{at}/wal")
    return io.recover(c.spark, f"{at}/snapshot", f"{at}/wal")


_FOLD = """, w AS (SELECT key, max((timestamp_ms, sequence)) AS at, max_by(op, (timestamp_ms, sequence)) AS op, max_by(value, (timestamp_ms, sequence)) AS value FROM wal WHERE op IN ('Set', 'Del') GROUP BY key)
 SELECT w.key, w.value, max_by(e.expire_at_ms, (e.timestamp_ms, e.sequence)) AS expire_at_ms FROM w LEFT JOIN wal e ON e.key = w.key AND e.op = 'Expire' AND (e.timestamp_ms, e.sequence) > w.at WHERE w.op = 'Set' GROUP BY w.key, w.value"""
query("recover_files", _recovered, "wal", _FOLD)


def _reread(c: Catalog) -> DataFrame:
    """The customers' entries written as Parquet, ORC, CSV and JSON and read back."""
    at, out = io.scratch(c.spark), None
    kv = c.kv(NOW).select("key", "value")
    for kind in ("parquet", "orc", "csv", "json"):
        io.write(kv, f"{at}/{kind}", kind)
        rows = io.read(c.spark, f"{at}/{kind}", kind, "key string, value string").withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


def _offloaded(c: Catalog) -> DataFrame:
    """Users' last event types, those that are old and long on a colder tier, probed with all users."""
    path = f"{io.scratch(c.spark)}/cold"
    entries = c.events.groupBy(C("user_id").cast("string").alias("key")).agg(F.max_by("event_type", "event_id").alias("value"), F.max("ms").alias("touch"))
    return io.faulted(io.offload(entries, path, 1_706_000_000_000, 400_000_000, 5), path, c.table("customer").select(C("c_custkey").alias("ord"), C("c_custkey").cast("string").alias("key")))


query("overflow_fault_in", _offloaded, "ev", ", e AS (SELECT CAST(user_id AS VARCHAR) AS key, max_by(event_type, event_id) AS value, max(ms) AS touch FROM ev GROUP BY 1) SELECT c_custkey AS ord, CAST(c_custkey AS VARCHAR) AS key, value, CASE WHEN value IS NOT NULL THEN CASE WHEN 1706000000000 - touch >= 400000000 AND strlen(value) >= 5 THEN 'offloaded' ELSE 'resident' END END AS tier FROM customer LEFT JOIN e ON e.key = CAST(c_custkey AS VARCHAR)")
query("file_formats", _reread, "kv", "SELECT key, value, kind FROM kv CROSS JOIN (VALUES ('parquet'), ('orc'), ('csv'), ('json')) AS k(kind)")


def _pairs(c: Catalog) -> DataFrame:
    """Embeddings as a pair file, and the sum of its parts as read back."""
    path = f"{io.scratch(c.spark)}/pairs"
    io.write_pairs(c.v.select(F.lit("e").alias("dataset"), C("element").cast("string").alias("pair_id"), C("label").cast("int").alias("label"), C("vector").alias("cache_embedding"), F.reverse("vector").alias("query_embedding")), path)
    rows = io.read_pairs(c.spark, path)
    return rows.select("pair_id", "label", F.size("cache_embedding").alias("n"), F.round(C("cache_embedding")[0] - C("query_embedding")[0], 5).alias("gap"))


query("pair_file", _pairs, "v", "SELECT CAST(element AS VARCHAR) AS pair_id, CAST(label AS INT) AS label, CAST(len(vector) AS INT) AS n, round(vector[1] - vector[len(vector)], 5) AS gap FROM v")

# Modules and control
query("snowflake_next", lambda c: modules.snowflake_next(c.items), "items", "SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) AS id FROM items")
query("snowflake_info", lambda c: modules.snowflake_info(c.items), "items", "SELECT count(*) AS total FROM items")
query("nr_observe", lambda c: modules.hits(c.items), "items", "SELECT key, count(*) AS hits FROM items GROUP BY key")
query("ft_dictadd", lambda c: modules.dict_add(c.s.toDF("key", "term"), values(c, "key string, term string", ("click", "zebra"), ("click", "1"))), "s", "SELECT key, member AS term FROM s UNION SELECT 'click', 'zebra' UNION SELECT 'click', '1'")
query("ft_dictdump", lambda c: modules.dict_dump(c.s.toDF("key", "term"), "view"), "s", "SELECT member AS term FROM s WHERE key = 'view'")
query("slot_owners", lambda c: modules.owners(c.kv(NOW), ["a", "b", "c"]))
query("session_groups", lambda c: modules.sessions(c.table("conversations").select(F.concat(F.lit("s:"), "conv_id", F.lit(":c:"), "turn").alias("key"), C("role").alias("value"))).groupBy("session").agg(F.count("*").alias("chunks")), "", "SELECT CAST(conv_id AS VARCHAR) AS session, count(*) AS chunks FROM conversations GROUP BY conv_id")
query("evictable", lambda c: modules.evictable(c.items.groupBy("item").agg(F.max("seq").alias("version")).withColumnRenamed("item", "key"), c.items.filter("seq % 2 = 0").select(C("item").alias("key"), C("seq").alias("version"))), "items", "SELECT item AS key, max(seq) AS version FROM items GROUP BY item HAVING max(seq) FILTER (seq % 2 = 0) >= max(seq)")
query("memory_usage", lambda c: control.memory_usage(c.kv(NOW)), "kv", "SELECT key, CAST(strlen(key) + strlen(value) AS INT) AS bytes FROM kv")
query("shard_stats", lambda c: control.stats(c.kv(NOW)))
query("keyspace_info", lambda c: control.info(_KEYS(c)), "kv h s z", _KEYS_SQL + "SELECT type, count(*) AS keys FROM ks GROUP BY type")
query("hot_keys", lambda c: control.hot_keys(c.items.select(C("item").alias("key")), 20), "items", "SELECT item AS key, count(*) AS hits FROM items GROUP BY item ORDER BY hits DESC, key LIMIT 20")


def _asked(c: Catalog, cases: list) -> DataFrame:
    return values(c, "id int, command string, args array<string>", *[(i, command, list(args)) for i, (command, args, _, _) in enumerate(cases)])


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


#: Requests with the replies (or errors) they are to get.
for _family, _cases in requests.CASES.items():
    _rows = ", ".join(f"({i}, '{command}', {_text(reply)}, {_text(error)})" for i, (command, _, reply, error) in enumerate(_cases))
    query(f"answer_{_family}", lambda c, cases=_cases: control.answer(_asked(c, cases)), "", f"SELECT * FROM (VALUES {_rows}) AS t(id, command, reply, error)")

#: Records: all events as requests of a family's commands by turns.
for _family, _commands in modules.RECORDS.items():
    _list = ", ".join(f"'{x}'" for x in _commands)
    _role = " ".join(f"WHEN '{x}' THEN '{role}'" for x, role in _commands.items())
    _rq = f""", q AS (SELECT event_id AS seq, ([{_list}])[event_id % {len(_commands)} + 1] AS command, CAST(user_id % 40 AS VARCHAR) AS u, event_type AS t, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS n FROM events),
 q2 AS (SELECT *, CASE command {_role} END AS role, CASE WHEN command LIKE 'RG.%' THEN 'exec-' || (seq - 3) ELSE 'k' || u END AS first FROM q),
 q3 AS (SELECT seq, command, role, CASE WHEN role = 'run' THEN 'exec-' || seq ELSE first END AS key, '["' || first || '","' || t || '","' || n || '"]' AS args FROM q2),
 q4 AS (SELECT *, last_value(CASE WHEN role = 'del' THEN '' WHEN role IN ('set', 'query', 'run') THEN args END IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM q3),
 q5 AS (SELECT *, coalesce(old <> '', FALSE) AS here FROM q4) """
    _rq = "WITH RECURSIVE " + _rq[2:]
    query(
        f"records_{_family}", lambda c, f=_family: modules.record_replies(c.requests(*modules.RECORDS[f]), f), "",
        _rq + """SELECT seq, command, key, CASE role WHEN 'set' THEN '"OK"' WHEN 'get' THEN CASE WHEN here THEN old ELSE '[]' END WHEN 'del' THEN CAST(CAST(here AS INT) AS VARCHAR) WHEN 'has' THEN CAST(CAST(here AS INT) AS VARCHAR) WHEN 'run' THEN '"' || key || '"'
 WHEN 'query' THEN '[[],[],["Query internal execution time: 0 ms"]]' ELSE '["index_name","' || key || '","num_docs",0,"num_fields",' || (CASE WHEN here THEN 3 ELSE 0 END) || ']' END AS reply FROM q5""",
    )
    query(f"records_{_family}_after", lambda c, f=_family: modules.records(c.requests(*modules.RECORDS[f]), f).select("key", F.to_json("args").alias("args")), "", _rq + "SELECT key, arg_max(args, seq) AS args FROM q5 WHERE role IN ('set', 'query', 'run', 'del') GROUP BY key HAVING arg_max(role, seq) <> 'del'")
query("eval_script", lambda c: scripting.evaluate(c.kv(NOW).select(F.array("key").alias("keys"), F.array("value").alias("args"), F.create_map("key", "value").alias("found")), "return redis.call('GET', KEYS[1])").select(C("keys")[0].alias("key"), "reply"), "kv", "SELECT key, value AS reply FROM kv")

# Event time (extensions)
query("window_tumbling", lambda c: changelog.tumbling(c.table("events").withColumn("ts", C("ts").cast("timestamp_ntz")), "ts", "1 day", "0 seconds", "event_type").select(C("start").cast("date").alias("day"), "event_type", "n"), "", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
query("window_sliding", lambda c: changelog.sliding(c.table("events").withColumn("ts", C("ts").cast("timestamp_ntz")), "ts", "3 days", "1 day", "0 seconds", "event_type").select(C("start").cast("date").alias("day"), "event_type", "n", F.round("total", 4).alias("total")), "", "SELECT CAST(date_trunc('day', ts) - INTERVAL 1 DAY * k AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events CROSS JOIN range(3) AS t(k) GROUP BY 1, 2")
query("window_sessions", lambda c: changelog.sessions(c.table("events").withColumn("ts", C("ts").cast("timestamp_ntz")), "ts", "6 hours", "0 seconds", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest")), "", """WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS b, event_id FROM events),
 g AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM o), n AS (SELECT user_id, s, count(*) AS n FROM g GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY user_id""")

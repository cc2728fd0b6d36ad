"""The catalogue's relations as SQL, for the statements that queries are held against."""

from __future__ import annotations

RELATIONS = {
    "kv_all": """SELECT 'cust:' || c_custkey AS key, c_name AS value, CASE WHEN c_custkey % 7 = 0 THEN c_custkey * 1000 END AS expire_at_ms,
 CASE WHEN c_custkey % 11 = 0 THEN 'g' || (c_custkey % 3) END AS governance FROM customer""",
    "kv": "SELECT * FROM kv_all WHERE (expire_at_ms IS NULL OR expire_at_ms > 500000) AND governance IS NULL",
    "counters": "SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, CAST(floor(value) AS BIGINT) AS delta FROM events",
    "h": """SELECT 'cust:' || c_custkey AS key, f.field, CASE f.field WHEN 'name' THEN c_name WHEN 'segment' THEN c_mktsegment WHEN 'nation' THEN CAST(c_nationkey AS VARCHAR)
 ELSE CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS VARCHAR) END AS value, CASE WHEN f.field = 'segment' AND c_custkey % 5 = 0 THEN c_custkey * 1000 END AS field_expire_at_ms
 FROM customer CROSS JOIN (VALUES ('name'), ('segment'), ('nation'), ('cents')) AS f(field)""",
    "l": """SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pos,
 CAST(l_partkey % 10 AS VARCHAR) AS value FROM lineitem""",
    "lr": "SELECT *, pos AS i, count(*) OVER (PARTITION BY key) AS n FROM l",
    "s": "SELECT DISTINCT event_type AS key, CAST(user_id AS VARCHAR) AS member FROM events",
    "z": "SELECT CAST(c_nationkey AS VARCHAR) AS key, 'c' || c_custkey AS member, c_acctbal AS score FROM customer",
    "zr": "SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rrank, count(*) OVER (PARTITION BY key) AS n FROM z",
    "za": "SELECT CAST(c_nationkey AS VARCHAR) AS member, CAST(count(*) AS DOUBLE) AS score FROM customer GROUP BY 1",
    "zb": "SELECT CAST(s_nationkey AS VARCHAR) AS member, CAST(count(*) AS DOUBLE) AS score FROM supplier GROUP BY 1",
    "ev": "SELECT *, epoch_us(ts) // 1000 AS ms FROM events",
    "x": "SELECT event_type AS key, ms, event_id AS seq, CAST(user_id AS VARCHAR) AS \"user\", value FROM ev",
    "xn": "SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS up, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS down FROM x",
    "a": "SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS idx, CAST(max(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2",
    "v": "SELECT vec_id AS element, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings",
    "j": "SELECT event_id AS key, props AS doc FROM events",
    "jp": """SELECT event_id AS key, CASE WHEN event_id % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE [CAST(user_id % 7 AS VARCHAR), CAST(event_id % 3 AS VARCHAR), '"x"'] END AS a,
 CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS b, CAST(user_id % 10 AS VARCHAR) AS n, event_type AS s FROM events""",
    "versions": "SELECT CAST(user_id AS VARCHAR) AS key, max_by(event_type, event_id) AS value, count(*) AS version FROM events GROUP BY 1",
    "writes": "SELECT 'cust:' || (user_id % 400) AS key, 'w' || event_id AS value, event_id AS seq FROM events",
    "ts": "SELECT event_type AS key, ms AS ts, arg_max(value, event_id) AS value FROM ev GROUP BY 1, 2",
    "items": "SELECT event_type AS key, CAST(user_id AS VARCHAR) AS item, event_id AS seq FROM events",
    "samples": "SELECT event_type AS key, value FROM events",
    "sr": "SELECT *, row_number() OVER (PARTITION BY key ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY key) AS n FROM samples",
    "bits": "SELECT DISTINCT event_type AS key, user_id AS bit FROM events",
    "places": "SELECT 'geo' AS key, c_custkey AS member, (c_custkey * 37 % 36000) / 100.0 - 180.0 AS lon, (c_custkey * 91 % 17000) / 100.0 - 85.0 AS lat FROM customer",
    "geo": """SELECT key, member, (CAST(round((lon + 180.0) / 360.0 * 67108863) AS BIGINT) << 26) | CAST(round((lat + 85.05112878) / 170.10225756 * 67108863) AS BIGINT) AS score FROM places
 WHERE lat BETWEEN -85.05112878 AND 85.05112878""",
    "pos": "SELECT key, member, score, (score >> 26) / 67108863.0 * 360.0 - 180.0 AS lon, (score & 67108863) / 67108863.0 * 170.10225756 - 85.05112878 AS lat FROM geo",
    "wal": """SELECT CAST(user_id % 8 AS INT) AS shard_id, event_id AS sequence, ms AS timestamp_ms, CASE WHEN event_type IN ('signup', 'purchase') THEN 'Set' WHEN event_type = 'view' THEN 'Expire' WHEN event_type = 'error' THEN 'Del' END AS op,
 CAST(user_id AS VARCHAR) AS key, value, CASE WHEN event_type = 'view' THEN ms + 3600000 END AS expire_at_ms FROM ev""",
}

#: Relations built on others.
NEEDS = {"kv": ["kv_all"], "lr": ["l"], "zr": ["z"], "x": ["ev"], "xn": ["x"], "ts": ["ev"], "sr": ["samples"], "geo": ["places"], "pos": ["geo"], "wal": ["ev"]}


def statement(relations: str, body: str) -> str:
    """A statement over relations (names separated by spaces), which come before it as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for name in relations.split():
        need(name)
    head = ", ".join(f"{n} AS ({RELATIONS[n]})" for n in order)
    body = body.strip()
    if not head:
        return body
    return f"WITH RECURSIVE {head}{'' if body.startswith(',') else ' '}{body}"

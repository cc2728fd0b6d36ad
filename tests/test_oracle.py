"""Every query with a statement gives the same rows as DuckDB on the same small tables."""

import glob
import os

import duckdb
import pytest

from keyloom.plans import registry

SF = "/root/testdata/sf0.001"
#: Vector search at this size takes the driver's element list; the rest are all.
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(rows):
    def one(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, int | float) or type(v).__name__ == "Decimal":
            return f"{float(v):.6f}"
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_statement(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    mine = got.select(*columns).collect()
    theirs = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert canonical(mine) == canonical(theirs)


#: Queries that SQL can't express, and what their rows must be like; plain versions are in test_operators.
LAWS = {
    "randomkey": lambda rows: len(rows) == 1 and rows[0].key.startswith("cust:"),
    "digest": lambda rows: len(rows) > 50 and all(len(r.digest) == 16 for r in rows),
    "lcs": lambda rows: len(rows) == 200 and all(r.length == len(r.common.encode()) for r in rows),
    "lcs_idx": lambda rows: len(rows) == 200 and all(x.n == x.a_last - x.a_first + 1 == x.b_last - x.b_first + 1 >= 2 for r in rows for x in r.ranges),
    "lsh_candidates": lambda rows: len({tuple(r) for r in rows}) == len(rows) and {r.element for r in rows if r.query == r.element} == {r.query for r in rows},
    "lsh_search": lambda rows: all(r.score >= 0.7 for r in rows) and len({r.query for r in rows}) >= 5,
    "topk_add": lambda rows: len(rows) == 1000 and any(r.expelled for r in rows),
    "slot_owners": lambda rows: all(0 <= r.slot < 16384 and r.owner == "abc"[r.slot * 3 // 16384] for r in rows),
    "shard_stats": lambda rows: sum(r.keys for r in rows) == 116,
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_statement(spark, name):
    assert LAWS[name](registry.queries()[name](spark, SF).collect())

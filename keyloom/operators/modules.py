"""Small module families: id counters, sessions and records, search dictionaries, slot ownership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .state import delete

SLOTS = 16_384


def snowflake_next(requests: DataFrame) -> DataFrame:
    """key, seq, id: a counter for each key."""
    return requests.select("key", "seq", F.row_number().over(Window.partitionBy("key").orderBy("seq")).cast("bigint").alias("id"))


def snowflake_info(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count("*").alias("total"))


#: What the commands of the record modules do with a record of their first argument.
RECORDS = {
    "search": {"FT.CREATE": "set", "FT.ALTER": "set", "FT.ALIASADD": "set", "FT.ALIASUPDATE": "set", "FT.ALIASDEL": "del", "FT.DROPINDEX": "del", "FT.INFO": "info"},
    "graph": {"GRAPH.QUERY": "query", "GRAPH.RO_QUERY": "query", "GRAPH.DELETE": "del"},
    "sessions": {"SG.CREATE": "set", "SG.VALIDATE": "has", "SG.DELETE": "del"},
    "rede": {"REDE.CREATE": "set", "REDE.GET": "get", "REDE.DELETE": "del"},
    "scripts": {"JS.GET": "get", "JS.SET": "set", "JS.DEL": "del"},
    "models": {
        "AI.TENSORSET": "set", "AI.TENSORGET": "get", "AI.TENSORDEL": "del", "AI.MODELSET": "set", "AI.MODELSTORE": "set", "AI.MODELGET": "get", "AI.MODELDEL": "del", "AI.SCRIPTSET": "set", "AI.SCRIPTSTORE": "set",
        "AI.SCRIPTGET": "get", "AI.SCRIPTDEL": "del", "AI.INFO": "get",
    },
    "networks": {"NR.CREATE": "set", "NR.INFO": "get", "NR.DELETE": "del"},
    "gears": {"RG.PYEXECUTE": "run", "RG.JEXECUTE": "run", "RG.TRIGGER": "run", "RG.UNREGISTER": "del", "RG.ABORTEXECUTION": "del"},
    "series": {"TS.CREATE": "set", "TS.ALTER": "set", "TS.CREATERULE": "set", "TS.DELETERULE": "set"},
    "streams": {"XSETID": "set", "XGROUP CREATE": "set", "XGROUP SETID": "set"},
}
_WRITES = ("set", "query", "run", "del")


def _roles(requests: DataFrame, family: str) -> DataFrame:
    """requests with role, what each command does, and key, its record's name: the first argument, or of a run its id."""
    pairs = F.create_map(*[F.lit(x) for pair in RECORDS[family].items() for x in pair])
    rows = requests.withColumn("role", F.element_at(pairs, F.upper("command"))).filter("role IS NOT NULL")
    return rows.withColumn("key", F.when(F.col("role") == "run", F.concat(F.lit("exec-"), F.col("seq").cast("string"))).otherwise(F.get("args", 0)))


def record_replies(requests: DataFrame, family: str) -> DataFrame:
    """seq, command, key, reply (JSON text) of requests (seq, command, args): a record holds the arguments of the last
    command that set it. Each reply follows from the last write before it, by a window over the key's requests."""
    rows = _roles(requests, family)
    write = F.when(F.col("role").isin(*_WRITES), F.struct((F.col("role") != "del").alias("here"), F.col("args").alias("args")))
    before = F.last(write, ignorenulls=True).over(Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before)
    here = F.coalesce(F.col("before.here"), F.lit(False))
    held, role = F.when(here, F.col("before.args")), F.col("role")
    key = F.to_json(F.array("key"))
    name = F.substring(key, F.lit(2), F.length(key) - 2)
    reply = (
        F.when(role == "set", '"OK"').when(role == "get", F.coalesce(F.to_json(held), F.lit("[]"))).when(role.isin("del", "has"), here.cast("int").cast("string")).when(role == "run", name)
        .when(role == "query", '[[],[],["Query internal execution time: 0 ms"]]')
        .when(role == "info", F.concat(F.lit('["index_name",'), name, F.lit(',"num_docs",0,"num_fields",'), F.coalesce(F.size(held), F.lit(0)).cast("string"), F.lit("]")))
    )
    return rows.select("seq", "command", "key", reply.alias("reply"))


def records(requests: DataFrame, family: str) -> DataFrame:
    """key, args of the records after all requests: an aggregate that combines on the map side (FT._LIST, GRAPH.LIST,
    AI._MODELSCAN, AI._SCRIPTSCAN, RG.DUMP... list the keys)."""
    writes = _roles(requests, family).filter(F.col("role").isin(*_WRITES))
    last = writes.groupBy("key").agg(F.max_by(F.struct("role", "args"), "seq").alias("r"))
    return last.filter("r.role <> 'del'").select("key", "r.args")


def hits(log: DataFrame) -> DataFrame:
    """key, hits of observations (NR.OBSERVE, NR.TRAIN)."""
    return log.groupBy("key").agg(F.count("*").alias("hits"))


def dict_add(terms: DataFrame, delta: DataFrame) -> DataFrame:
    """Search dictionaries (key, term) with terms added (FT.DICTADD, SUGADD, SYNUPDATE)."""
    return terms.unionByName(delta).distinct()


def dict_del(terms: DataFrame, gone: DataFrame) -> DataFrame:
    return delete(terms, gone, ["key", "term"])


def dict_dump(terms: DataFrame, key: str) -> DataFrame:
    """All terms (DICTDUMP, SUGGET whatever the prefix, SPELLCHECK, SYNDUMP, TAGVALS)."""
    return terms.filter(F.col("key") == key).select("term")


def owners(keys: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """key, slot, owner: slots go to nodes in even runs."""
    slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS)).cast("int")
    owner = F.element_at(F.lit(list(nodes)), (F.floor(F.col("slot") * len(nodes) / SLOTS) + 1).cast("int"))
    return keys.select("key", slot.alias("slot")).withColumn("owner", owner)


def evictable(resident: DataFrame, acks: DataFrame) -> DataFrame:
    """Entries that may go: those whose copy was acknowledged at their version or later."""
    acked = acks.groupBy("key").agg(F.max("version").alias("acked"))
    return resident.join(acked, "key").filter(F.col("acked") >= F.col("version")).drop("acked")


def sessions(kv: DataFrame) -> DataFrame:
    """session, chunk of keys s:<session>:c:<chunk>, with the rest: partition by session to keep it together."""
    at = r"^s:([^:]*):c:(.*)$"
    return kv.filter(F.col("key").rlike(at)).select(F.regexp_extract("key", at, 1).alias("session"), F.regexp_extract("key", at, 2).alias("chunk"), *[c for c in kv.columns if c != "key"])

"""Commands of the control plane: requests answered by a table of rules, and reports over the keyspace.

A request is a row (id, command, args); its reply is JSON text, or an error. A rule holds for a command whose first
arguments are given words (in any case) and whose number of arguments is within bounds; the first that fits answers. The
table is small and fixed, so it goes to all tasks and requests need no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MANY = 1 << 20
_PEER = '["server","keyloom","version","1","proto",{proto},"id",0,"mode","standalone","role","master","modules",[]]'
_ENGINES = '["running_script",null,"engines",["LUA",["libraries_count",0,"functions_count",0]]]'
_USER = '["flags",["on","allkeys","allchannels","nopass"],"passwords",[],"commands","+@all","keys","~*","channels","&*"]'
_PLAN, _RANGE, _SYNTAX = '"EMPTY PLAN"', "ERR DB index is out of range", "ERR syntax error"
_WORDS = "ERR unknown {0} subcommand or wrong number of arguments"


def _rule(command: str, form: str, text: str = "", words: tuple[str, ...] = (), least: int = 0, most: int = _MANY, at: int = 0) -> dict:
    return {"command": command, "words": list(words), "least": max(least, len(words)), "most": max(most, len(words)), "form": form, "text": text, "at": at}


def _says(command: str, text: str, *words: str, extra: tuple[int, int] = (0, 0)) -> dict:
    """A fixed reply to the words, and as many arguments after them as `extra` allows."""
    return _rule(command, "json", text, words, len(words) + extra[0], len(words) + extra[1])


def _refuses(command: str, text: str, *words: str, extra: tuple[int, int] = (0, _MANY)) -> dict:
    return _rule(command, "error", text, words, len(words) + extra[0], len(words) + extra[1])


def _rules() -> list[dict]:
    any_, one, two = (0, _MANY), (1, 1), (2, 2)
    out = [
        _says("PING", '"PONG"'), _rule("PING", "echo", least=1, most=1), _rule("ECHO", "echo", least=1, most=1), _says("AUTH", '"OK"', extra=(1, 2)), _says("SELECT", '"OK"', "0"), _refuses("SELECT", _RANGE, extra=one),
        _says("QUIT", '"OK"', extra=any_), _says("RESET", '"RESET"'), _says("ASKING", '"OK"', extra=any_), _says("READONLY", '"OK"', extra=any_), _says("READWRITE", '"OK"', extra=any_), _says("UNWATCH", '"OK"'),
    ]
    for words, proto in ((("2",), 2), (("3",), 3), ((), 2)):
        for options, extra in ((("SETNAME",), one), (("AUTH",), two), ((), (0, 0))):
            out.append(_says("HELLO", _PEER.format(proto=proto), *words, *options, extra=extra))
    out += [_refuses("HELLO", _SYNTAX, w, extra=(1, _MANY)) for w in ("2", "3")] + [_refuses("HELLO", _SYNTAX, w) for w in ("AUTH", "SETNAME")] + [_refuses("HELLO", "NOPROTO unsupported protocol version", extra=(1, _MANY))]
    client = "id=0 addr=127.0.0.1:0 name= db=0 flags=N resp=2 lib-name= lib-ver= cmd=client|info"
    out += [_says("CLIENT", "null", "GETNAME"), _says("CLIENT", '"OK"', "SETNAME", extra=one), _says("CLIENT", "0", "ID"), _says("CLIENT", f'"{client}"', "INFO"), _says("CLIENT", '""', "LIST"), _says("CLIENT", "0", "KILL", extra=any_), _says("CLIENT", '"OK"', extra=any_)]
    for c in ("CONFIG", "FT.CONFIG", "GRAPH.CONFIG", "AI.CONFIG"):
        out += [_says(c, "[]", "GET", extra=any_), _says(c, '"OK"', extra=any_)]
    out += [
        _says("SAVE", '"OK"', extra=any_), _says("BGSAVE", '"Background saving started"', extra=any_), _says("BGREWRITEAOF", '"Background append only file rewriting started"', extra=any_), _rule("LASTSAVE", "now", most=0),
        _says("SWAPDB", '"OK"', "0", "0"), _refuses("SWAPDB", _RANGE, extra=two), _says("WAIT", "0", extra=two), _refuses("MOVE", "ERR source and destination objects are the same", "*", "0", extra=(0, 0)), _says("MOVE", "0", extra=two),
        _says("SLOWLOG", "0", "LEN"), _says("SLOWLOG", "[]", "GET", extra=(0, 1)), _says("SLOWLOG", '"OK"', "RESET"), _says("SLOWLOG", '["SLOWLOG GET [count]","SLOWLOG LEN","SLOWLOG RESET"]', "HELP"), _refuses("SLOWLOG", _WORDS.format("SLOWLOG")),
        _says("LATENCY", "[]", "LATEST"), _says("LATENCY", "[]", "HISTORY"), _says("LATENCY", "0", "RESET"), _refuses("LATENCY", _WORDS.format("LATENCY")), _says("LOLWUT", '"keyloom\\n"', extra=any_), _says("REPLCONF", '"OK"', extra=any_),
        _says("REPLICAOF", '"OK"', "NO", "ONE"), _refuses("REPLICAOF", "ERR replication is not supported", extra=two), _says("ROLE", '["master",0,[]]'), _refuses("CLUSTER", "ERR This instance has cluster support disabled", extra=(1, _MANY)),
        _says("DEBUG", '["DEBUG HELP","DEBUG is limited"]', "HELP"), _refuses("DEBUG", "ERR DEBUG command is disabled", extra=(1, _MANY)), _says("MODULE", "[]", "LIST"), *[_refuses("MODULE", "ERR modules can't be loaded", w) for w in ("LOAD", "LOADEX", "UNLOAD")], _refuses("MODULE", _WORDS.format("MODULE")),
        _refuses("PSYNC", "ERR PSYNC replication is not supported", extra=two), *[_refuses(c, f"ERR {c} is not supported") for c in ("FAILOVER", "MIGRATE", "MONITOR", "SYNC", "SHUTDOWN")], *[_refuses(c, "ERR possible SECURITY ATTACK detected. This command is not accepted.") for c in ("HOST:", "POST")],
        _rule("WAITAOF", "waitaof", least=3, most=3), _says("HOTKEYS", '"OK"', "START", extra=any_), _says("HOTKEYS", '"OK"', "STOP"), _says("HOTKEYS", '"OK"', "RESET"), _says("HOTKEYS", "[]", "GET", extra=any_), _says("PFSELFTEST", '"OK"', extra=any_), _says("PFDEBUG", '"constant"', "ENCODING", extra=one),
        _says("OBJECT", "1", "REFCOUNT", extra=one), _says("OBJECT", "0", "IDLETIME", extra=one), _refuses("OBJECT", "ERR An LFU maxmemory policy is not selected", "FREQ", extra=one),
        _says("ACL", '"default"', "WHOAMI", extra=any_), _says("ACL", '["user default on nopass ~* &* +@all"]', "LIST", extra=any_), _says("ACL", '["default"]', "USERS", extra=any_), _says("ACL", "[]", "CAT", extra=one), _says("ACL", _USER, "GETUSER", "DEFAULT"), _says("ACL", "null", "GETUSER", extra=one),
        _refuses("ACL", "ERR wrong number of arguments for 'acl|getuser' command", "GETUSER"), _says("ACL", '"OK"', "SETUSER", extra=any_), _says("ACL", "0", "DELUSER", extra=any_), *[_refuses("ACL", "ERR This instance is not configured to use an ACL file.", w) for w in ("LOAD", "SAVE")], _refuses("ACL", "ERR Unknown ACL subcommand or wrong number of arguments", extra=(1, _MANY)),
        _says("PUBLISH", "0", extra=two), _says("SPUBLISH", "0", extra=two), *[_says("PUBSUB", "[]", w, extra=(0, 1)) for w in ("CHANNELS", "SHARDCHANNELS")], _says("PUBSUB", "0", "NUMPAT"), *[_rule("PUBSUB", "counts", words=(w,), at=1) for w in ("NUMSUB", "SHARDNUMSUB")], _refuses("PUBSUB", _WORDS.format("PUBSUB"), extra=(1, _MANY)),
        *[_rule(c, "acks", c.lower(), least=1, at=1) for c in ("SUBSCRIBE", "PSUBSCRIBE", "SSUBSCRIBE")], *[_says(c, f'["{c.lower()}",null,0]') for c in ("UNSUBSCRIBE", "PUNSUBSCRIBE", "SUNSUBSCRIBE")], *[_rule(c, "acks", c.lower(), least=1, at=0) for c in ("UNSUBSCRIBE", "PUNSUBSCRIBE", "SUNSUBSCRIBE")],
        _says("XPENDING", "[0,null,null,[]]", extra=two), _says("XPENDING", "[]", extra=(5, 6)), _says("XCLAIM", "[]", extra=(5, _MANY)), _says("XAUTOCLAIM", '["0-0",[]]', extra=(5, _MANY)), _says("XACK", "0", extra=(3, _MANY)),
        _says("XGROUP", "0", "DESTROY", extra=two), _says("XGROUP", "0", "DELCONSUMER", extra=(3, 3)), _says("XGROUP", "1", "CREATECONSUMER", extra=(3, 3)), _says("XINFO", "[]", "GROUPS", extra=one), _says("XINFO", "[]", "CONSUMERS", extra=two),
        _says("FUNCTION", "[]", "LIST", extra=any_), _says("FUNCTION", _ENGINES, "STATS"), _says("FUNCTION", '""', "DUMP"), *[_says("FUNCTION", '"OK"', "FLUSH", *m) for m in ((), ("ASYNC",), ("SYNC",))], _refuses("FUNCTION", _SYNTAX, "FLUSH", extra=one), _refuses("FUNCTION", "ERR Library not found", "DELETE", extra=one),
        _refuses("FUNCTION", "NOTBUSY No scripts in execution right now.", "KILL", extra=(0, 0)), _refuses("FUNCTION", "ERR FUNCTION LOAD is not supported", "LOAD", extra=(1, 2)), _refuses("FUNCTION", _WORDS.format("FUNCTION"), extra=(1, _MANY)), *[_refuses(c, "ERR Function not found", extra=(2, _MANY)) for c in ("FCALL", "FCALL_RO")],
        *[_says(c, '"OK"', extra=(1, _MANY)) for c in ("BF.RESERVE", "CF.RESERVE", "BF.LOADCHUNK", "CF.LOADCHUNK", "CMS.INITBYDIM", "CMS.INITBYPROB", "TOPK.RESERVE", "TDIGEST.CREATE", "TDIGEST.RESET", "R.OPTIMIZE", "R64.OPTIMIZE")], *[_says(c, "[0,null]", extra=(1, _MANY)) for c in ("BF.SCANDUMP", "CF.SCANDUMP")],
        *[_says(c, "[0]", extra=any_) for c in ("FT.SEARCH", "FT.AGGREGATE", "FT.HYBRID")], *[_says(c, _PLAN, extra=any_) for c in ("FT.EXPLAIN", "FT.EXPLAINCLI", "FT.PROFILE")], *[_rule(c, "echoes", least=2, at=1) for c in ("GRAPH.EXPLAIN", "GRAPH.PROFILE")],
        *[_says(c, "[]", extra=any_) for c in ("FT.CURSOR", "GRAPH.SLOWLOG", "AI.MODELRUN", "AI.MODELEXECUTE", "AI.SCRIPTRUN", "AI.SCRIPTEXECUTE", "AI.DAGRUN", "AI.DAGRUN_RO", "AI.DAGEXECUTE", "NR.RUN", "RG.GETRESULTS", "RG.GETRESULTSBLOCKING", "RG.PYSTATS", "RG.CONFIGGET")], _says("RG.CONFIGSET", '"OK"', extra=any_), _says("JS.EVAL", '"null"', extra=any_),
    ]
    return out


def commands(spark: SparkSession) -> DataFrame:
    """command, forms: the commands that rules answer, and how many rules each has (COMMAND LIST, COMMAND COUNT)."""
    names = [r["command"] for r in _rules()]
    return spark.createDataFrame([(c, names.count(c)) for c in sorted(set(names))], "command string, forms int")


def _text(value: Column) -> Column:
    whole = F.to_json(F.array(value))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _listed(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def answer(requests: DataFrame) -> DataFrame:
    """id, command, reply (JSON text), error of requests (id, command, args); a command that no rule knows is an error."""
    kind = "command string, words array<string>, least int, most int, form string, text string, at int"
    rules = requests.sparkSession.createDataFrame([tuple(r[c.split()[0]] for c in kind.split(", ")) + (i,) for i, r in enumerate(_rules())], f"{kind}, place int")
    table = rules.groupBy("command").agg(F.sort_array(F.collect_list(F.struct("place", "words", "least", "most", "form", "text", "at"))).alias("rules")).withColumnRenamed("command", "known")
    rows = requests.select("id", "command", F.coalesce("args", F.array().cast("array<string>")).alias("args")).join(F.broadcast(table), F.upper("command") == F.col("known"), "left")
    n, args = F.size("args"), F.col("args")

    def fits(r: Column) -> Column:
        said = F.zip_with(r["words"], F.slice(args, F.lit(1), F.greatest(F.size(r["words"]), F.lit(1))), lambda w, a: F.coalesce((w == "*") | (w == F.upper(a)), F.lit(False)) | w.isNull())
        return (n >= r["least"]) & (n <= r["most"]) & ((F.size(r["words"]) == 0) | F.forall(said, lambda x: x))

    rule = F.get(F.filter("rules", fits), 0)
    rows = rows.withColumn("rule", rule)
    form, at = F.col("rule.form"), F.col("rule.at")
    rest = F.slice(args, F.greatest(at, F.lit(0)) + 1, F.greatest(n - at, F.lit(0)))
    ack = F.transform(args, lambda a, i: F.concat(F.lit('["'), F.col("rule.text"), F.lit('",'), _text(a), F.lit(","), F.when(at == 1, i + 1).otherwise(0).cast("string"), F.lit("]")))
    numbers = F.transform(args, lambda a: a.try_cast("bigint"))
    wait = F.when(F.exists(numbers, lambda x: x.isNull()), "ERR value is not an integer or out of range").when(~F.get(numbers, 0).between(0, 1), "ERR WAITAOF numlocal value should be 0 or 1.")
    wait = wait.when(F.get(numbers, 0) == 1, "ERR WAITAOF cannot be used when numlocal is set but appendonly is disabled.")
    reply = (
        F.when(form == "json", F.col("rule.text")).when(form == "echo", _text(F.get(args, 0))).when(form == "echoes", F.concat(F.lit("["), _text(F.get(args, at)), F.lit("]"))).when(form == "now", F.unix_timestamp().cast("string"))
        .when(form == "counts", _listed(F.transform(rest, lambda a: F.concat(_text(a), F.lit(",0"))))).when((form == "acks") & (n == 1), F.get(ack, 0)).when(form == "acks", _listed(ack)).when((form == "waitaof") & wait.isNull(), "[0,0]")
    )
    error = F.when(F.col("known").isNull(), F.concat(F.lit("ERR unknown command '"), F.col("command"), F.lit("'"))).when(form.isNull(), F.concat(F.lit("ERR wrong number of arguments for '"), F.lower("command"), F.lit("' command")))
    error = error.when(form == "error", F.col("rule.text")).when(form == "waitaof", wait)
    return rows.select("id", "command", reply.alias("reply"), error.alias("error"))


def server_time(spark: SparkSession) -> DataFrame:
    now = F.unix_micros(F.current_timestamp())
    return spark.range(1).select(F.floor(now / 1_000_000).alias("seconds"), F.pmod(now, F.lit(1_000_000)).alias("micros"))


def hot_keys(log: DataFrame, k: int) -> DataFrame:
    """key, hits: the k keys that a log names most."""
    return log.groupBy("key").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "key").limit(k)


def info(keys: DataFrame) -> DataFrame:
    return keys.groupBy("type").agg(F.count("*").alias("keys"))


def memory_usage(kv: DataFrame) -> DataFrame:
    """key, bytes: of key and value."""
    return kv.select("key", (F.octet_length("key") + F.octet_length("value")).alias("bytes"))


def stats(kv: DataFrame, shards: int = 16) -> DataFrame:
    """shard, keys, bytes: keys are routed by hash."""
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")
    return kv.groupBy(shard).agg(F.count("*").alias("keys"), F.sum(F.octet_length("value")).alias("bytes"))

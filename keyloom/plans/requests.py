"""Requests of the control plane with what they are to get: (command, arguments, reply as JSON text, error)."""

from __future__ import annotations

_NO, _OK = None, '"OK"'
_PEER = '["server","keyloom","version","1","proto",{},"id",0,"mode","standalone","role","master","modules",[]]'


def _arity(command: str) -> str:
    return f"ERR wrong number of arguments for '{command.lower()}' command"


CASES = {
    "connection": [
        ("PING", (), '"PONG"', _NO), ("ping", ("a \"b\"",), '"a \\"b\\""', _NO), ("PING", ("a", "b"), _NO, _arity("ping")), ("ECHO", ("é\n",), '"é\\n"', _NO), ("ECHO", (), _NO, _arity("echo")), ("AUTH", ("secret",), _OK, _NO), ("SELECT", ("0",), _OK, _NO),
        ("SELECT", ("7",), _NO, "ERR DB index is out of range"), ("QUIT", (), _OK, _NO), ("RESET", (), '"RESET"', _NO), ("HELLO", (), _PEER.format(2), _NO), ("HELLO", ("3",), _PEER.format(3), _NO), ("HELLO", ("3", "setname", "x"), _PEER.format(3), _NO),
        ("HELLO", ("2", "AUTH", "u", "p"), _PEER.format(2), _NO), ("HELLO", ("4",), _NO, "NOPROTO unsupported protocol version"), ("HELLO", ("2", "what"), _NO, "ERR syntax error"), ("ASKING", (), _OK, _NO), ("READONLY", (), _OK, _NO), ("READWRITE", (), _OK, _NO), ("UNWATCH", (), _OK, _NO),
        ("CLIENT", ("GETNAME",), "null", _NO), ("CLIENT", ("SETNAME", "me"), _OK, _NO), ("CLIENT", ("id",), "0", _NO), ("CLIENT", ("INFO",), '"id=0 addr=127.0.0.1:0 name= db=0 flags=N resp=2 lib-name= lib-ver= cmd=client|info"', _NO), ("CLIENT", ("LIST",), '""', _NO),
        ("CLIENT", ("KILL", "ID", "3"), "0", _NO), ("CLIENT", ("PAUSE", "1"), _OK, _NO), ("NOSUCH", ("x",), _NO, "ERR unknown command 'NOSUCH'"),
    ],
    "server": [
        ("CONFIG", ("GET", "*"), "[]", _NO), ("CONFIG", ("SET", "a", "b"), _OK, _NO), ("SAVE", (), _OK, _NO), ("BGSAVE", (), '"Background saving started"', _NO), ("BGREWRITEAOF", (), '"Background append only file rewriting started"', _NO), ("LASTSAVE", ("x",), _NO, _arity("lastsave")),
        ("SWAPDB", ("0", "0"), _OK, _NO), ("SWAPDB", ("0", "1"), _NO, "ERR DB index is out of range"), ("WAIT", ("1", "0"), "0", _NO), ("WAIT", ("1",), _NO, _arity("wait")), ("WAITAOF", ("0", "1", "5"), "[0,0]", _NO),
        ("WAITAOF", ("1", "0", "0"), _NO, "ERR WAITAOF cannot be used when numlocal is set but appendonly is disabled."), ("WAITAOF", ("2", "0", "0"), _NO, "ERR WAITAOF numlocal value should be 0 or 1."), ("WAITAOF", ("0", "x", "0"), _NO, "ERR value is not an integer or out of range"),
        ("SLOWLOG", ("LEN",), "0", _NO), ("SLOWLOG", ("GET", "5"), "[]", _NO), ("SLOWLOG", ("RESET",), _OK, _NO), ("SLOWLOG", ("what",), _NO, "ERR unknown SLOWLOG subcommand or wrong number of arguments"), ("LATENCY", ("LATEST",), "[]", _NO), ("LATENCY", ("RESET",), "0", _NO),
        ("LOLWUT", (), '"keyloom\\n"', _NO), ("ROLE", (), '["master",0,[]]', _NO), ("REPLCONF", ("a", "b"), _OK, _NO), ("REPLICAOF", ("no", "one"), _OK, _NO), ("REPLICAOF", ("host", "1"), _NO, "ERR replication is not supported"), ("MOVE", ("k", "0"), _NO, "ERR source and destination objects are the same"),
        ("MOVE", ("k", "1"), "0", _NO), ("HOTKEYS", ("START",), _OK, _NO), ("HOTKEYS", ("GET",), "[]", _NO), ("HOTKEYS", ("what",), _NO, _arity("hotkeys")), ("OBJECT", ("REFCOUNT", "k"), "1", _NO), ("OBJECT", ("IDLETIME", "k"), "0", _NO), ("PFSELFTEST", (), _OK, _NO),
        ("PFDEBUG", ("ENCODING", "k"), '"constant"', _NO), ("DEBUG", ("HELP",), '["DEBUG HELP","DEBUG is limited"]', _NO), ("DEBUG", ("SLEEP", "1"), _NO, "ERR DEBUG command is disabled"), ("MODULE", ("LIST",), "[]", _NO), ("MODULE", ("LOAD", "x"), _NO, "ERR modules can't be loaded"),
    ],
    "acl": [
        ("ACL", ("WHOAMI",), '"default"', _NO), ("ACL", ("USERS",), '["default"]', _NO), ("ACL", ("LIST",), '["user default on nopass ~* &* +@all"]', _NO), ("ACL", ("CAT", "read"), "[]", _NO), ("ACL", ("getuser", "nobody"), "null", _NO),
        ("ACL", ("GETUSER", "Default"), '["flags",["on","allkeys","allchannels","nopass"],"passwords",[],"commands","+@all","keys","~*","channels","&*"]', _NO), ("ACL", ("GETUSER",), _NO, "ERR wrong number of arguments for 'acl|getuser' command"), ("ACL", ("SETUSER", "x", "on"), _OK, _NO),
        ("ACL", ("DELUSER", "x"), "0", _NO), ("ACL", ("SAVE",), _NO, "ERR This instance is not configured to use an ACL file."), ("ACL", ("what",), _NO, "ERR Unknown ACL subcommand or wrong number of arguments"), ("ACL", (), _NO, _arity("acl")),
    ],
    "refused": [
        ("CLUSTER", ("INFO",), _NO, "ERR This instance has cluster support disabled"), ("CLUSTER", (), _NO, _arity("cluster")), ("PSYNC", ("a", "b"), _NO, "ERR PSYNC replication is not supported"), ("PSYNC", ("a",), _NO, _arity("psync")),
        *[(c, ("x",), _NO, f"ERR {c} is not supported") for c in ("FAILOVER", "MIGRATE", "MONITOR", "SYNC", "SHUTDOWN")], *[(c, ("x",), _NO, "ERR possible SECURITY ATTACK detected. This command is not accepted.") for c in ("HOST:", "POST")],
    ],
    "pubsub": [
        ("PUBLISH", ("c", "m"), "0", _NO), ("PUBLISH", ("c",), _NO, _arity("publish")), ("SPUBLISH", ("c", "m"), "0", _NO), ("PUBSUB", ("CHANNELS", "a*"), "[]", _NO), ("PUBSUB", ("NUMPAT",), "0", _NO), ("PUBSUB", ("NUMSUB", "a", "b"), '["a",0,"b",0]', _NO), ("PUBSUB", ("SHARDNUMSUB",), "[]", _NO),
        ("PUBSUB", (), _NO, _arity("pubsub")), ("SUBSCRIBE", ("a",), '["subscribe","a",1]', _NO), ("SUBSCRIBE", ("a", "b"), '[["subscribe","a",1],["subscribe","b",2]]', _NO), ("SUBSCRIBE", (), _NO, _arity("subscribe")), ("PSUBSCRIBE", ("a*",), '["psubscribe","a*",1]', _NO),
        ("SSUBSCRIBE", ("a",), '["ssubscribe","a",1]', _NO), ("UNSUBSCRIBE", (), '["unsubscribe",null,0]', _NO), ("UNSUBSCRIBE", ("a", "b"), '[["unsubscribe","a",0],["unsubscribe","b",0]]', _NO), ("PUNSUBSCRIBE", ("a*",), '["punsubscribe","a*",0]', _NO), ("SUNSUBSCRIBE", ("a",), '["sunsubscribe","a",0]', _NO),
    ],
    "groups": [
        ("XPENDING", ("k", "g"), "[0,null,null,[]]", _NO), ("XPENDING", ("k", "g", "-", "+", "9"), "[]", _NO), ("XPENDING", ("k",), _NO, _arity("xpending")), ("XCLAIM", ("k", "g", "c", "0", "1-1"), "[]", _NO), ("XCLAIM", ("k", "g"), _NO, _arity("xclaim")),
        ("XAUTOCLAIM", ("k", "g", "c", "0", "0"), '["0-0",[]]', _NO), ("XACK", ("k", "g", "1-1"), "0", _NO), ("XGROUP", ("DESTROY", "k", "g"), "0", _NO), ("XGROUP", ("CREATECONSUMER", "k", "g", "c"), "1", _NO), ("XGROUP", ("DELCONSUMER", "k", "g", "c"), "0", _NO),
        ("XINFO", ("GROUPS", "k"), "[]", _NO), ("XINFO", ("CONSUMERS", "k", "g"), "[]", _NO),
    ],
    "functions": [
        ("FUNCTION", ("LIST",), "[]", _NO), ("FUNCTION", ("STATS",), '["running_script",null,"engines",["LUA",["libraries_count",0,"functions_count",0]]]', _NO), ("FUNCTION", ("DUMP",), '""', _NO), ("FUNCTION", ("FLUSH", "async"), _OK, _NO), ("FUNCTION", ("FLUSH", "x"), _NO, "ERR syntax error"),
        ("FUNCTION", ("DELETE", "x"), _NO, "ERR Library not found"), ("FUNCTION", ("KILL",), _NO, "NOTBUSY No scripts in execution right now."), ("FUNCTION", ("LOAD", "x"), _NO, "ERR FUNCTION LOAD is not supported"), ("FCALL", ("f", "0"), _NO, "ERR Function not found"), ("FCALL_RO", ("f", "0"), _NO, "ERR Function not found"),
    ],
    "filters": [*[(c, ("k", "10"), _OK, _NO) for c in ("BF.RESERVE", "CF.RESERVE", "BF.LOADCHUNK", "CF.LOADCHUNK", "CMS.INITBYDIM", "CMS.INITBYPROB", "TOPK.RESERVE", "TDIGEST.CREATE", "TDIGEST.RESET", "R.OPTIMIZE", "R64.OPTIMIZE")], ("BF.SCANDUMP", ("k", "0"), "[0,null]", _NO), ("CF.SCANDUMP", ("k", "0"), "[0,null]", _NO), ("BF.RESERVE", (), _NO, _arity("bf.reserve"))],
    "search": [
        *[(c, ("i", "q"), "[0]", _NO) for c in ("FT.SEARCH", "FT.AGGREGATE", "FT.HYBRID")], *[(c, ("i", "q"), '"EMPTY PLAN"', _NO) for c in ("FT.EXPLAIN", "FT.EXPLAINCLI", "FT.PROFILE")], ("FT.CURSOR", ("READ", "i", "1"), "[]", _NO), ("FT.CONFIG", ("GET", "*"), "[]", _NO), ("FT.CONFIG", ("SET", "a", "b"), _OK, _NO),
    ],
    "graph": [("GRAPH.EXPLAIN", ("g", "MATCH (n) RETURN n"), '["MATCH (n) RETURN n"]', _NO), ("GRAPH.PROFILE", ("g", "q"), '["q"]', _NO), ("GRAPH.EXPLAIN", ("g",), _NO, _arity("graph.explain")), ("GRAPH.SLOWLOG", ("g",), "[]", _NO), ("GRAPH.CONFIG", ("GET", "*"), "[]", _NO), ("GRAPH.CONFIG", ("SET", "a", "1"), _OK, _NO)],
    "models": [*[(c, ("m", "x"), "[]", _NO) for c in ("AI.MODELRUN", "AI.MODELEXECUTE", "AI.SCRIPTRUN", "AI.SCRIPTEXECUTE", "AI.DAGRUN", "AI.DAGRUN_RO", "AI.DAGEXECUTE", "NR.RUN")], ("AI.CONFIG", ("GET", "x"), "[]", _NO), ("AI.CONFIG", ("LOADBACKEND", "x"), _OK, _NO), ("JS.EVAL", ("1+1",), '"null"', _NO)],
    "gears": [*[(c, ("x",), "[]", _NO) for c in ("RG.GETRESULTS", "RG.GETRESULTSBLOCKING", "RG.PYSTATS", "RG.CONFIGGET")], ("RG.CONFIGSET", ("a", "b"), _OK, _NO)],
}

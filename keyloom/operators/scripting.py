"""A small script language compiled to columns: calls, then one `return` of a literal, KEYS[i], ARGV[i], tonumber(...), a
table of these, or a call. Calls read and write a map of values that was joined before. Scripts are cached by their SHA-1."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKENS = re.compile(r"""\s*(?:(?P<str>"[^"]*"|'[^']*')|(?P<num>-?\d+(?:\.\d+)?)|(?P<name>[A-Za-z_][\w.]*)|(?P<sign>[{}(),;\[\]]))""")


class Scripts:
    """Scripts by SHA-1 (SCRIPT LOAD, EXISTS, FLUSH; EVALSHA)."""

    def __init__(self):
        self._texts: dict[str, str] = {}

    def load(self, text: str) -> str:
        sha = hashlib.sha1(text.encode()).hexdigest()
        self._texts[sha] = text
        return sha

    def exists(self, *shas: str) -> list[int]:
        return [int(s.lower() in self._texts) for s in shas]

    def flush(self) -> None:
        self._texts.clear()

    def evalsha(self, rows: DataFrame, sha: str) -> DataFrame:
        if sha.lower() not in self._texts:
            raise ValueError("NOSCRIPT No matching script")
        return evaluate(rows, self._texts[sha.lower()])


def compiled(text: str) -> tuple[Column, Column]:
    """The reply of a script, and the map of values after it, as columns over `keys` and `args` (arrays of strings) and
    `found` (a map of values by key). Calls run in the order they stand in, each on what the one before left."""
    body, tokens, at = text.strip(), [], 0
    while at < len(body):
        m = _TOKENS.match(body, at)
        if not m:
            raise ValueError(f"bad script at {body[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    state = [F.col("found")]

    def take(sign: str) -> None:
        if not tokens or tokens.pop(0)[1] != sign:
            raise ValueError(f"expected {sign}")

    def listed(end: str) -> list[Column]:
        out = []
        while tokens and tokens[0][1] != end:
            out.append(term())
            if tokens and tokens[0][1] == ",":
                tokens.pop(0)
        take(end)
        return out

    def call() -> Column:
        take("(")
        if not tokens or tokens[0][0] != "str":
            raise ValueError("a call needs the name of a command")
        name = tokens.pop(0)[1][1:-1].upper()
        if tokens and tokens[0][1] == ",":
            tokens.pop(0)
        args = listed(")")
        if name not in _CALLS or len(args) != _CALLS[name]:
            raise ValueError(f"{name} can't be called so")
        found = state[0]
        if name in ("PING", "ECHO"):
            return args[0] if args else F.lit("PONG")
        old = F.try_element_at(found, args[0])
        number = F.coalesce(old, F.lit("0")).try_cast("bigint")
        replies = {"GET": old, "EXISTS": old.isNotNull().cast("int").cast("string"), "STRLEN": F.coalesce(F.octet_length(old), F.lit(0)).cast("string"), "DEL": old.isNotNull().cast("int").cast("string"), "SET": F.lit("OK")}
        if name in ("GET", "EXISTS", "STRLEN"):
            return replies[name]
        new = {"SET": args[-1], "SETNX": F.coalesce(old, args[-1]), "GETSET": args[-1], "APPEND": F.concat(F.coalesce(old, F.lit("")), args[-1]), "DEL": None}.get(name)
        if name in _STEPS:
            by = F.lit(1) if name in ("INCR", "DECR") else args[1].try_cast("bigint")
            new = (number + by if name.startswith("INCR") else number - by).cast("string")
        rest = F.map_filter(found, lambda k, _: k != args[0])
        state[0] = rest if new is None else F.map_concat(rest, F.create_map(args[0], new))
        replies |= {"SETNX": old.isNull().cast("int").cast("string"), "GETSET": old, "APPEND": F.octet_length(new).cast("string") if new is not None else F.lit(None), **dict.fromkeys(_STEPS, new)}
        return replies[name]

    def term() -> Column:
        if not tokens:
            raise ValueError("a value is missing")
        kind, word = tokens.pop(0)
        if kind == "str":
            return F.lit(word[1:-1])
        if kind == "num":
            return F.lit(str(int(float(word))))
        if word == "{":
            return F.to_json(F.array(*[t.cast("string") for t in listed("}")]))
        if word in ("nil", "false"):
            return F.lit(None).cast("string")
        if word == "true":
            return F.lit("1")
        if word in ("KEYS", "ARGV"):
            take("[")
            i = int(tokens.pop(0)[1])
            take("]")
            return F.get("keys" if word == "KEYS" else "args", i - 1)
        if word == "tonumber":
            take("(")
            return listed(")")[0].try_cast("double").cast("bigint").cast("string")
        if word in ("redis.call", "redis.pcall"):
            return call()
        raise ValueError(f"unknown name {word}")

    reply = F.lit(None).cast("string")
    while tokens and tokens[0][1] != "return":
        if tokens[0][1] == ";":
            tokens.pop(0)
            continue
        if tokens.pop(0)[1] not in ("redis.call", "redis.pcall"):
            raise ValueError("only calls can stand before the return")
        call()
    if tokens:
        tokens.pop(0)
        if tokens and tokens[0][1] != ";":
            reply = term()
    if any(t[1] != ";" for t in tokens):
        raise ValueError("one value can be returned")
    return reply, state[0]


#: Commands that scripts can call, and how many arguments they take.
_CALLS = {"GET": 1, "EXISTS": 1, "STRLEN": 1, "DEL": 1, "SET": 2, "SETNX": 2, "GETSET": 2, "APPEND": 2, "INCR": 1, "DECR": 1, "INCRBY": 2, "DECRBY": 2, "ECHO": 1, "PING": 0}
_STEPS = ("INCR", "DECR", "INCRBY", "DECRBY")


def compile_script(text: str) -> Column:
    return compiled(text)[0]


def evaluate(rows: DataFrame, text: str) -> DataFrame:
    """rows (keys, args, found, ...) with the script's reply, and found as the script leaves it."""
    reply, found = compiled(text)
    return rows.select(*[found.alias(c) if c == "found" else F.col(c) for c in rows.columns], reply.alias("reply"))

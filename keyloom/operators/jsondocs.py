"""JSON documents as rows (key, doc), with one-level paths. Results are JSON text or numbers."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import json_field, json_get, json_type


def get(j: DataFrame, path: str = "$") -> DataFrame:
    return j.select("key", json_get(F.col("doc"), path).alias("value"))


def mget(j: DataFrame, probes: DataFrame, path: str) -> DataFrame:
    return probes.join(j, "key", "left").select("ord", "key", json_get(F.col("doc"), path).alias("value"))


def types(j: DataFrame, path: str = "$") -> DataFrame:
    return j.select("key", json_type(F.col("doc"), path).alias("type"))


def _at(j: DataFrame, path: str) -> Column:
    return json_get(F.col("doc"), path)


def objkeys(j: DataFrame, path: str = "$") -> DataFrame:
    return j.select("key", F.explode(F.json_object_keys(_at(j, path))).alias("field"))


def objlen(j: DataFrame, path: str = "$") -> DataFrame:
    n = F.size(F.json_object_keys(_at(j, path)))
    return j.select("key", F.coalesce(F.when(n >= 0, n), F.lit(0)).alias("n"))


def arrlen(j: DataFrame, path: str) -> DataFrame:
    return j.select("key", F.coalesce(F.json_array_length(_at(j, path)), F.lit(0)).alias("n"))


def arrindex(j: DataFrame, path: str, value: str) -> DataFrame:
    """key, position of a JSON value in an array, or -1."""
    parts = F.transform(F.from_json(_at(j, path), "array<variant>"), lambda v: F.to_json(v))
    return j.select("key", F.coalesce(F.array_position(parts, F.lit(value)) - 1, F.lit(-1)).cast("bigint").alias("at"))


def number(j: DataFrame, path: str, operand: float, multiply: bool = False) -> DataFrame:
    """key, value: JSON.NUMINCRBY and NUMMULTBY."""
    v = F.get_json_object("doc", f"$.{json_field(path)}").try_cast("double")
    return j.select("key", (v * operand if multiply else v + operand).alias("value"))


def strlen(j: DataFrame, path: str) -> DataFrame:
    v = F.get_json_object("doc", f"$.{json_field(path)}")
    kind = json_type(F.col("doc"), path)
    return j.select("key", F.when(kind == "string", F.octet_length(v)).when(kind.isNotNull(), 0).alias("n"))


def memory(j: DataFrame, path: str = "$") -> DataFrame:
    return j.select("key", F.octet_length(_at(j, path)).alias("bytes"))


# Writes. A document is taken apart into its fields and their JSON texts, one text is replaced, and the parts are put
# together again in the order they had. An operation that doesn't fit leaves the document and gives an error.
def _quoted(text: Column) -> Column:
    """A string as JSON."""
    whole = F.to_json(F.array(text))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def _parts(doc: Column) -> Column:
    """Array of (name, text) of an object's fields, null for other documents."""
    fields = F.map_entries(F.from_json(doc, "map<string,variant>"))
    return F.when(F.substring(F.ltrim(doc), 1, 1) == "{", F.transform(fields, lambda e: F.struct(e["key"].alias("name"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("text"))))


def _whole(parts: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda p: F.concat(_quoted(p["name"]), F.lit(":"), p["text"])), ","), F.lit("}"))


def _items(text: Column) -> Column:
    """Texts of an array's items, null for other values."""
    items = F.transform(F.from_json(text, "array<variant>"), lambda v: F.coalesce(F.to_json(v), F.lit("null")))
    return F.when(F.substring(text, 1, 1) == "[", items)


def _array(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def _json(value) -> Column:
    return F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False))


def change(j: DataFrame, path: str, how: Callable[[Column], Column], error: str, missing: str | None = None) -> DataFrame:
    """key, doc, reply, error: the text at a path given to `how`, which makes a struct of its new text and the reply, null
    where it doesn't fit; then the document stays and error says why. missing: the text a missing field counts as, or
    None: then nothing happens, and the reply is null."""
    name = json_field(path)
    if name is None:
        return j.select("key", "doc", F.lit(None).cast("string").alias("reply"), F.lit(None).cast("string").alias("error"))
    if name == "":
        rows = j.select("key", "doc", how(F.to_json(F.try_parse_json("doc"))).alias("r"), F.lit(True).alias("here"))
        return rows.select("key", F.coalesce("r.text", "doc").alias("doc"), "r.reply", F.when(F.col("r").isNull(), F.lit(error)).alias("error"))
    rows = j.select("key", "doc", _parts(F.col("doc")).alias("parts"))
    old = F.get(F.filter("parts", lambda p: p["name"] == name), 0)["text"]
    rows = rows.withColumn("old", old).withColumn("here", F.col("old").isNotNull())
    if missing is not None:
        rows = rows.withColumn("old", F.when(F.col("parts").isNotNull(), F.coalesce("old", F.lit(missing))))
    rows = rows.withColumn("r", F.when(F.col("old").isNotNull(), how(F.col("old"))))
    put = F.transform("parts", lambda p: F.struct(p["name"].alias("name"), F.when(p["name"] == name, F.col("r.text")).otherwise(p["text"]).alias("text")))
    put = F.when(F.col("here"), put).otherwise(F.concat("parts", F.array(F.struct(F.lit(name).alias("name"), F.col("r.text").alias("text")))))
    doc = F.when(F.col("r").isNotNull(), _whole(put)).otherwise(F.col("doc"))
    return rows.select("key", doc.alias("doc"), "r.reply", F.when(F.col("r").isNull() & F.col("old").isNotNull(), F.lit(error)).alias("error"))


def _made(text: Column, reply: Column) -> Column:
    return F.struct(text.alias("text"), reply.cast("string").alias("reply"))


def _on_array(j: DataFrame, path: str, new: Callable[[Column], Column], reply: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    def how(text: Column) -> Column:
        def with_items(items: Column) -> Column:
            made = new(items)
            return F.when(items.isNotNull(), _made(_array(made), F.size(made) if reply is None else reply(items, made)))

        return F.transform(F.array(_items(text)), with_items)[0]

    return change(j, path, how, "JSON path is not an array")


def arr_append(j: DataFrame, path: str, *values) -> DataFrame:
    return _on_array(j, path, lambda items: F.concat(items, F.array(*[_json(v) for v in values])))


def arr_insert(j: DataFrame, path: str, index: int, *values) -> DataFrame:
    """Values before an index, at the end beyond it; an index below 0 counts as 0."""
    at = max(index, 0)
    return _on_array(j, path, lambda items: F.concat(F.slice(items, 1, at) if at else F.slice(items, 1, 0), F.array(*[_json(v) for v in values]), F.slice(items, at + 1, F.greatest(F.size(items) - at, F.lit(0)))))


def arr_pop(j: DataFrame, path: str) -> DataFrame:
    """Without the last item, which is the reply; of an empty array null."""
    return _on_array(j, path, lambda items: F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))), lambda items, made: F.try_element_at(items, F.lit(-1)))


def arr_trim(j: DataFrame, path: str, start: int, stop: int) -> DataFrame:
    """Items start to stop, both included; a negative start counts as 0, a negative stop as start."""
    first = max(start, 0)
    last = first if stop < 0 else stop
    return _on_array(j, path, lambda items: F.slice(items, F.lit(first + 1), F.greatest(F.lit(last - first + 1), F.lit(0))))


def str_append(j: DataFrame, path: str, more: str) -> DataFrame:
    """A string with more at its end (quotes around it go); the reply is its length in bytes."""
    more = more.strip('"')

    def how(text: Column) -> Column:
        new = F.concat(F.try_variant_get(F.try_parse_json(text), "$", "string"), F.lit(more))
        return F.when(F.substring(text, 1, 1) == '"', _made(_quoted(new), F.octet_length(new)))

    return change(j, path, how, "JSON path is not a string")


def toggled(j: DataFrame, path: str) -> DataFrame:
    """A boolean turned round; the reply is 1 where it is true then."""

    def how(text: Column) -> Column:
        return F.when(text == "true", _made(F.lit("false"), F.lit(0))).when(text == "false", _made(F.lit("true"), F.lit(1)))

    return change(j, path, how, "JSON path is not a boolean")


def changed_number(j: DataFrame, path: str, operand: float, multiply: bool = False) -> DataFrame:
    """A number after NUMINCRBY or NUMMULTBY, as a double; the reply is the new number."""

    def how(text: Column) -> Column:
        old = F.when(F.substring(text, 1, 1).rlike("[-0-9]"), text.try_cast("double"))
        new = (old * operand if multiply else old + operand).cast("string")
        return F.when(old.isNotNull(), _made(new, new))

    return change(j, path, how, "JSON path is not a number")


def set_at(j: DataFrame, path: str, value) -> DataFrame:
    """A field set, or the whole document."""
    return change(j, path, lambda text: _made(_json(value), F.lit("OK")), "JSON path is not an object", missing="null")


def cleared(j: DataFrame, path: str = "$") -> DataFrame:
    """Objects and arrays emptied, numbers 0, booleans false, strings empty; the reply is 1."""

    def how(text: Column) -> Column:
        head = F.substring(text, 1, 1)
        new = F.when(head == "{", "{}").when(head == "[", "[]").when(head == '"', '""').when(text.isin("true", "false"), "false").when(text == "null", "null").otherwise("0")
        return _made(new, F.lit(1))

    return change(j, path, how, "")


def removed(j: DataFrame, path: str) -> DataFrame:
    """key, doc, reply of JSON.DEL: 1 where the field was there. At the root the documents go."""
    name = json_field(path)
    if name == "":
        return j.filter(F.lit(False)).select("key", "doc", F.lit("1").alias("reply"))
    parts = _parts(F.col("doc"))
    left = F.filter(parts, lambda p: p["name"] != F.lit(name))
    gone = F.coalesce(F.size(left) < F.size(parts), F.lit(False))
    return j.select("key", F.when(gone, _whole(left)).otherwise(F.col("doc")).alias("doc"), gone.cast("int").cast("string").alias("reply"))


def merged(j: DataFrame, patch) -> DataFrame:
    """key, doc after a merge patch (null deletes), which goes as deep as the patch does: texts pass through Arrow batches
    once. A document that isn't JSON stays as it is."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(merge(json.loads(text), patch), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column("key"), pa.array([one(t) for t in batch.column("doc").to_pylist()], pa.string())], names=["key", "doc"])

    return j.select("key", "doc").mapInArrow(run, f"key {j.schema['key'].dataType.simpleString()}, doc string")


def merge(doc, patch):
    """A merge patch: null deletes."""
    if not isinstance(patch, dict):
        return patch
    out = dict(doc) if isinstance(doc, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge(out.get(k), v)
    return out

"""Source messages of many shapes, as JSON, to canonical turns: columns over parsed JSON. Python sees only what JSON functions
can't read or write: Python literals, values that are texts of JSON themselves, escapes, and the spacing of JSON texts."""

from __future__ import annotations

import ast
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chat import role, split_thinking
from .text import once, strip, unescape

#: calls: the JSON text of each call, with a space after commas and colons.
TURNS = "array<struct<role string, content string, thinking string, calls array<string>>>"
#: What of a message is read; nested values as their JSON text.
MESSAGE = "role string, `from` string, content string, value string, thinking string, reasoning string, tool_calls array<string>, function_call string"
CALL = "`function` string, name string, arguments string, parameters string"
#: Keys whose values may be texts that hold JSON or a Python literal.
NESTED = ("tool_calls", "function_call", "arguments", "parameters")


def read_value(text: str):
    """The value that a text writes in JSON or as a Python literal; ValueError if it is neither."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        return ast.literal_eval(text)
    except (SyntaxError, TypeError, MemoryError, RecursionError) as e:
        raise ValueError(str(e)) from e


def _unnested(value):
    """A value whose NESTED texts are replaced by what they write."""
    if isinstance(value, list | tuple):
        return [_unnested(v) for v in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for key, v in value.items():
        if key in NESTED and isinstance(v, str):
            try:
                v = read_value(v)
            except ValueError:
                pass
        out[key] = _unnested(v)
    return out


@F.arrow_udf(T.StringType())
def _as_json(texts):
    """Texts in JSON or as Python literals to JSON without nested texts; null for what is neither."""
    import pyarrow as pa

    out = []
    for text in texts.to_pylist():
        try:
            out.append(None if text is None else json.dumps(_unnested(read_value(text)), ensure_ascii=False, default=str))
        except ValueError:
            out.append(None)
    return pa.array(out, pa.string())


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _finished(pieces):
    """Of lists of arrays of (text, json): JSON with spaces after separators, other texts with their escapes decoded."""
    import pyarrow as pa

    def one(p):
        if p["text"] is None:
            return None
        return json.dumps(json.loads(p["text"]), ensure_ascii=False) if p["json"] else unescape(p["text"])

    return pa.array([None if row is None else [[one(p) for p in some] for some in row] for row in pieces.to_pylist()], pa.list_(pa.list_(pa.string())))


def json_list(c: Column) -> Column:
    """The JSON text of a list that a text holds, its nested texts read; null if it holds none."""
    nested = r'"(' + "|".join(NESTED) + r')"\s*:\s*"'
    plain = F.try_parse_json(c).isNotNull() & ~F.regexp_like(c, F.lit(nested))
    found = F.when(plain, c).otherwise(_as_json(F.when(plain, F.lit(None).cast("string")).otherwise(c)))
    return once(found, lambda j: F.when(F.startswith(F.ltrim(j), F.lit("[")), j))


def _piece(text: Column, is_json: Column) -> Column:
    return F.struct(text.alias("text"), is_json.alias("json"))


def _kind(value: Column) -> Column:
    """What a JSON value is: STRING, BIGINT, OBJECT<...>, VOID for null; null where there is none."""
    return F.schema_of_variant(value)


def _at(value: Column, key: str) -> Column:
    return F.try_variant_get(value, f"$.{key}", "variant")


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("t")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _calls(m: Column) -> Column:
    """The JSON of the calls in a message: those of its list, whose entries may wrap a function, then a single one. Calls without
    a name go; arguments are the value of the first of their keys there, or none."""

    def unwrapped(entry: Column) -> Column:
        kind = _kind(_at(F.try_parse_json(entry), "function"))
        return F.when(F.startswith(kind, F.lit("OBJECT")), F.get_json_object(entry, "$.function")).when(kind.isNull(), entry)

    def written(entries: Column, keys: tuple[str, ...]) -> Column:
        # a step at a time, as functions within functions that share names can't be arguments of Python's
        parsed = F.transform(entries, lambda x: F.struct(F.from_json(x, CALL).alias("e"), F.try_parse_json(x).alias("v")))
        return F.transform(F.filter(parsed, lambda s: _some(s["e"]["name"]).isNotNull()), lambda s: one(s["e"], s["v"], keys))

    def one(e: Column, v: Column, keys: tuple[str, ...]) -> Column:
        arguments = F.lit("{}")
        for k in reversed(keys):
            given = F.when(_kind(_at(v, k)) == "VOID", F.lit("null")).when(_kind(_at(v, k)) == "STRING", _quoted(e[k])).otherwise(e[k])
            arguments = F.when(_kind(_at(v, k)).isNotNull(), given).otherwise(arguments)
        return F.concat(F.lit('{"name":'), _quoted(e["name"]), F.lit(',"arguments":'), arguments, F.lit("}"))

    listed = F.transform(F.coalesce(m["tool_calls"], F.array().cast("array<string>")), unwrapped)
    return F.concat(written(listed, ("arguments", "parameters")), written(F.array(m["function_call"]), ("arguments",)))


def _parsed(j: Column) -> Column:
    """The objects among the entries of a JSON list, as (m, v): what MESSAGE names, and the whole as a variant."""
    each = F.transform(F.from_json(j, "array<string>"), lambda e: F.struct(F.from_json(e, MESSAGE).alias("m"), F.try_parse_json(e).alias("v")))
    return F.filter(each, lambda e: F.coalesce(F.startswith(_kind(e["v"]), F.lit("OBJECT")), F.lit(False)))


def _first_text(e: Column, *keys: str) -> Column:
    """The piece of the first key whose value isn't empty, or of an empty text."""
    out = _piece(F.lit(""), F.lit(False))
    for k in reversed(keys):
        out = F.when(_some(e["m"][k]).isNotNull(), _piece(e["m"][k], _kind(_at(e["v"], k)) != "STRING")).otherwise(out)
    return out


def _with_texts(df: DataFrame, rows: Column) -> DataFrame:
    """df with _rows, an array of structs with pieces p, and _texts, the finished texts of each; only rows with JSON or escapes
    in them go to Python."""
    df = df.withColumn("_rows", rows).withColumn("_pieces", F.transform("_rows", lambda r: r["p"]))
    needs = F.exists(F.flatten("_pieces"), lambda p: p["json"] | F.coalesce(F.contains(p["text"], F.lit("\\u")), F.lit(False)))
    texts = F.transform("_pieces", lambda some: F.transform(some, lambda p: p["text"]))
    return df.withColumn("_done", _finished(F.when(needs, F.col("_pieces")))).withColumn("_texts", F.coalesce("_done", texts))


def normalize(df: DataFrame, column: str = "messages", out: str = "messages") -> DataFrame:
    """df with the TURNS of a column that holds a list of messages as a text of JSON or of a Python literal.

    Entries that aren't objects go; other texts and nulls have no turns. Content is a message's content, else its value; other
    values than texts are JSON. Thinking and calls are the assistant's alone: its thinking or reasoning, else what a leading
    <think> block of its content holds.
    """

    def pieces(e: Column) -> Column:
        said = _first_text(e, "content", "value")
        said = F.when(_kind(_at(e["v"], "content")) == "STRING", _piece(e["m"]["content"], F.lit(False))).otherwise(said)
        calls = F.transform(_calls(e["m"]), lambda c: _piece(c, F.lit(True)))
        return F.concat(F.array(said, _first_text(e, "thinking", "reasoning")), calls)

    def turn(r: Column, given: Column) -> Column:
        own = r["role"] == "assistant"
        content, thought = F.get(given, F.lit(0)), F.get(given, F.lit(1))
        inside, rest = split_thinking(content)
        return F.struct(
            r["role"].alias("role"),
            F.when(own & (thought == ""), rest).otherwise(content).alias("content"),
            F.when(own, F.when(thought != "", strip(thought)).otherwise(inside)).alias("thinking"),
            F.when(own, F.slice(given, F.lit(3), F.greatest(F.lit(0), F.size(given) - 2))).otherwise(F.array().cast("array<string>")).alias("calls"),
        )

    name = lambda e: role(F.coalesce(_some(e["m"]["role"]), _some(e["m"]["from"])))
    rows = F.transform(_parsed(F.col("_json")), lambda e: F.struct(name(e).alias("role"), pieces(e).alias("p")))
    made = _with_texts(df.withColumn("_json", json_list(F.col(column).cast("string"))), rows)
    turns = F.coalesce(F.zip_with("_rows", "_texts", turn), F.array().cast(TURNS))
    return made.withColumn(out, turns).drop("_json", "_rows", "_pieces", "_done", "_texts")


def coerce(df: DataFrame, column: str = "messages", out: str = "messages") -> DataFrame:
    """df with array<struct<role, content>> for previews; a text that holds no list is one message of the role raw, null has none."""
    entries = F.transform(F.from_json(F.col("_json"), "array<string>"), lambda e: F.struct(e.alias("e"), F.from_json(e, MESSAGE).alias("m"), F.try_parse_json(e).alias("v")))

    def said(e: Column) -> Column:
        known = F.coalesce(F.startswith(_kind(e["v"]), F.lit("OBJECT")), F.lit(False))
        name = F.when(known, F.coalesce(_some(e["m"]["role"]), _some(e["m"]["from"]), F.lit("?"))).otherwise(F.lit("?"))
        return F.struct(name.alias("role"), F.array(F.when(known, _first_text(e, "content", "value")).otherwise(_piece(e["e"], F.lit(False)))).alias("p"))

    raw = F.array(F.struct(F.lit("raw").alias("role"), F.array(_piece(F.col(column).cast("string"), F.lit(False))).alias("p")))
    rows = F.when(F.col(column).isNull(), F.slice(raw, 1, 0)).when(F.col("_json").isNull(), raw).otherwise(F.transform(entries, said))
    made = _with_texts(df.withColumn("_json", json_list(F.col(column).cast("string"))), rows)
    shown = F.zip_with("_rows", "_texts", lambda r, t: F.struct(r["role"].alias("role"), F.get(t, F.lit(0)).alias("content")))
    return made.withColumn(out, shown).drop("_json", "_rows", "_pieces", "_done", "_texts")

"""Redactable texts of a request body, and the body put together again.

Visited are, in this order for each message: its content if it is a string, or
the texts of its text parts; then of each tool call the arguments and the name.
A body without an array of messages is one fragment as it is."""
from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAGMENT = "struct<path:string,text:string>"
_NONE = f"array<{FRAGMENT}>"


def _string(v: Column, path: str) -> Column:
    """A string at a path of a variant; null for anything else there."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(v, path, "string"))


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _one(path: Column, text: Column) -> Column:
    return F.when(text.isNotNull(), F.array(F.struct(path.alias("path"), text.alias("text")))).otherwise(F.array().cast(_NONE))


def fragments(body: Column) -> Column:
    """Array of (path, text) in visiting order."""
    parsed = F.try_parse_json(body)

    def place(*parts) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    def message(m: Column, i: Column) -> Column:
        plain = _one(place("messages/", i, "/content"), _string(m, "$.content"))
        parts = F.flatten(F.transform(_list(m, "$.content"), lambda p, j: F.when(
            _string(p, "$.type") == "text", _one(place("messages/", i, "/content/", j, "/text"), _string(p, "$.text"))).otherwise(F.array().cast(_NONE))))
        calls = F.flatten(F.transform(_list(m, "$.tool_calls"), lambda c, k: F.concat(
            _one(place("messages/", i, "/tool_calls/", k, "/function/arguments"), _string(c, "$.function.arguments")),
            _one(place("messages/", i, "/tool_calls/", k, "/function/name"), _string(c, "$.function.name")))))
        return F.concat(plain, parts, calls)

    messages = F.try_variant_get(parsed, "$.messages", "array<variant>")
    found = F.flatten(F.transform(messages, message))
    return F.when(messages.isNull(), F.array(F.struct(F.lit("").alias("path"), body.alias("text")))).otherwise(found)


def wants_stream(body: Column) -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(body), "$.stream", "boolean"), F.lit(False))


def exploded(requests: DataFrame, body: str = "body") -> DataFrame:
    """A row for each fragment: the columns of ``requests`` with frag_seq, path and text."""
    return requests.select(*requests.columns, F.posexplode(fragments(F.col(body))).alias("frag_seq", "_f")).select(*requests.columns, F.col("frag_seq").cast("long").alias("frag_seq"), "_f.path", "_f.text")


def put(body: str, paths: list[str], texts: list[str]) -> str:
    """A body with the texts at their places; keys in order, compact."""
    if paths == [""]:
        return texts[0]
    root = json.loads(body)
    for path, text in zip(paths, texts):
        *way, last = path.split("/")
        node = root
        for step in way:
            node = node[int(step)] if isinstance(node, list) else node[step]
        node[int(last) if isinstance(node, list) else last] = text
    return json.dumps(root, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def reassembled(parts: DataFrame, key: list[str], body: str = "body", text: str = "text") -> DataFrame:
    """(key, body) from the rows of ``exploded`` with new texts. One request's fragments meet, no more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["_body"] = [put(x, [f["path"] for f in fs], [f["text"] for f in fs]) for x, fs in zip(b["_body"], b["_fs"])]
            yield b.drop(columns="_fs")

    grouped = parts.groupBy(*key).agg(F.first(body).alias("_body"), F.array_sort(F.collect_list(F.struct("frag_seq", "path", F.col(text).alias("text")))).alias("_fs"))
    schema = ", ".join(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in key)
    return grouped.mapInPandas(run, f"{schema}, _body string").withColumnRenamed("_body", body)



"""Captured requests and log files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskweave.operators.report import masked_log

HEADER_BYTES, BODY_BYTES = 1 << 20, 50 << 20


def parsed_request(raw: Column) -> Column:
    """struct(method, path, version, headers, body) of a captured request's text; null if its headers don't end within 1 MB.

    The body is cut to Content-Length and 50 MB; of repeated headers the last counts."""
    end = F.locate("\r\n\r\n", raw)
    head = F.substr(raw, F.lit(1), end - 1)
    lines = F.split(head, "\r\n")
    first = F.element_at(lines, 1)
    named = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.contains(x, F.lit(":")))
    entries = F.transform(named, lambda x: F.struct(F.substring_index(x, ":", 1).alias("name"), F.ltrim(F.substr(x, F.locate(":", x) + 1), F.lit(" \t")).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["name"] == e["name"]))
    headers = F.map_from_entries(last)
    length = F.get(F.filter(entries, lambda e: F.lower(e["name"]) == "content-length"), F.lit(0))["value"].try_cast("long")
    body = F.substr(raw, end + 4)
    size = F.least(F.coalesce(length, F.lit(0)), F.lit(BODY_BYTES)).cast("int")
    return F.when((end > 0) & (end <= HEADER_BYTES), F.struct(
        F.regexp_extract(first, r"^(\S+)", 1).alias("method"), F.regexp_extract(first, r"^\S+\s+(\S+)", 1).alias("path"),
        F.regexp_extract(first, r"^\S+\s+\S+\s+(\S+)", 1).alias("version"), headers.alias("headers"), F.left(body, size).alias("body")))


def append_log(rows: DataFrame, path: str, session: str, show_sensitive: bool = False) -> None:
    """Append log rows under their session's folder, bodies masked unless asked for."""
    masked_log(rows, show_sensitive).withColumn("session", F.lit(session)).write.mode("append").partitionBy("session").json(path)


def messages(spark, path: str, language: str) -> DataFrame:
    """(lang, key, value) of a message catalogue in XML."""
    rows = spark.read.format("xml").option("rowTag", "data").load(path)
    return rows.select(F.lit(language).alias("lang"), F.col("_name").alias("key"), "value")

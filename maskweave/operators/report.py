"""Rings, logs and statistics."""
from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskweave.constants import LOG_RING, MATCH_RING


def last_per_key(rows: DataFrame, key: str, order: str, most: int = MATCH_RING) -> DataFrame:
    """The last ``most`` rows of each key. Spark keeps only the tops of a group before
    the shuffle (a window group limit), so a hot key sends that many rows per task."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col(order).desc()))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def recent(logs: DataFrame, order: str, n: int = 100, ring: int = LOG_RING) -> DataFrame:
    """The last n rows of a ring, as a top-k; ``place`` counts from the oldest."""
    top = logs.orderBy(F.col(order).desc()).limit(min(n, ring))
    return top.withColumn("place", F.row_number().over(W.orderBy(order)).cast("long"))


def of_alias(logs: DataFrame, alias: str, order: str, n: int = 100, ring: int = LOG_RING) -> DataFrame:
    """The last n rows of one alias among those that the ring still holds."""
    held = logs.orderBy(F.col(order).desc()).limit(ring)
    return recent(held.where(F.col("alias") == alias), order, n, n)


def match_line(ts: Column, kind: Column, detail: Column, text: Column) -> Column:
    """``[time] type (detail): text``, without the brackets if there is no detail."""
    more = F.when(F.coalesce(detail, F.lit("")) != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise("")
    return F.concat(F.lit("["), F.date_format(ts, "HH:mm:ss"), F.lit("] "), kind, more, F.lit(": "), text)


def masked_log(logs: DataFrame, show_sensitive: bool) -> DataFrame:
    """Log rows as they may be kept: bodies at the client's side give way to their size unless sensitive values are wanted."""
    if show_sensitive:
        return logs
    client = F.col("direction").isin("UserToProxy", "ProxyToUser")
    omitted = F.concat(F.octet_length("details").cast("string"), F.lit(" bytes (body omitted)"))
    return logs.withColumn("details", F.when(client, omitted).otherwise(F.col("details")))


def logged(logs: DataFrame, enabled: bool, show_sensitive: bool) -> DataFrame:
    """What a log keeps under its two switches; without logging nothing is kept, sensitive values least of all."""
    return masked_log(logs, show_sensitive and enabled).where(F.lit(enabled))


def match_listing(labels: DataFrame, types: DataFrame, default: str = "") -> DataFrame:
    """``labels`` (session, kind, original, label) with the type of their originals by ``types``
    (original, type) and their place in their session: spans, patterns, keywords, each by label text."""
    kinds = F.array_position(F.array(F.lit("PII"), F.lit("REGEX"), F.lit("KEYWORD")), F.col("kind"))
    out = labels.join(types.groupBy("original").agg(F.min("type").alias("type")), "original", "left")
    place = F.row_number().over(W.partitionBy("session").orderBy(kinds, "label"))
    return out.select("session", "kind", "label", "original", F.coalesce("type", F.lit(default)).alias("type"), place.cast("long").alias("place"))


def observed(df: DataFrame, name: str, text: str) -> tuple[DataFrame, Observation]:
    """``df`` with metrics of the step that it stands for: rows and bytes, read once an action has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n_bytes")), seen


@contextmanager
def timed(name: str, into: dict[str, float] | None) -> Iterator[None]:
    """Seconds that a step which runs jobs takes, added to ``into`` under its name."""
    began = time.perf_counter()
    yield
    if into is not None:
        into[name] = into.get(name, 0.0) + time.perf_counter() - began


def last_written(rows: DataFrame, group: list[str], key: str, value: str, order: list[str]) -> DataFrame:
    """The union of maps whose entries are ``rows``: of each group's key the value that was written last."""
    last = F.max_by(F.struct(value), F.struct(*order)).alias("_last")
    return rows.groupBy(*group, key).agg(last).select(*group, key, F.col("_last")[value].alias(value))


def type_breakdown(found: DataFrame, key: list[str], kind: str) -> DataFrame:
    """A map of kind to count for each key."""
    per = found.groupBy(*key, kind).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("breakdown"))


def latest_release(assets: DataFrame) -> DataFrame:
    """The newest full asset with a name; the first of equal versions."""
    from maskweave.functions.text import version_parts

    full = assets.where((F.col("type").isin("Full", "1")) & (F.coalesce("version", F.lit("")) != "") & (F.coalesce("file_name", F.lit("")) != ""))
    return full.agg(F.max_by(F.struct("version", "file_name"), F.struct(F.coalesce(version_parts(F.col("version")), F.array(F.lit(-1))), -F.col("place"))).alias("r")).select("r.*")

"""Settings documents: reading with quarantine, migration, defaults, and writing.

A settings document is one JSON object. Steps are DataFrame to DataFrame over a
column of JSON texts, so one file or a table of millions go the same way.

``write`` seals what is confidential in a profile before anything reaches a file,
and ``read`` opens it again, if they are given the data key. JSON is taken apart
and put together in Python, sealed and opened by Spark's functions. A field that
another key sealed stays sealed; an opened list that doesn't parse is empty."""
from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.constants import SETTINGS_VERSION
from maskweave.sources import vault
from maskweave.sources.vault import ENVELOPE
from maskweave.storage import stage

#: Names that changed, from version to the next; a value under the new name wins.
RENAMED = {1: {"verbose_logging": "logging_enabled"}}
#: Confidential fields of a profile, and the type that each has while it is open.
SEALED = {"api_key": str, "keywords": list, "regex_patterns": list}
DEFAULTS = {"start_on_boot": True, "logging_enabled": False, "app_language": ""}


def migrate(settings: object) -> dict:
    """A document at the present version; newer ones stay as they are, and what is no object is empty."""
    if not isinstance(settings, dict):
        settings = {}
    version = settings.get("settings_version", 1)
    version = version if isinstance(version, int) and not isinstance(version, bool) else 1
    out = dict(settings)
    for v in range(version, SETTINGS_VERSION):
        for old, new in RENAMED.get(v, {}).items():
            if old in out:
                value = out.pop(old)
                out.setdefault(new, value)
        out["settings_version"] = v + 1
    return out


def with_defaults(settings: dict) -> dict:
    return {**DEFAULTS, **settings}


def migrated(documents: DataFrame, body: str = "value") -> DataFrame:
    """``documents`` with ``body`` migrated and filled in, and ``corrupt`` where it didn't parse."""

    changed = F.pandas_udf("string")(_migrate_all)
    return documents.withColumns({"corrupt": F.try_parse_json(body).isNull(), body: changed(body)})


def _parsed(text: str | None) -> object:
    try:
        return json.loads(text or "")
    except ValueError:
        return {}


def _migrate_all(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: json.dumps(with_defaults(migrate(_parsed(t))), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _confidential(settings: object, sealed: bool) -> Iterator[tuple[dict, str]]:
    """(profile, field) of what can be sealed, or of what is, in order."""
    profiles = settings.get("profiles") if isinstance(settings, dict) else None
    for profile in profiles if isinstance(profiles, list) else ():
        for name, kind in SEALED.items() if isinstance(profile, dict) else ():
            value = profile.get(name)
            if isinstance(value, dict) and "_enc" in value if sealed else isinstance(value, kind):
                yield profile, name


def _dumped(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _open_texts(text: str | None) -> list[str]:
    return [p[name] if SEALED[name] is str else _dumped(p[name]) for p, name in _confidential(_parsed(text), False)]


def _envelopes(text: str | None) -> list[dict]:
    return [{k: v if isinstance(v := p[name].get(k), str) else "" for k in ENVELOPE} for p, name in _confidential(_parsed(text), True)]


def _with_envelopes(text: str | None, envelopes: list[dict]) -> str | None:
    settings = _parsed(text)
    places = list(_confidential(settings, False))
    for (profile, name), envelope in zip(places, envelopes):
        profile[name] = {k: envelope[k] for k in ENVELOPE}
    return _dumped(settings) if places else text


def _with_texts(text: str | None, texts: list[str | None]) -> str | None:
    settings = _parsed(text)
    places = list(_confidential(settings, True))
    for (profile, name), found in zip(places, texts):
        if found is not None:
            value = found if SEALED[name] is str else _parsed(found)
            profile[name] = value if isinstance(value, SEALED[name]) else []
    return _dumped(settings) if places else text


def _over(f: Callable, kind: str) -> Callable:
    """``f`` of each row's values as a column function."""

    def each(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([f(*row) for row in zip(*columns)], dtype=object)

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([f(x) for x in s], dtype=object)

    many = f.__code__.co_argcount > 1
    hints = {"batches": Iterator[tuple[pd.Series, ...]] if many else Iterator[pd.Series], "return": Iterator[pd.Series]}
    run = each if many else one
    run.__annotations__ = hints
    return F.pandas_udf(run, kind)


def sealed(documents: DataFrame, key: bytes, body: str = "value") -> DataFrame:
    """``documents`` with the confidential fields of their profiles sealed."""
    texts = documents.withColumns({"_texts": _over(_open_texts, "array<string>")(body), "_vault_key": vault.key_column(documents.sparkSession, key)})
    packed = F.transform("_texts", lambda t: F.aes_encrypt(t.cast("binary"), F.col("_vault_key"), F.lit("GCM")))
    # an initial vector is drawn at each evaluation: written once, then taken apart
    stored = stage(texts.withColumn("_packed", packed).drop("_texts", "_vault_key"), "settings-sealed")
    return stored.withColumn(body, _over(_with_envelopes, "string")(body, F.transform("_packed", vault.envelope_of))).drop("_packed")


def opened(documents: DataFrame, key: bytes, body: str = "value") -> DataFrame:
    """``documents`` with what ``key`` sealed opened."""
    fields = ", ".join(f"{k}: string" for k in ENVELOPE)
    found = _over(_envelopes, f"array<struct<{fields}>>")(body)
    rows = documents.withColumns({"_found": found, "_vault_key": vault.key_column(documents.sparkSession, key)})
    rows = rows.withColumn("_texts", F.transform("_found", lambda e: vault.opened(e, F.col("_vault_key"))))
    return rows.withColumn(body, _over(_with_texts, "string")(body, "_texts")).drop("_texts", "_found", "_vault_key")


def _copied(batches: Iterator[pa.RecordBatch], suffix: str) -> Iterator[pa.RecordBatch]:
    """Files copied beside themselves, by the tasks that have found them."""
    for batch in batches:
        for uri in batch.column("path").to_pylist():
            where, name = fs.FileSystem.from_uri(uri)
            where.copy_file(name, name + suffix)
        yield batch


def read(spark: SparkSession, path: str, quarantine: bool = True, key: bytes | None = None) -> DataFrame:
    """Settings files under a path as (path, value), migrated, and opened if there is a key. A file that
    doesn't parse is copied beside itself as ``<name>.corrupt-<time>.bak`` and read as empty."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    if quarantine:
        kept = f".corrupt-{int(time.time())}.bak"
        broken = raw.where(F.try_parse_json("value").isNull()).select("path")
        broken.mapInArrow(lambda batches: _copied(batches, kept), "path string").write.format("noop").mode("overwrite").save()
    return migrated(raw if key is None else opened(raw, key))


def write(documents: DataFrame, path: str, body: str = "value", key: bytes | None = None) -> None:
    """One JSON document a line, its profiles' confidential fields sealed if there is a key."""
    (documents if key is None else sealed(documents, key, body)).select(body).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str, key: bytes | None = None) -> DataFrame:
    """What ``write`` has written, as (value)."""
    rows = spark.read.text(path)
    return rows if key is None else opened(rows, key)

"""Encrypted fields: AES-256-GCM by Spark's own functions, under a data key that a master password wraps.

A key is never a literal: ``key_column`` makes it a scalar subquery over a table of
one row, so plans name the subquery, and tasks get the key with their data."""
from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ITERATIONS, KEY_BYTES, IV_BYTES, TAG_BYTES = 100_000, 32, 12, 16
MODE = "aes-256-gcm"
#: Fields of an envelope, as they are written.
ENVELOPE = ("_enc", "_mode", "_iv", "_tag")


def password_key(password: str, salt: bytes, iterations: int = ITERATIONS) -> bytes:
    """The key that wraps the data key. Worked out on the driver, once."""
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, iterations, KEY_BYTES)


def key_column(spark: SparkSession, key: bytes) -> Column:
    """A key for the functions below, which no plan shows."""
    return spark.createDataFrame([(bytearray(key),)], "key binary").scalar()


def opened(envelope: Column, key: Column) -> Column:
    """The text of an envelope; null if it was sealed under another key or changed."""
    packed = F.concat(F.unbase64(envelope["_iv"]), F.unbase64(envelope["_enc"]), F.unbase64(envelope["_tag"]))
    return F.try_aes_decrypt(packed, key, F.lit("GCM")).cast("string")


def sealed(rows: DataFrame, columns: list[str], key: bytes) -> DataFrame:
    """``rows`` with the columns sealed. An initial vector is drawn at each evaluation, so
    the result is written once before its parts are taken apart."""
    from maskweave.storage import stage

    hidden = key_column(rows.sparkSession, key)
    packed = rows.withColumns({c: F.aes_encrypt(F.col(c).cast("binary"), hidden, F.lit("GCM")) for c in columns})
    return stage(packed, "sealed").withColumns({c: envelope_of(F.col(c)) for c in columns})


def envelope_of(packed: Column) -> Column:
    size = F.octet_length(packed)
    part = lambda a, n: F.base64(F.substr(packed, a, n))
    return F.when(packed.isNotNull(), F.struct(
        part(F.lit(IV_BYTES + 1), size - IV_BYTES - TAG_BYTES).alias("_enc"), F.lit(MODE).alias("_mode"),
        part(F.lit(1), F.lit(IV_BYTES)).alias("_iv"), part(size - TAG_BYTES + 1, F.lit(TAG_BYTES)).alias("_tag")))


def new_data_key() -> bytes:
    return os.urandom(KEY_BYTES)


def _cipher(spark: SparkSession, mode: int, key: bytes, iv: bytes):
    """The driver's own cipher, so that neither key shows up in a plan. ``mode``: 1 seals, 2 opens."""
    crypto = spark._jvm.javax.crypto
    out = crypto.Cipher.getInstance("AES/GCM/NoPadding")
    out.init(mode, crypto.spec.SecretKeySpec(key, "AES"), crypto.spec.GCMParameterSpec(8 * TAG_BYTES, iv))
    return out


def wrap(spark: SparkSession, data_key: bytes, password: str, salt: bytes | None = None) -> tuple[bytes, bytes]:
    """(salt, wrapped data key)."""
    salt, iv = salt or os.urandom(16), os.urandom(IV_BYTES)
    return salt, iv + bytes(_cipher(spark, 1, password_key(password, salt), iv).doFinal(data_key))


def unwrap(spark: SparkSession, wrapped: bytes, password: str, salt: bytes) -> bytes | None:
    """The data key; None for a wrong password."""
    try:
        return bytes(_cipher(spark, 2, password_key(password, salt), wrapped[:IV_BYTES]).doFinal(wrapped[IV_BYTES:]))
    except Exception as e:  # of the JVM: the tag doesn't fit
        if "AEADBadTagException" in str(e):
            return None
        raise

"""Overlapping token windows, each owning the tokens up to the next one's start."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskweave.constants import CHUNK_OVERLAP, CHUNK_TOKENS
from maskweave.functions.core import let


def owned_chunks(n: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Structs (chunk, start_at, end_at, owned_end) that cover n tokens; none for n < 1. The last owns all it has."""
    stride = size - overlap
    count = F.greatest(F.lit(1), F.ceil((n - overlap) / stride)).cast("int")

    def chunk(i: Column) -> Column:
        start = i.cast("long") * stride
        end = F.least(n.cast("long"), start + size)
        return F.struct(i.cast("long").alias("chunk"), start.alias("start_at"), end.alias("end_at"), F.when(end >= n, n.cast("long")).otherwise(start + stride).alias("owned_end"))

    return F.when(n > 0, let(count, lambda c: F.transform(F.sequence(F.lit(0), c - 1), chunk))).otherwise(F.array().cast("array<struct<chunk:bigint,start_at:bigint,end_at:bigint,owned_end:bigint>>"))

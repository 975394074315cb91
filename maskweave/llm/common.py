"""Pieces that several operators share."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than these.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Batches of so many whole texts go to Python at a time: both sides hold a batch or two."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, kept)


class Positions:
    """``rows``: a table whose columns are named by position (in_0, in_1 ...), so that
    an operator's own columns can't clash with them, and two may have one name."""

    def __init__(self, df: DataFrame):
        self.names, self.at = df.columns, {}
        self.inner = [f"in_{i}" for i in range(len(self.names))]
        for name, inner in zip(self.names, self.inner):
            self.at.setdefault(name, inner)
        self.rows = df.toDF(*self.inner)

    def __getitem__(self, name: str) -> str:
        return self.at[name]

    def back(self, df: DataFrame) -> DataFrame:
        """The columns that came in, under their names."""
        return df.select(*self.inner).toDF(*self.names)


def words(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once: Catalyst would copy a plain
    expression into each lambda and evaluate it again for every element."""
    return F.transform(F.array(value), body)[0]


def upto(n: Column) -> Column:
    """0 to n-1 as an array; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

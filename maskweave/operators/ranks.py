"""Numbers and running sums within groups of any size: no task holds a group together.

Rows are dealt to ranges of (group, order) and stored with their range's number.
What a window does within a group is done within a group's part of each range,
which starts where the group's ranges before it end: a row for each group and
range tells where that is."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskweave.storage import compacted, stage

RANGE = "_range"


def dealt(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` stored by ranges of ``group`` and ``order``, with the range's number. ``rows`` is read twice: store it first if it is made by more than a scan."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(rows.repartitionByRange(n, *group, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def _beside(rows: DataFrame, facts: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with the facts of their group and range; null groups meet too."""
    keys = [*group, RANGE]
    side = facts.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [rows[k].eqNullSafe(side[f"_of_{k}"]) for k in group] + [rows[RANGE] == side[f"_of_{RANGE}"]]
    return rows.join(side, on).drop(*[f"_of_{k}" for k in keys])


def _before(facts: DataFrame, group: list[str], value: Column, name: str) -> DataFrame:
    """``facts`` (group, range ...) with ``value``, an aggregate, over the group's ranges before each."""
    earlier = W.partitionBy(*group).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    return facts.select(*group, RANGE, value.over(earlier).alias(name))


def running(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows``, as ``dealt`` has them, with the sum of ``value`` over the group up to each row, itself included."""
    rows = rows.withColumn("_value", value)
    totals = rows.groupBy(*group, RANGE).agg(F.sum("_value").alias("_sum"))
    within = W.partitionBy(*group, RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = rows.withColumn(name, F.sum("_value").over(within)).drop("_value")
    both = _beside(own, _before(totals, group, F.sum("_sum"), "_start"), group)
    return both.withColumn(name, F.col(name) + F.coalesce("_start", F.lit(0))).drop("_start")


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their place within their group, from 0."""
    out = running(dealt(compacted(rows, "to-number"), group, order), group, order, F.lit(1).cast("long"), name)
    return out.withColumn(name, F.col(name) - 1).drop(RANGE)


def previous(rows: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows``, as ``dealt`` has them, with a struct of the group's ``value`` before each; null for the first."""
    within = W.partitionBy(*group, RANGE).orderBy(*order)
    last = rows.groupBy(*group, RANGE).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    own = rows.withColumn(name, F.lag(F.struct(value)).over(within))
    both = _beside(own, _before(last, group, F.last("_last"), "_there"), group)
    return both.withColumn(name, F.coalesce(name, "_there")).drop("_there")

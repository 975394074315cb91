"""Connected components of a graph given by its edges, without collecting any of it."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.storage import collected, compacted, delete, handed_on


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); component: the smallest node reachable.

    Large-star and small-star by turns (Kiveris and others, 2014): each step
    hangs neighbours on the smallest one, with a map-side minimum per node, until
    every node hangs on its component's smallest. Every step joins edges with one
    row for each node, whose key a skewed join may split. Each round is written
    and the round before it deleted; the edges' own number falls or stays, and
    the smallest neighbours only get smaller, so the rounds end."""
    spark = edges.sparkSession
    with collected() as last:
        now = compacted(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = None
    while True:
        # large star: neighbours above a node go to the smallest node around it
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        with collected() as new:
            now = compacted(down.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        delete(spark, last)
        last = new
        sums = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if sums == state:
            break
        state = sums
    handed_on(last)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

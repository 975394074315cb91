"""Streaming queries over data that comes part by part."""
from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_parts(parts: Iterable[DataFrame], transform: Callable[[DataFrame], DataFrame], schema: str, root: str) -> DataFrame:
    """What ``transform`` makes of parts that are written one after another to a folder that the query
    reads; it is started anew for each on one checkpoint. All of it is below ``root``."""
    spark = kept = None
    try:
        for part in parts:
            if spark is None:
                spark = part.sparkSession
                kept = spark.conf.get(PROVIDER)
                spark.conf.set(PROVIDER, ROCKS)
            part.write.mode("append").parquet(f"{root}/in")
            source = spark.readStream.schema(part.schema).parquet(f"{root}/in")
            query = transform(source).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        if spark is not None:
            spark.conf.set(PROVIDER, kept)
    return spark.read.schema(schema).parquet(f"{root}/out")

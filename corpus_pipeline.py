"""The training-data pipeline: documents in, framed token records out.

Each stage takes what its predecessor kept, as (spark, docs, sf_dir), and all
but the last return the columns of documents. ``run`` writes the result of each
stage as Parquet in the shared folder and reads it again for the next; what a
stage has stored on its way goes once that result is written.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskweave.llm.decontaminate import decontaminate_stage
from maskweave.llm.mixing import mix_stage
from maskweave.llm.near_dup import near_dup_stage
from maskweave.llm.quality import quality_stage
from maskweave.llm.token_records import records_stage
from maskweave.storage import collected, delete, stage

STAGES = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing to target weights", mix_stage),
    ("token records", records_stage),
]
#: Mixing draws by hash and the last stage tokenizes: neither is SQL. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, f in STAGES[:-1]:
        with collected() as used:
            kept = f(spark, docs, sf_dir)
        with collected() as written:
            docs = stage(kept, name.replace(" ", "-"))
        delete(spark, used + read)
        read = written
    return STAGES[-1][1](spark, docs, sf_dir)

"""op10_sharding: all documents in 24 shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, sharding


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return sharding.shard(docs, sharding.SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op10_sharding": op10_sharding}
#: The greedy search isn't SQL; tested against brute force instead.
ORACLE_SQL: dict[str, str] = {}

"""op8_mixing: all documents mixed to repeating weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, mixing


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    decided = mixing.mix(docs, common.word_count(F.col("text")))
    return decided.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


QUERIES = {"op8_mixing": op8_mixing}
#: The draws use Spark's seeded XXH64, which DuckDB lacks; tested against brute force instead.
ORACLE_SQL: dict[str, str] = {}

"""op1_packing: all documents packed by their words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, packing


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(common.table(spark, sf_dir, "documents"), common.word_count(F.col("text")))


QUERIES = {"op1_packing": op1_packing}
#: The greedy filling isn't SQL; tested against brute force instead.
ORACLE_SQL: dict[str, str] = {}

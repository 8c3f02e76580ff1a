"""op6_licenses: licenses of all documents.

The table has no paths, so each document gets one from its keys alone: it lies
below its source and language in a folder of a thousand keys. Every tenth is a
notice file, of its folder or of one of the two above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, licenses


def paths() -> Column:
    source, lang = (F.coalesce(F.col(c), F.lit("")) for c in ("source", "lang"))
    key, folder = F.col("doc_id").cast("string"), F.floor(F.col("doc_id") / 1000).cast("string")
    own, level = F.concat_ws("/", F.lit(""), source, lang, folder), F.pmod(F.col("doc_id"), F.lit(30))
    above = F.when(level == 0, own).when(level == 10, F.concat_ws("/", F.lit(""), source, lang)).when(level == 20, F.concat_ws("/", F.lit(""), source))
    return F.when(above.isNotNull(), F.concat(above, F.lit("/NOTICE."), key)).otherwise(F.concat(own, F.lit("/"), key, F.lit(".txt")))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return licenses.scan(docs.select("doc_id", "text", paths().alias("path")))


QUERIES = {"op6_licenses": op6_licenses}
#: Sums of products in another order differ in their last digits; tested against brute force instead.
ORACLE_SQL: dict[str, str] = {}

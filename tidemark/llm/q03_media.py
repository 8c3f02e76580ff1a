"""op3_media: all documents as WAV files, read back, with fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, media


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_media": op3_media}
#: Fourier transforms aren't SQL; tested by exact round trips and brute force instead.
ORACLE_SQL: dict[str, str] = {}

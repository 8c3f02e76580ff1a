"""op5_html: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, html


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(common.table(spark, sf_dir, "pages"))


QUERIES = {"op5_html": op5_html}
#: Parsing HTML isn't SQL; tested against pages with known articles instead.
ORACLE_SQL: dict[str, str] = {}

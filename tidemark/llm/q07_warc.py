"""op7_warc: all pages in WARC archives, read back through a capture index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, warc


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(common.table(spark, sf_dir, "pages"))


QUERIES = {"op7_warc": op7_warc}
#: Five hexadecimal digits of the SHA-1 make four characters of base32.
ORACLE_SQL = {
    "op7_warc": """
WITH t AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS winner FROM t)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM w"""
}

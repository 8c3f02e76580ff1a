"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of bytes other than the ASCII white space below.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in ``spark.checkpoint.dir``, or the session by
    ``setCheckpointDir``. Where neither is set, a session on one machine, as in
    tests, gets a temporary folder; on a cluster that's an error, as no folder of
    the driver's is seen by the executors.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("no shared folder: set spark.checkpoint.dir to one that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that were made in this process and not dropped since, oldest first.
_made: list[str] = []


def made() -> int:
    """A mark for :func:`drop_made`."""
    return len(_made)


def drop_made(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Delete what was materialized since a mark, but for the given frames, once no plan reads it any more."""
    kept = {folder for df in keep for folder in _folders(df)}
    for path in _made[since:]:
        if path not in kept:
            _delete(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again.

    Unlike an RDD checkpoint this computes the plan once and keeps columns
    compressed. The files survive the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _folders(df: DataFrame) -> set[str]:
    """Those of the made folders that a frame reads."""
    names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    return {path for path in _made if path.rsplit("/", 1)[1] in names}


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)
    _made.remove(path)


def drop_files(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`materialize` that no plan reads any more."""
    for path in _folders(df):
        _delete(df.sparkSession, path)


def keep_first(docs: DataFrame, key: str, classify) -> DataFrame:
    """The first row of each class, with the columns of ``docs``.

    ``classify`` gets ``docs`` with one more column, whose name it gets too, as the
    key, and gives ``doc_id`` and ``component_id``, the least of its class. The
    added key is the given one, null last, and a digest of the whole row, so each
    row is decided by itself, and equal rows are one.
    """
    everything = F.unhex(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256))
    marked = docs.withColumn("__row", F.struct(F.col(key).isNull().alias("null"), F.col(key).alias("key"), everything.alias("mark")))
    found = classify(marked, "__row")
    kept = found.where(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id.mark").alias("__kept")).agg(F.count("*").alias("n"))
    kept = materialize(kept, "kept-rows")
    out = marked.join(kept.select("__kept"), F.col("__row.mark") == F.col("__kept"), "left_semi")
    if not kept.where("n > 1").isEmpty():
        out = out.dropDuplicates(["__row"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated(df: DataFrame, n: Column, name: str, most: int = 1 << 14) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in the column ``name``; no array has more than ``most`` elements, or n / ``most``."""
    cut = df.withColumn("__times", n.cast("long")).where("__times > 0").withColumn("__chunk", F.explode(F.expr(f"sequence(0L, (__times - 1) div {most})")))
    inside = F.explode(F.expr(f"sequence(__chunk * {most}, least(__times, (__chunk + 1) * {most}) - 1)"))
    return cut.withColumn(name, inside).drop("__times", "__chunk")


def word_count(text: Column) -> Column:
    """Number of words of a text, null as 0, by built-in functions only.

    Every word is followed by white space or the end of the text, so the words
    are what is left when each of them is replaced by one character and the
    white space is dropped.
    """
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "\u0001")
    return F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")).cast("long")


def uniform(key: Column, seed: int | Column) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed) if isinstance(seed, int) else seed), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def small_parts(batch: pa.RecordBatch, place: int, most: int = 4 << 20):
    """Slices of an Arrow batch of about ``most`` bytes in the column at ``place``, that one as a list of bytes.

    A single longer value is a slice by itself, so what a task makes of a batch stays small.
    """
    column = batch.column(place).cast(pa.binary())
    start, held = 0, 0
    for i in range(len(column) + 1):
        n = (len(column[i].as_buffer()) if column[i].is_valid else 0) if i < len(column) else 0
        if i > start and (i == len(column) or held + n > most):
            part = batch.slice(start, i - start)
            yield [*(c for k, c in enumerate(part.columns) if k != place), column.slice(start, i - start).to_pylist()]
            start, held = i, 0
        held += n

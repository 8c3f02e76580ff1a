"""Collections by name, and the files that they come from and go to."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors
from ..schema import Schema
from .held import held


#: Changesets over a collection before they are written as one.
MOST_PARTS = 8


class Catalog:
    """Collections by name: DataFrames, or functions that make one, and changesets over them. A catalog isn't changed, only extended."""

    def __init__(self, collections: dict[str, DataFrame | Callable[[], DataFrame]], parts: dict[str, tuple[str, tuple[DataFrame, ...]]] | None = None):
        self._collections = dict(collections)
        #: The id column and the changesets of collections that were written to.
        self._parts = dict(parts or {})
        self._types: dict[str, T.StructType] = {}
        self._frames: dict[str, DataFrame] = {}

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, names: dict[str, str]) -> Catalog:
        """Collections of ``<folder>/<table>.parquet``, given as name: table; read when they are asked for."""
        return cls({name: lambda t=table: spark.read.parquet(f"{folder}/{t}.parquet") for name, table in names.items()})

    @property
    def names(self) -> list[str]:
        return list(self._collections)

    def _base(self, name: str) -> DataFrame:
        if name not in self._collections:
            raise errors.CollectionNotFoundError(f"no collection {name!r}")
        found = self._collections[name]
        if not isinstance(found, DataFrame):
            found = self._collections[name] = found()
        return found

    def frame(self, name: str) -> DataFrame:
        """A collection with what was written to it: one join, however many changesets there are."""
        if name not in self._frames:
            base = self._base(name)
            if name in self._parts:
                from ..operators.changes import overlay

                id_column, parts = self._parts[name]
                base = overlay(base, *parts, id_column=id_column)
            self._frames[name] = base
        return self._frames[name]

    def some(self, name: str, ids: DataFrame, id_column: str, newest: bool = False) -> DataFrame:
        """The entities of a collection whose ids are in the only column of ``ids``: only they meet the changesets.

        ``newest`` tells that these are the ids of the newest changeset, which needn't be reduced to them.
        """
        ids = ids.select(F.col(ids.columns[0]).alias(id_column))
        base = self._base(name).join(ids, id_column, "left_semi")
        if name not in self._parts:
            return base
        from ..operators.changes import overlay

        *parts, last = self._parts[name][1]
        reduced = [p.join(ids, id_column, "left_semi") for p in parts]
        return overlay(base, *reduced, last if newest else last.join(ids, id_column, "left_semi"), id_column=id_column)

    def types(self, name: str) -> T.StructType:
        if name not in self._types:
            self._types[name] = self._base(name).schema
        return self._types[name]

    def extended(self, collections: dict[str, DataFrame]) -> Catalog:
        """With other collections, or others in the place of some."""
        return Catalog({**self._collections, **collections}, {n: p for n, p in self._parts.items() if n not in collections})

    def applied(self, changes: dict[str, DataFrame], id_of: Callable[[str], str]) -> Catalog:
        """With changesets over some collections. Nothing is computed yet."""
        parts = {n: (id_of(n), (*self._parts.get(n, ("", ()))[1], part)) for n, part in changes.items()}
        for n in changes:
            self._base(n)  # raises where there is none
        return Catalog(self._collections, {**self._parts, **parts})

    def settled(self) -> Catalog:
        """The same with changesets written, so that later plans begin at them: each by itself, or as one where they are many."""
        from ..operators.changes import merge_changes

        out = {}
        for name, (id_column, parts) in self._parts.items():
            if len(parts) > MOST_PARTS:
                parts = (merge_changes(*parts, id_column=id_column),)
            out[name] = (id_column, tuple(p if getattr(p, "_tidemark_held", False) else _settled(p) for p in parts))
        return Catalog(self._collections, out)


def _settled(part: DataFrame) -> DataFrame:
    found, _ = held(part, "changes")
    found._tidemark_held = True
    return found


def empty(spark: SparkSession, schema: Schema, name: str) -> DataFrame:
    """A declared collection without rows."""
    attrs = schema.collections[name].attrs
    return spark.createDataFrame([], T.StructType([T.StructField(k, a.spark_type(), a.may_miss) for k, a in attrs.items()]))


def write_snapshot(catalog: Catalog, folder: str, schema_json: dict | None = None) -> None:
    """``<folder>/collections/<name>`` as JSON lines, and ``<folder>/schema`` where a schema is given."""
    for name in catalog.names:
        catalog.frame(name).write.mode("overwrite").json(f"{folder}/collections/{name}")
    if schema_json is not None:
        spark = catalog.frame(catalog.names[0]).sparkSession
        spark.createDataFrame([(json.dumps(schema_json),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/schema")


def read_snapshot(spark: SparkSession, folder: str, types: dict[str, T.StructType]) -> Catalog:
    return Catalog({name: spark.read.schema(t).json(f"{folder}/collections/{name}") for name, t in types.items()})


def write_metadata(spark: SparkSession, folder: str, key: str, value) -> None:
    """Keep a value that JSON can hold beside a snapshot; another one of the same key is replaced."""
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata/{key}")


def read_metadata(spark: SparkSession, folder: str, key: str, default=None):
    """What :func:`write_metadata` kept, or the default."""
    path = f"{folder}/metadata/{key}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return default
    return json.loads(spark.read.text(path).first()["value"])


def read_bulk(spark: SparkSession, path: str, types: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """Entities by collection of JSON documents ``{collection: [entity, ...]}``, a file each; read once and written for all collections.

    A document is parsed by one task, so large bulks are best given as many files.
    """
    whole = T.StructType([T.StructField(name, T.ArrayType(t)) for name, t in types.items()])
    rows, _ = held(spark.read.schema(whole).option("multiLine", True).json(path), "bulk")
    return {name: rows.select(F.explode(F.col(name)).alias("e")).select("e.*") for name in types}


def collection_stats(catalog: Catalog) -> DataFrame:
    """``collection, count`` of all collections."""
    parts = [catalog.frame(n).agg(F.count("*").alias("count")).select(F.lit(n).alias("collection"), "count") for n in catalog.names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def serialize(df: DataFrame) -> DataFrame:
    """``json``: each row as JSON, dates in ISO form with milliseconds, nested results included."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "ignoreNullFields": "false"}).alias("json"))


def deserialize(df: DataFrame, schema: T.StructType, column: str = "json") -> DataFrame:
    """Rows of what :func:`serialize` made."""
    options = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"}
    return df.select(F.from_json(column, schema, options).alias("e")).select("e.*")

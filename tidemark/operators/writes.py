"""Writes: defaults, validation, permissions, and transactions over a database."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors
from ..db import Database
from ..plans.ast import Query, normalize
from ..plans.compile import Compiler, scan
from ..plans.prepare import kind_of, permission_filter
from ..schema import Attr
from ..sources.held import held
from . import changes as C

#: Fixed value: the characters of generated short ids, those of Base64 but for the last two.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"


def uuid7(random: Column, ms: int) -> Column:
    """A UUID of version 7: 48 bits of a time in milliseconds, the rest the random bits of a UUID of version 4."""
    head = f"{ms & (1 << 48) - 1:012x}"
    return F.concat(F.lit(f"{head[:8]}-{head[8:]}-7"), F.substring(random, 16, 21))


def default_column(attr: Attr, now: datetime) -> Column:
    """The default of an attribute for each row; ``now`` is the same for all of a write."""
    d = attr.default
    if isinstance(d, dict):
        fn, args = d["fn"], d.get("args") or ()
        if fn == "now":
            return F.timestamp_millis(F.lit(round(now.timestamp() * 1000))).cast(attr.spark_type())
        if fn == "empty":
            return F.array().cast(attr.spark_type())
        if fn == "uuidv4":
            return F.uuid()
        if fn == "uuidv7":
            return uuid7(F.uuid(), round(now.timestamp() * 1000))
        size = args[0] if args else 21
        random = F.concat(*[F.uuid() for _ in range(size // 20 + 1)])
        return F.substring(F.translate(F.base64(F.unhex(F.translate(random, "-", ""))), "+/=", ALPHABET[-1] + ALPHABET[-2]), 1, size)
    return F.lit(d).cast(attr.spark_type())


def generated(attr: Attr) -> bool:
    """Whether each evaluation of an attribute's default gives another value."""
    return isinstance(attr.default, dict) and attr.default["fn"] not in ("now", "empty")


def with_defaults(rows: DataFrame, attrs: dict[str, Attr], now: datetime | None = None) -> DataFrame:
    """Rows with the columns that are missing added, and nulls of attributes that have a default filled in.

    Rows with generated values are written, so that every later read finds the same ones.
    """
    now, made = now or datetime.now(timezone.utc), False
    for name, attr in attrs.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(attr.spark_type()) if attr.default is None else default_column(attr, now))
        elif attr.default is not None and not attr.nullable:
            rows = rows.withColumn(name, F.coalesce(F.col(name), default_column(attr, now)))
        else:
            continue
        made = made or generated(attr)
    return held(rows, "inserted")[0] if made else rows


def violations(rows: DataFrame, attrs: dict[str, Attr], id_column: str) -> DataFrame:
    """``id, attribute, issue`` of every value that the schema doesn't allow."""
    checks = []
    for name, attr in attrs.items():
        if name not in rows.columns:
            if not attr.may_miss and attr.default is None:
                checks.append((F.lit(True), name, "missing"))
            continue
        c, t = F.col(f"`{name}`"), rows.schema[name].dataType
        if attr.kind not in ("json", kind_of(t)):
            checks.append((c.isNotNull(), name, "type"))
            continue
        if not attr.may_miss:
            checks.append((c.isNull(), name, "missing"))
        if attr.enum:
            checks.append((c.isNotNull() & ~c.isin(*attr.enum), name, "enum"))
        if attr.kind == "json":
            checks.append((c.isNotNull() & F.try_parse_json(c.cast("string")).isNull(), name, "json"))
        for sub, a in attr.fields:
            if sub not in [f.name for f in t.fields]:
                if not a.may_miss:
                    checks.append((c.isNotNull(), f"{name}.{sub}", "missing"))
            elif not a.may_miss:
                checks.append((c.isNotNull() & c.getField(sub).isNull(), f"{name}.{sub}", "missing"))
    checks += [(F.lit(True), c, "unknown") for c in rows.columns if c not in attrs]
    found = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(n).alias("attribute"), F.lit(i).alias("issue"))) for bad, n, i in checks])) if checks else F.array()
    if not checks:
        return rows.select(F.col(id_column).alias("id"), F.lit("").alias("attribute"), F.lit("").alias("issue")).where("false")
    return rows.select(F.col(id_column).alias("id"), F.explode(found).alias("v")).select("id", "v.attribute", "v.issue")


def forbidden(db: Database, collection: str, operation: str, rows: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """Rows of a write that no role of the session allows; ``rows`` are tried in the place of the collection.

    Other collections are read as ``db`` has them, which is the state after the
    write. ``before`` has the entities that ``$prev`` reads.
    """
    ctx = db.context()
    query = Query(collection, filters=permission_filter(collection, operation, ctx))
    if not query.filters:
        return rows.where("false")
    own, id_column = replace(ctx, skip_rules=True), ctx.id_of(collection)
    frame = scan(collection, rows)
    if before is not None:
        held = {c: f"__prev_{c}" for c in before.columns}
        prev = before.select([F.col(c).alias(n) for c, n in held.items()])
        frame.df = frame.df.join(prev, frame.column(id_column, own) == F.col(held[id_column]), "left")
        frame.ancestors = [held]
    frame = Compiler(db.catalog.frame, own).filtered(frame, query)
    allowed = frame.df.select(frame.column(id_column, own).alias(id_column))
    return rows.join(allowed, id_column, "left_anti")


@dataclass(frozen=True)
class Transaction:
    """Writes over a database; each gives a new transaction, and reads see what was written.

    Nothing is changed before :meth:`commit`, so leaving a transaction drops it.
    The commit writes the changesets once, so later reads begin at them.
    """

    db: Database
    base: Database
    #: Changes by collection in their order.
    changes: tuple[tuple[str, DataFrame], ...] = ()
    #: The time that all its defaults have.
    now: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    @classmethod
    def begin(cls, db: Database) -> Transaction:
        return cls(db, db)

    def _write(self, collection: str, changes: DataFrame, operation: str) -> Transaction:
        id_column = self.db.context().id_of(collection)
        db = self.db.apply_changes({collection: changes})
        ids = changes.select(id_column).distinct()
        before, after = (d.catalog.some(collection, ids, id_column) for d in (self.db, db))
        steps = [operation, "postUpdate"] if operation == "update" and self._has_rule(collection, "postUpdate") else [operation]
        for step in steps:
            prev = before if step == "postUpdate" else None
            if not forbidden(db, collection, step, before if step in ("update", "delete") else after, prev).isEmpty():
                raise errors.WritePermissionError(f"{step} in {collection!r} isn't permitted")
        return replace(self, db=db, changes=(*self.changes, (collection, changes)))

    def _has_rule(self, collection: str, operation: str) -> bool:
        declared = self.db.schema.collections.get(collection)
        return bool(declared and declared.permissions and any(operation in given for given in declared.permissions.values()))

    def insert(self, collection: str, rows: DataFrame) -> Transaction:
        """Insert rows, or merge them into entities that are there."""
        declared = self.db.schema.collections.get(collection)
        id_column = self.db.context().id_of(collection)
        if declared and declared.attrs:
            rows = with_defaults(rows, declared.attrs, self.now)
            bad = violations(rows, declared.attrs, id_column).take(5)
            if bad:
                raise errors.ValidationError("; ".join(f"{r['id']}: {r['attribute']} {r['issue']}" for r in bad))
        return self._write(collection, self._patch(collection, rows, "insert", rows.columns, ()), "insert")

    def update(self, collection: str, rows: DataFrame, whole: tuple[str, ...] = ()) -> Transaction:
        """Patch entities: the columns of ``rows`` besides the id are set. Unknown ids do nothing.

        Of records the members that ``rows`` has are set, to null too, and others
        stay; records whose paths are in ``whole`` are assigned anew, so others become null.
        """
        declared = self.db.schema.collections.get(collection)
        id_column = self.db.context().id_of(collection)
        given = [c for c in rows.columns if c != id_column]
        if declared and declared.attrs:
            attrs = {k: partial(a, rows.schema[k].dataType) for k, a in declared.attrs.items() if k in rows.columns}
            extra = {c: Attr("json") for c in rows.columns if c not in declared.attrs}
            if extra:
                raise errors.ValidationError(f"unknown attributes {', '.join(extra)}")
            if not violations(rows, attrs, id_column).isEmpty():
                raise errors.ValidationError(f"invalid values for {collection!r}")
        return self._write(collection, self._patch(collection, rows, "update", given, whole), "update")

    def update_where(self, collection: str, filters, values: dict[str, Any]) -> Transaction:
        """Patch the entities that match filters by functions of them: attributes, or paths of a record's members, to columns or values.

        A function gets the entity's columns as they are before the write.
        """
        id_column = self.db.context().id_of(collection)
        if {id_column, "id"} & values.keys():
            raise errors.InvalidFilterError("an id can't be changed")
        rows = self.db.fetch(Query(collection, filters=normalize(filters)))
        tree: dict = {}
        for path, value in values.items():
            at, (*above, leaf) = tree, path.split(".")
            for part in above:
                at = at.setdefault(part, {})
            at[leaf] = value if isinstance(value, Column) else F.lit(value)
        built = lambda x: F.struct(*[built(v).alias(k) for k, v in x.items()]) if isinstance(x, dict) else x
        return self.update(collection, rows.select(id_column, *[built(v).alias(k) for k, v in tree.items()]))

    def _patch(self, collection: str, rows: DataFrame, op: str, given: list[str], whole: tuple[str, ...]) -> DataFrame:
        shaped = self._shaped(collection, rows.withColumn("__fields", C.patch_fields(rows, given, whole)), "__fields")
        return C.make_changes(shaped, op, F.lit(0), F.col("__fields")).drop("__fields")

    def delete(self, collection: str, ids: DataFrame) -> Transaction:
        """Delete the entities whose ids are in the first column of ``ids``."""
        id_column = self.db.context().id_of(collection)
        rows = self._shaped(collection, ids.select(F.col(ids.columns[0]).alias(id_column)))
        return self._write(collection, C.make_changes(rows, "delete", F.lit(0), []), "delete")

    def delete_all(self, collection: str) -> Transaction:
        return self.delete(collection, self.db.catalog.frame(collection).select(self.db.context().id_of(collection)))

    def _shaped(self, collection: str, rows: DataFrame, *more: str) -> DataFrame:
        """Rows with the collection's columns and types, nulls where they have none, and more columns as they are."""
        kind: T.StructType = self.db.catalog.types(collection)
        return rows.select([_fitted(F.col(f"`{f.name}`"), rows.schema[f.name].dataType, f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields] + list(more))

    def fetch(self, query: Query) -> DataFrame:
        return self.db.fetch(query)

    def commit(self) -> Database:
        return replace(self.db, catalog=self.db.catalog.settled()) if self.changes else self.db


def partial(attr: Attr, given: T.DataType) -> Attr:
    """An attribute as a patch has to meet it: of a record only the members that are given."""
    if attr.kind != "record" or not isinstance(given, T.StructType):
        return attr
    return replace(attr, fields=tuple((k, partial(a, given[k].dataType)) for k, a in attr.fields if k in given.names))


def _fitted(c: Column, given: T.DataType, kind: T.DataType) -> Column:
    """A value in a collection's type; members that a record lacks are null."""
    if not (isinstance(given, T.StructType) and isinstance(kind, T.StructType)):
        return c.cast(kind)
    members = [_fitted(c.getField(f.name), given[f.name].dataType, f.dataType) if f.name in given.names else F.lit(None).cast(f.dataType) for f in kind.fields]
    return F.when(c.isNotNull(), F.struct(*[m.alias(f.name) for m, f in zip(members, kind.fields, strict=True)]))


def bulk_insert(db: Database, entities: dict[str, DataFrame]) -> Database:
    """Insert rows into several collections at once; an error leaves ``db`` as it was."""
    tx = Transaction.begin(db)
    for collection, rows in entities.items():
        tx = tx.insert(collection, rows)
    return tx.commit()


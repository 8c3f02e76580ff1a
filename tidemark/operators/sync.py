"""What a client and a server know of each other, as frames: the outbox, the union of a connection's results, and schema compatibility."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..db import Database
from ..plans.ast import identity
from ..schema import Schema, json_schema
from . import changes as C
from .evolve import Edit, diff_schemas

Changes = dict[str, DataFrame]


@dataclass(frozen=True)
class Outbox:
    """Writes that a server hasn't confirmed: those that were sent, and those since, each as changesets by collection in their order.

    Each step gives a new outbox; nothing is computed before a frame is read.
    """

    locked: tuple[Changes, ...] = ()
    open: tuple[Changes, ...] = ()

    def write(self, changes: Changes) -> Outbox:
        return replace(self, open=(*self.open, changes))

    def lock(self) -> Outbox:
        """What is open is to be sent; while something is already, that stays and nothing is added to it."""
        return self if self.locked else Outbox(self.open, ())

    def to_send(self, db: Database) -> Changes:
        """What was locked as one changeset for each collection."""
        return self._merged(db, self.locked)

    def acknowledge(self, db: Database) -> tuple[Outbox, Database]:
        """The server has what was sent: it is part of the confirmed database now."""
        for changes in self.locked:
            db = db.apply_changes(changes)
        return replace(self, locked=()), db

    def rebase(self) -> Outbox:
        """Sending failed: what was locked is open again, before what came since."""
        return Outbox((), (*self.locked, *self.open))

    def roll_back(self) -> Outbox:
        """The server refuses what was sent: it is forgotten."""
        return replace(self, locked=())

    def seen(self, confirmed: Database) -> Database:
        """The database as the client sees it, its own writes over what is confirmed."""
        for changes in (*self.locked, *self.open):
            confirmed = confirmed.apply_changes(changes)
        return confirmed

    @staticmethod
    def _merged(db: Database, parts: tuple[Changes, ...]) -> Changes:
        id_of = db.context().id_of
        names = dict.fromkeys(n for changes in parts for n in changes)
        return {n: C.merge_changes(*[c[n] for c in parts if n in c], id_column=id_of(n)) for n in names}


def entity_frames(df: DataFrame, collection: str, includes: dict[str, tuple] | None = None) -> Changes:
    """The entities of a nested result by collection, as rows without includes.

    ``includes`` maps an alias to ``(collection, includes below)``.
    """
    includes = includes or {}
    out = {collection: df.drop(*includes)}
    for alias, (child, below) in includes.items():
        many = isinstance(df.schema[alias].dataType, T.ArrayType)
        rows = df.select(F.explode(alias).alias("e")) if many else df.where(F.col(alias).isNotNull()).select(F.col(alias).alias("e"))
        for name, frame in entity_frames(rows.select("e.*"), child, below).items():
            out[name] = out[name].unionByName(frame) if name in out else frame
    return out


@dataclass(frozen=True)
class Connection:
    """The results that a client was sent, by query. What differs is what has to be sent."""

    db: Database
    results: dict[str, Changes] = field(default_factory=dict)

    def entities(self) -> Changes:
        """The union of all results: each entity once."""
        id_of, out = self.db.context().id_of, {}
        for result in self.results.values():
            for name, frame in result.items():
                out[name] = out[name].unionByName(frame) if name in out else frame
        return {name: frame.dropDuplicates([id_of(name)]) for name, frame in out.items()}

    def answer(self, query: str, entities: Changes | None) -> tuple[Connection, Changes]:
        """A query's new result, None where it ended: the connection after it, and the changesets that bring the client there.

        An entity that another query still has isn't deleted.
        """
        results = {k: v for k, v in self.results.items() if k != query}
        after = replace(self, results={**results, query: entities} if entities is not None else results)
        old, new, id_of, out = self.entities(), after.entities(), self.db.context().id_of, {}
        for name in dict.fromkeys([*old, *new]):
            some = new[name] if name in new else old[name]
            a, b = old.get(name, some.where("false")), new.get(name, some.where("false"))
            found = C.diff(a, b, id_of(name)).withColumnRenamed(id_of(name), "__id")
            rows = found.join(b, F.col("__id") == F.col(id_of(name)), "left")
            fields = F.when(F.col(C.OP) == "insert", F.array(*[F.lit(c) for c in some.columns])).when(F.col(C.OP) == "update", F.col("changed")).otherwise(F.array().cast("array<string>"))
            values = [F.col("__id").alias(c) if c == id_of(name) else F.col(f"`{c}`") for c in some.columns]
            out[name] = rows.select(F.lit(0).cast("long").alias(C.SEQ), F.col(C.OP), fields.alias(C.FIELDS), *values)
        return after, out


def schema_hash(schema: Schema) -> str:
    """A digest of what a client reads by a schema: attributes and relationships."""
    relations = {n: {k: [identity(r.query), r.cardinality] for k, r in sorted(c.relationships.items())} for n, c in sorted(schema.collections.items())}
    return hashlib.sha256(json.dumps([json_schema(schema), relations], sort_keys=True, default=str).encode()).hexdigest()


def handshake(client: Schema | None, server: Schema | None, compatible: tuple[str, ...] = ()) -> tuple[bool, tuple[Edit, ...]]:
    """Whether a client with its schema may sync, and the edits that keep it from it.

    A client without a schema may; a server without one can't serve a client that
    has one. Else the schemas' digests are equal, the client's is among those that
    are known as compatible, or no edit from the one to the other needs a check of data.
    """
    if client is None:
        return True, ()
    if server is None:
        return False, ()
    if schema_hash(client) in (schema_hash(server), *compatible):
        return True, ()
    broken = tuple(e for e in diff_schemas(client, server) if e.needs)
    return not broken, broken

"""The database: collections, a schema, variables and a session's claims; queries and writes over them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, Row

from .plans.ast import Query
from .plans.compile import Compiler
from .plans.prepare import Context, matched_roles, prepare
from .schema import Schema
from .sources.catalog import Catalog, collection_stats


@dataclass(frozen=True)
class Database:
    """Immutable: what changes it gives a new one."""

    catalog: Catalog
    schema: Schema = field(default_factory=Schema)
    globals: dict[str, Any] = field(default_factory=dict)
    claims: dict[str, Any] | None = None
    #: Without a session the caller is trusted.
    skip_rules: bool = True

    def with_session(self, claims: dict[str, Any] | None, skip_rules: bool = False) -> Database:
        """The database as the bearer of a token sees it. A ``scope`` claim is split into ``_scope``."""
        claims = dict(claims or {})
        if isinstance(claims.get("scope"), str):
            claims["_scope"] = claims["scope"].split(" ")
        return replace(self, claims=claims, skip_rules=skip_rules)

    def with_globals(self, **values) -> Database:
        return replace(self, globals={**self.globals, **values})

    def with_collections(self, **frames: DataFrame) -> Database:
        return replace(self, catalog=self.catalog.extended(frames))

    def context(self) -> Context:
        return Context(
            types=self.catalog.types,
            schema=self.schema,
            variables={"global": self.globals, "session": self.claims or {}},
            roles=matched_roles(self.schema, self.claims) if not self.skip_rules else (),
            skip_rules=self.skip_rules,
        )

    def prepared(self, query: Query) -> Query:
        return prepare(query, self.context())

    def fetch(self, query: Query) -> DataFrame:
        return Compiler(self.catalog.frame, self.context()).compile(self.prepared(query))

    def fetch_one(self, query: Query) -> Row | None:
        return next(iter(self.fetch(query.take(1)).collect()), None)

    def fetch_by_id(self, collection: str, value) -> Row | None:
        return self.fetch_one(Query(collection).by_id(value, self.context().id_of(collection)))

    def stats(self) -> DataFrame:
        return collection_stats(self.catalog)

    # Writes give the database after them; the modules of the operators build on this one.

    def transact(self, write) -> Database:
        """``write`` gets a transaction and gives the one to commit; an error leaves everything as it was."""
        from .operators.writes import Transaction

        return write(Transaction.begin(self)).commit()

    def insert(self, collection: str, rows: DataFrame) -> Database:
        return self.transact(lambda tx: tx.insert(collection, rows))

    def update(self, collection: str, rows: DataFrame) -> Database:
        return self.transact(lambda tx: tx.update(collection, rows))

    def update_where(self, collection: str, filters, values: dict[str, Any]) -> Database:
        return self.transact(lambda tx: tx.update_where(collection, filters, values))

    def delete(self, collection: str, ids: DataFrame) -> Database:
        return self.transact(lambda tx: tx.delete(collection, ids))

    def apply_changes(self, changes: dict[str, DataFrame]) -> Database:
        """Changesets of a trusted source, without rules and validation."""
        return replace(self, catalog=self.catalog.applied(changes, self.context().id_of))

    def clear(self) -> Database:
        return self.with_collections(**{n: self.catalog.frame(n).where("false") for n in self.catalog.names})

    def override_schema(self, schema: Schema, fail_on_incompatible: bool = True):
        from .operators.evolve import override_schema

        return override_schema(self, schema, fail_on_incompatible)

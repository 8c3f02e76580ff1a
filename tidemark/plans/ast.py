"""Queries and filters as immutable values."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from .. import errors

OPERATORS = ("=", "!=", "<", "<=", ">", ">=", "like", "nlike", "in", "nin", "has", "!has", "isDefined")
FLIPPED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass(frozen=True)
class Var:
    """A variable. ``scope`` is a level (1 is the parent) or one of query, global, session, role, prev."""

    scope: int | str
    path: str

    def __str__(self):
        return f"${self.scope}.{self.path}"


STATIC = ("query", "global", "session", "role", "prev")


def parse_value(value: Any, level: int = 1) -> Any:
    """Strings that begin with $ are variables; without a scope they mean ``level``."""
    if isinstance(value, str) and value.startswith("$") and len(value) > 1:
        scope, _, rest = value[1:].partition(".")
        if scope == "token":
            scope = "session"
        if scope in STATIC and rest:
            return Var(scope, rest)
        if scope.isdigit() and rest:
            return Var(int(scope), rest)
        return Var(level, value[1:])
    if isinstance(value, (list, tuple, set, frozenset)):
        return tuple(value)
    return value


@dataclass(frozen=True)
class Cond:
    """``path op value``."""

    path: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Group:
    """``and`` or ``or`` of filters."""

    mode: str
    filters: tuple


@dataclass(frozen=True)
class Exists:
    """The parent stays where the query has a row."""

    query: Query


@dataclass(frozen=True)
class RelationExists:
    """Exists by the name of a relationship, or a path of names."""

    path: str
    where: tuple = ()


Filter = Cond | Group | Exists | RelationExists | bool


def and_(*filters) -> Group:
    return Group("and", normalize(filters))


def or_(*filters) -> Group:
    return Group("or", normalize(filters))


def exists(query_or_path, *where) -> Filter:
    if isinstance(query_or_path, Query):
        return Exists(query_or_path)
    return RelationExists(query_or_path, normalize(where))


def normalize(filters: Iterable) -> tuple:
    """Filters from ``("a", "=", 1)`` alone, tuples, lists of these, and filter objects; None is left out."""
    items = list(filters)
    if len(items) in (2, 3) and isinstance(items[0], str) and items[1] in OPERATORS:
        items = [tuple(items)]
    out: list = []
    for f in items:
        if f is None:
            continue
        if isinstance(f, (Cond, Group, Exists, RelationExists, bool)):
            out.append(f)
        elif isinstance(f, tuple) and len(f) in (2, 3) and isinstance(f[0], str) and isinstance(f[1], str):
            if f[1] not in OPERATORS:
                raise errors.InvalidFilterError(f"no operator {f[1]!r}")
            out.append(Cond(f[0], f[1], parse_value(f[2] if len(f) == 3 else True)))
        elif isinstance(f, (list, tuple)):
            out += normalize(f)
        else:
            raise errors.InvalidFilterError(f"not a filter: {f!r}")
    return tuple(out)


@dataclass(frozen=True)
class Include:
    """A nested result: a relationship by name, with clauses that extend it, or a query."""

    relation: str | None = None
    query: Query | None = None
    cardinality: str | None = None


@dataclass(frozen=True)
class Query:
    """A query over one collection. Each clause gives a new query.

    ``where``, ``order`` and ``include`` add to what was there, the others replace it.
    """

    collection: str
    selected: tuple | None = None
    filters: tuple = ()
    ordering: tuple = ()
    limit: int | None = None
    cursor: tuple | None = None
    variables: tuple = ()
    includes: tuple = ()

    def select(self, *paths) -> Query:
        flat = [p for x in paths for p in (x if isinstance(x, (list, tuple)) else [x])]
        return replace(self, selected=tuple(flat) if flat else None)

    def where(self, *filters) -> Query:
        return replace(self, filters=self.filters + normalize(filters))

    def by_id(self, value, id_column: str = "id") -> Query:
        """Only the given ids; replaces an earlier filter on the id."""
        ids = value if isinstance(value, (list, tuple, set)) else None
        kept = tuple(f for f in self.filters if not (isinstance(f, Cond) and f.path == id_column and f.op in ("=", "in")))
        return replace(self, filters=(*kept, Cond(id_column, "in", tuple(ids)) if ids is not None else Cond(id_column, "=", parse_value(value))))

    def order(self, *clauses) -> Query:
        if len(clauses) == 2 and all(isinstance(c, str) for c in clauses) and clauses[1].upper() in ("ASC", "DESC"):
            clauses = (clauses,)
        flat: list = []
        for c in clauses:
            flat += [(c, "ASC")] if isinstance(c, str) else [tuple(c)] if isinstance(c[0], str) else [tuple(x) for x in c]
        for c in flat:
            if len(c) != 2 or str(c[1]).upper() not in ("ASC", "DESC"):
                raise errors.InvalidOrderClauseError(f"not an order: {c!r}")
        return replace(self, ordering=self.ordering + tuple((p, d.upper()) for p, d in flat))

    def take(self, n: int | None) -> Query:
        return replace(self, limit=n)

    def after(self, values, inclusive: bool = False) -> Query:
        """Rows after the one with the given values of the order's keys."""
        return replace(self, cursor=None if values is None else (tuple(values) if isinstance(values, (list, tuple)) else (values,), inclusive))

    def vars(self, **values) -> Query:
        return replace(self, variables=tuple(values.items()))

    def include(self, alias: str, source: Query | None = None, cardinality: str | None = None, relation: str | None = None, extend: Callable[[Query], Query] | None = None) -> Query:
        """Nest rows under ``alias``: of a query, or of the relationship of that name (or ``relation``).

        ``extend`` adds clauses to the relationship's query.
        """
        if source is not None:
            item = Include(None, source, cardinality or "many")
        else:
            item = Include(relation or alias, extend(Query("")) if extend else None, cardinality)
        return replace(self, includes=(*(x for x in self.includes if x[0] != alias), (alias, item)))

    def subquery_one(self, alias: str, query: Query) -> Query:
        return self.include(alias, query, "one")

    def subquery_many(self, alias: str, query: Query) -> Query:
        return self.include(alias, query, "many")


def Q(collection: str) -> Query:
    return Query(collection)


def merged(base: Query, extra: Query | None) -> Query:
    """A relationship's query with what extends it: filters add up, the other clauses win where they are given."""
    if extra is None:
        return base
    return replace(
        base,
        selected=extra.selected if base.selected is None else base.selected if extra.selected is None else base.selected + extra.selected,
        filters=base.filters + extra.filters,
        ordering=extra.ordering or base.ordering,
        limit=base.limit if extra.limit is None else extra.limit,
        cursor=extra.cursor or base.cursor,
        variables=base.variables + extra.variables,
        includes=base.includes + extra.includes,
    )


def flat_filters(filters: Iterable) -> Iterator:
    """All filters but groups, at any depth of groups."""
    for f in filters:
        if isinstance(f, Group):
            yield from flat_filters(f.filters)
        else:
            yield f


def map_conditions(filters: tuple, change: Callable[[Cond, int], Filter], level: int = 0) -> tuple:
    """Filters with each condition replaced; ``level`` is the depth of subqueries around it."""
    out: list = []
    for f in filters:
        if isinstance(f, Cond):
            out.append(change(f, level))
        elif isinstance(f, Group):
            out.append(replace(f, filters=map_conditions(f.filters, change, level)))
        elif isinstance(f, Exists):
            out.append(Exists(replace(f.query, filters=map_conditions(f.query.filters, change, level + 1))))
        elif isinstance(f, RelationExists):
            out.append(replace(f, where=map_conditions(f.where, change, level + 1 + f.path.count("."))))
        else:
            out.append(f)
    return tuple(out)


def shifted(filters: tuple, by: int) -> tuple:
    """Filters moved ``by`` subqueries deeper: levels that point out of them grow."""

    def change(c: Cond, level: int) -> Cond:
        if isinstance(c.value, Var) and isinstance(c.value.scope, int) and c.value.scope > level:
            return replace(c, value=Var(c.value.scope + by, c.value.path))
        return c

    return map_conditions(filters, change)


def levels_used(query: Query) -> dict[int, set[str]]:
    """Paths of ancestors that a query's filters, includes and subqueries read, by level (1: the parent)."""
    found: dict[int, set[str]] = {}

    def visit(filters, depth):
        for f in flat_filters(filters):
            if isinstance(f, Cond) and isinstance(f.value, Var) and isinstance(f.value.scope, int) and f.value.scope > depth:
                found.setdefault(f.value.scope - depth, set()).add(f.value.path)
            elif isinstance(f, Exists):
                visit(f.query.filters, depth + 1)

    def nested(q, depth):
        visit(q.filters, depth)
        for _, item in q.includes:
            if item.query is not None:
                nested(item.query, depth + 1)

    nested(query, 0)
    return found


def simplified(filters: tuple) -> tuple:
    """Constants folded, groups flattened, repeats dropped; ``(False,)`` where nothing can match."""
    out: list = []
    for f in filters:
        if isinstance(f, Group):
            inner = simplified(f.filters) if f.mode == "and" else _any(f.filters)
            if f.mode == "and":
                out += inner
                continue
            if inner is None:
                continue
            f = inner
        elif isinstance(f, Exists):
            inner = simplified(f.query.filters)
            f = False if inner == (False,) else Exists(replace(f.query, filters=inner))
        if f is False:
            return (False,)
        if f is not True and f not in out:
            out.append(f)
    return tuple(out)


def _any(filters: tuple):
    """An ``or`` simplified: one filter, True or False; None for an empty group, which says nothing."""
    if not filters:
        return None
    out: list = []
    for f in filters:
        if isinstance(f, Group) and f.mode == "or":
            inner = _any(f.filters)
            parts = inner.filters if isinstance(inner, Group) and inner.mode == "or" else () if inner is None else (inner,)
        else:
            inner = simplified((f,))
            parts = (True,) if not inner else inner if len(inner) == 1 else (Group("and", inner),)
        for p in parts:
            if p is True:
                return True
            if p is not False and p not in out:
                out.append(p)
    if not out:
        return False
    return out[0] if len(out) == 1 else Group("or", tuple(out))


def _shape(x: Any) -> str:
    if isinstance(x, Query):
        parts = (x.collection, sorted(x.selected) if x.selected is not None else None, sorted(map(_shape, x.filters)), x.ordering, x.limit, x.cursor, sorted(map(repr, x.variables)), sorted((a, _shape(i)) for a, i in x.includes))
        return repr(parts)
    if isinstance(x, Group):
        return f"{x.mode}{sorted(map(_shape, x.filters))}"
    if isinstance(x, Exists):
        return f"exists{_shape(x.query)}"
    if isinstance(x, RelationExists):
        return f"exists {x.path}{sorted(map(_shape, x.where))}"
    if isinstance(x, Include):
        return f"{x.relation} {x.cardinality} {_shape(x.query) if x.query is not None else None}"
    return repr(x)


def identity(query: Query) -> str:
    """A digest that is equal for queries that differ in the order of filters, selected paths and includes only."""
    return hashlib.sha256(_shape(query).encode()).hexdigest()

"""Preparation of a query: relationships and permissions filled in, static variables replaced, clauses checked."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from .. import errors
from ..schema import OPERATORS, Relationship, Schema, match_role
from .ast import FLIPPED, Cond, Exists, Filter, Group, Include, Query, RelationExists, Var, flat_filters, map_conditions, merged, normalize, shifted, simplified


@dataclass(frozen=True)
class Context:
    """What a query is prepared with: types of the collections' columns, schema, variables and roles."""

    types: Any  # name of a collection -> StructType
    schema: Schema = field(default_factory=Schema)
    variables: dict[str, dict] = field(default_factory=dict)
    roles: tuple[tuple[str, dict], ...] = ()
    skip_rules: bool = True
    #: Collections whose permission is being filled in.
    inside: tuple[str, ...] = ()
    #: Collections of the queries around the one that is prepared, the nearest last.
    above: tuple[str, ...] = ()

    def below(self, collection: str) -> Context:
        """The context of a subquery of a query over a collection."""
        return replace(self, above=(*self.above, collection))

    def id_of(self, collection: str) -> str:
        found = self.schema.collections.get(collection)
        return found.id if found else "id"

    def is_keyed(self, collection: str) -> bool:
        """Whether ids are unique, as they are unless a collection is declared to hold loose rows."""
        found = self.schema.collections.get(collection)
        return found is not None and found.keyed

    def relationship(self, collection: str, name: str) -> Relationship | None:
        return self.schema.relationship(collection, name)

    def kind(self, collection: str, path: str) -> tuple[str, T.DataType | None]:
        """Kind of a path (string, number, ..., set, record, json) and its type; KeyError where there is none."""
        head, *rest = path.split(".")
        declared = self.schema.collections.get(collection)
        attr = declared.attrs.get(head) if declared else None
        row = self.types(collection)
        if head == "id" and head not in row.names:
            head = self.id_of(collection)
        t: T.DataType = row[head].dataType
        if attr is not None and attr.kind == "json" or isinstance(t, T.VariantType):
            return "json", t
        for part in rest:
            if not isinstance(t, T.StructType):
                raise KeyError(path)
            t = t[part].dataType
        return kind_of(t), t


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.ArrayType):
        return "set"
    if isinstance(t, T.StructType):
        return "record"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    if isinstance(t, T.NumericType):
        return "number"
    return "string"


def matched_roles(schema: Schema, claims: dict | None) -> tuple[tuple[str, dict], ...]:
    found = ((name, match_role(pattern, claims or {})) for name, pattern in schema.roles.items())
    return tuple((name, captured) for name, captured in found if captured is not None)


def lookup(values: Any, path: str) -> Any:
    for part in path.split("."):
        values = values.get(part) if isinstance(values, dict) else None
    return values


def prepare(query: Query, ctx: Context) -> Query:
    """A query whose filters hold conditions, groups and exists only, and whose includes hold queries."""
    if query.variables:
        ctx = replace(ctx, variables={**ctx.variables, "query": {**ctx.variables.get("query", {}), **dict(query.variables)}})
    name = query.collection
    ctx.types(name)  # raises where there is no such collection
    if query.limit is not None and (isinstance(query.limit, bool) or not isinstance(query.limit, int) or query.limit < 0):
        raise errors.InvalidLimitError(f"not a limit: {query.limit!r}")
    _check_select(query, ctx)
    includes = tuple((alias, _include(name, alias, item, ctx)) for alias, item in query.includes)
    filters = _permitted(name, ctx) + tuple(_filter(name, f, ctx) for f in query.filters)
    query = replace(query, filters=simplified(filters), includes=includes, variables=())
    query = _order(query, ctx)
    _check_after(query, ctx)
    return query


def _check_select(query: Query, ctx: Context) -> None:
    for path in query.selected or ():
        if ctx.relationship(query.collection, path.split(".")[0]):
            raise errors.InvalidSelectClauseError(f"{path!r} is a relationship: include it")
        try:
            ctx.kind(query.collection, path)
        except KeyError:
            raise errors.InvalidSelectClauseError(f"no attribute {path!r} in {query.collection!r}") from None


def _permitted(name: str, ctx: Context, operation: str = "read") -> tuple[Filter, ...]:
    """The permission of the matched roles as one filter; empty where the collection is open."""
    declared = ctx.schema.collections.get(name)
    if ctx.skip_rules or declared is None or declared.permissions is None or name in ctx.inside:
        return ()
    ways = []
    for role, captured in ctx.roles:
        given = declared.permissions.get(role, {}).get(operation)
        if given:
            own = replace(ctx, inside=(*ctx.inside, name), variables={**ctx.variables, "role": captured})
            ways.append(Group("and", tuple(_filter(name, f, own) for f in map_conditions(normalize(given), _prev_as_parent))))
    return (Group("or", tuple(ways)),) if ways else (False,)


def permission_filter(name: str, operation: str, ctx: Context) -> tuple[Filter, ...]:
    return simplified(_permitted(name, ctx, operation))


def _prev_as_parent(c: Cond, level: int) -> Cond:
    """``$prev.x`` reads the entity before the write, which stands where a parent would."""
    if isinstance(c.value, Var) and c.value.scope == "prev":
        return replace(c, value=Var(level + 1, c.value.path))
    return c


def with_evidence(query: Query) -> Query:
    """A prepared query with the rows that its exists filters rest on as includes ``_exists_0`` and so on."""
    found = [f for f in flat_filters(query.filters) if isinstance(f, Exists)]
    extra = tuple((f"_exists_{n}", Include(None, with_evidence(f.query), "many")) for n, f in enumerate(found))
    return replace(query, includes=query.includes + extra)


def _filter(name: str, f: Filter, ctx: Context) -> Filter:
    if isinstance(f, bool):
        return f
    if isinstance(f, Group):
        return replace(f, filters=tuple(_filter(name, x, ctx) for x in f.filters))
    if isinstance(f, Exists):
        inner = prepare(replace(f.query, selected=None, ordering=(), limit=None, cursor=None, includes=()), ctx.below(name))
        return Exists(inner)
    if isinstance(f, RelationExists):
        head, _, rest = f.path.partition(".")
        relation = ctx.relationship(name, head)
        if relation is None:
            raise errors.RelationNotFoundError(f"no relationship {head!r} in {name!r}")
        more = (RelationExists(rest, f.where),) if rest else f.where
        return _filter(name, Exists(relation.query.where(*more)), ctx)
    return _condition(name, f, ctx)


def _condition(name: str, f: Cond, ctx: Context) -> Filter:
    head, _, rest = f.path.partition(".")
    relation = ctx.relationship(name, head)
    if relation is not None:
        if not rest:
            raise errors.InvalidFilterError(f"{f.path!r} is a relationship: use exists")
        inner = shifted((replace(f, path=rest),), 1)
        return _filter(name, Exists(relation.query.where(*inner)), ctx)
    try:
        kind, t = ctx.kind(name, f.path)
    except KeyError:
        raise errors.InvalidFilterError(f"no attribute {f.path!r} in {name!r}") from None
    value = f.value
    if isinstance(value, Var) and isinstance(value.scope, int) and (turned := _turned(name, f, value, ctx)) is not None:
        return _filter(name, turned, ctx)
    if isinstance(value, Var) and not isinstance(value.scope, int):
        value = lookup(ctx.variables.get(value.scope, {}), value.path)
        if isinstance(value, (list, set)):
            value = tuple(value)
    allowed = (*OPERATORS[kind_of(t.elementType)], "has", "!has") if kind == "set" else OPERATORS[kind]
    if f.op not in allowed:
        raise errors.InvalidFilterError(f"{f.op!r} isn't an operator of {kind} attribute {f.path!r}")
    if f.op in ("in", "nin") and not (value is None or isinstance(value, (tuple, Var))):
        raise errors.InvalidFilterError(f"{f.op!r} needs a list")
    return Cond(f.path, f.op, value)


def _turned(name: str, f: Cond, value: Var, ctx: Context) -> Filter | None:
    """A condition whose value is a path through an ancestor's relationship, as an exists filter that compares the other way round."""
    ancestor = ctx.above[-value.scope] if value.scope <= len(ctx.above) else None
    head, _, rest = value.path.partition(".")
    relation = ctx.relationship(ancestor, head) if ancestor is not None else None
    if relation is None:
        return None
    if not rest:
        raise errors.InvalidFilterError(f"{value.path!r} is a relationship, not a value")
    if f.op not in FLIPPED:
        raise errors.InvalidFilterError(f"{f.op!r} can't be compared with a path through a relationship")
    # the relationship's own variables read the ancestor, which stands that many levels above this query
    inner = shifted(relation.query.filters, value.scope)
    return Exists(replace(relation.query, filters=(*inner, Cond(rest, FLIPPED[f.op], Var(1, f.path)))))


def _include(name: str, alias: str, item: Include, ctx: Context) -> Include:
    query, cardinality = item.query, item.cardinality or "many"
    if item.relation is not None:
        relation = ctx.relationship(name, item.relation)
        if relation is None:
            raise errors.RelationNotFoundError(f"no relationship {item.relation!r} in {name!r}")
        query, cardinality = merged(relation.query, item.query), item.cardinality or relation.cardinality
    if cardinality not in ("one", "many"):
        raise errors.InvalidIncludeError(f"no cardinality {cardinality!r}")
    if alias in ctx.types(name).names:
        raise errors.InvalidIncludeError(f"{alias!r} is an attribute of {name!r}")
    return Include(None, prepare(query, ctx.below(name)), cardinality)


#: Aliases of hidden includes that an order by relationships reads.
HIDDEN = "__order_"


def _order(query: Query, ctx: Context) -> Query:
    ordering, hidden = [], {}
    for path, direction in query.ordering:
        parts, name, chain = path.split("."), query.collection, []
        while len(parts) > 1 and (relation := ctx.relationship(name, parts[0])):
            if relation.cardinality != "one":
                raise errors.InvalidOrderClauseError(f"{path!r} passes a relationship of many")
            chain.append((parts.pop(0), relation))
            name = relation.query.collection
        last = ".".join(parts)
        try:
            kind, _ = ctx.kind(name, last)
        except KeyError:
            raise errors.InvalidOrderClauseError(f"no attribute {path!r} to order {query.collection!r} by") from None
        if kind in ("set", "record"):
            raise errors.InvalidOrderClauseError(f"a {kind} has no order: {path!r}")
        if chain:
            alias = HIDDEN + str(len(hidden))
            hidden[alias] = _chain(chain, last, ctx.below(query.collection))
            path = ".".join([alias, *(n for n, _ in chain[1:]), last])
        ordering.append((path, direction))
    return replace(query, ordering=tuple(ordering), includes=query.includes + tuple(hidden.items()))


def _chain(chain: list, last: str, ctx: Context) -> Include:
    (_, relation), *rest = chain
    query = relation.query.select(last.split(".")[0]) if not rest else relation.query.select(ctx.id_of(relation.query.collection))
    prepared = prepare(query, ctx)
    if rest:
        prepared = replace(prepared, includes=((rest[0][0], _chain(rest, last, ctx.below(query.collection))),))
    return Include(None, prepared, "one")


def _check_after(query: Query, ctx: Context) -> None:
    if query.cursor is None:
        return
    values, _ = query.cursor
    if not query.ordering or len(values) != len(query.ordering):
        raise errors.InvalidAfterClauseError("a cursor needs an order with as many keys as it has values")
    if any(p.startswith(HIDDEN) for p, _ in query.ordering):
        raise errors.InvalidAfterClauseError("a cursor can't follow an order by relationships")


def collections_of(query: Query) -> set[str]:
    """All collections that a prepared query reads."""
    found = {query.collection}
    for f in flat_filters(query.filters):
        if isinstance(f, Exists):
            found |= collections_of(f.query)
    for _, item in query.includes:
        if item.query is not None:
            found |= collections_of(item.query)
    return found

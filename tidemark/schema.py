"""Schemas: attribute types, collections, relationships, roles and permissions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from . import errors
from .plans.ast import Query

COMPARE = ("=", "!=", "<", "<=", ">", ">=")
#: Operators that each type of attribute allows.
OPERATORS = {
    "boolean": ("isDefined", *COMPARE),
    "date": ("isDefined", *COMPARE),
    "number": ("isDefined", *COMPARE, "in", "nin"),
    "string": ("isDefined", *COMPARE, "in", "nin", "like", "nlike"),
    "record": ("isDefined",),
    "json": ("isDefined", *COMPARE, "in", "nin", "like", "nlike", "has", "!has"),
}
PRIMITIVES = ("string", "number", "boolean", "date")


@dataclass(frozen=True)
class Attr:
    """An attribute's type. ``of`` is a set's element type, ``fields`` a record's members."""

    kind: str
    nullable: bool = False
    optional: bool = False
    enum: tuple = ()
    default: Any = None
    of: str | None = None
    fields: tuple = ()

    @property
    def may_miss(self) -> bool:
        return self.nullable or self.optional

    def spark_type(self) -> T.DataType:
        if self.kind == "set":
            return T.ArrayType(Attr(self.of).spark_type())
        if self.kind == "record":
            return T.StructType([T.StructField(k, a.spark_type(), a.may_miss) for k, a in self.fields])
        return {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "date": T.TimestampType(), "json": T.StringType()}[self.kind]


def string(**kw) -> Attr:
    return Attr("string", **{**kw, "enum": tuple(kw.get("enum", ()))})


def number(**kw) -> Attr:
    return Attr("number", **kw)


def boolean(**kw) -> Attr:
    return Attr("boolean", **kw)


def date(**kw) -> Attr:
    return Attr("date", **kw)


def json(**kw) -> Attr:
    return Attr("json", **kw)


def set_of(of: str, **kw) -> Attr:
    return Attr("set", of=of, **kw)


def record(fields: dict[str, Attr], **kw) -> Attr:
    return Attr("record", fields=tuple(fields.items()), **kw)


def identifier(default: str = "nanoid") -> Attr:
    return Attr("string", default={"fn": default})


@dataclass(frozen=True)
class Relationship:
    """A stored query and how many rows it gives."""

    query: Query
    cardinality: str = "many"


def many(collection: str, *where, **clauses) -> Relationship:
    return Relationship(Query(collection, **clauses).where(*where), "many")


def one(collection: str, *where, **clauses) -> Relationship:
    return Relationship(Query(collection, **{**clauses, "limit": 1}).where(*where), "one")


def by_id(collection: str, reference: str, id_column: str = "id") -> Relationship:
    return one(collection, (id_column, "=", reference))


@dataclass(frozen=True)
class Collection:
    """A named bag of entities. Attributes that aren't declared take the type of the source's column.

    ``permissions`` maps a role to ``{operation: filters}`` with the operations
    read, insert, update, postUpdate and delete; None leaves the collection open.
    """

    name: str
    attrs: dict[str, Attr] = field(default_factory=dict)
    id: str = "id"
    relationships: dict[str, Relationship] = field(default_factory=dict)
    permissions: dict[str, dict[str, tuple]] | None = None
    #: Whether the id column is unique; False for tables of rows without a key.
    keyed: bool = True

    def with_permissions(self, permissions) -> Collection:
        return replace(self, permissions=permissions)


@dataclass(frozen=True)
class Schema:
    collections: dict[str, Collection] = field(default_factory=dict)
    roles: dict[str, dict] = field(default_factory=dict)

    @classmethod
    def of(cls, *collections: Collection, roles: dict[str, dict] | None = None) -> Schema:
        return cls({c.name: c for c in collections}, {**DEFAULT_ROLES, **(roles or {})})

    def relationship(self, collection: str, name: str) -> Relationship | None:
        found = self.collections.get(collection)
        return found.relationships.get(name) if found else None


#: Roles that every schema has.
DEFAULT_ROLES = {"anonymous": {"x-tidemark-token-type": "anon"}, "authenticated": {"sub": "$sub"}}


def match_role(pattern: Any, claims: Any, found: dict | None = None) -> dict | None:
    """Variables that a pattern captures from the claims, None where it doesn't match.

    A string ``$name`` in the pattern takes any value that isn't missing.
    """
    found = {} if found is None else found
    if isinstance(pattern, str) and pattern.startswith("$"):
        if claims is None or found.get(pattern[1:], claims) != claims:
            return None
        found[pattern[1:]] = claims
        return found
    if isinstance(pattern, dict):
        if not isinstance(claims, dict):
            return None
        for k, p in pattern.items():
            if match_role(p, claims.get(k), found) is None:
                return None
        return found
    if isinstance(pattern, (list, tuple)):
        if not isinstance(claims, (list, tuple)) or len(pattern) != len(claims):
            return None
        for p, c in zip(pattern, claims, strict=True):
            if match_role(p, c, found) is None:
                return None
        return found
    return found if pattern == claims else None


def validate(schema: Schema) -> list[str]:
    """What is wrong with a schema; empty where nothing is."""
    issues = []
    name = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")

    def check_attr(where: str, key: str, a: Attr):
        if not name.match(key):
            issues.append(f"{where}: {key!r} isn't a name")
        if a.kind not in ("set", *OPERATORS):
            issues.append(f"{where}.{key}: unknown type {a.kind!r}")
        if a.kind == "set" and a.of not in PRIMITIVES:
            issues.append(f"{where}.{key}: a set holds {', '.join(PRIMITIVES)}")
        if a.enum and a.kind != "string":
            issues.append(f"{where}.{key}: only strings have an enum")
        if a.enum and isinstance(a.default, str) and a.default not in a.enum:
            issues.append(f"{where}.{key}: the default isn't in the enum")
        if isinstance(a.default, dict) and a.default.get("fn") not in DEFAULTS.get(a.kind, ()):
            issues.append(f"{where}.{key}: no default function {a.default.get('fn')!r} for {a.kind}")
        if a.kind == "record" and a.default is not None:
            issues.append(f"{where}.{key}: a record has no default of its own")
        for k, f in a.fields:
            check_attr(f"{where}.{key}", k, f)

    for c in schema.collections.values():
        if not name.match(c.name):
            issues.append(f"{c.name!r} isn't a name")
        for k, a in c.attrs.items():
            check_attr(c.name, k, a)
        if c.id in c.attrs and c.attrs[c.id].may_miss:
            issues.append(f"{c.name}.{c.id}: an id is never missing")
        for k, r in c.relationships.items():
            if k in c.attrs:
                issues.append(f"{c.name}.{k}: an attribute and a relationship of one name")
            if r.query.collection not in schema.collections:
                issues.append(f"{c.name}.{k}: no collection {r.query.collection!r}")
            if r.cardinality not in ("one", "many"):
                issues.append(f"{c.name}.{k}: no cardinality {r.cardinality!r}")
        for role, given in (c.permissions or {}).items():
            if role not in schema.roles:
                issues.append(f"{c.name}: no role {role!r}")
            issues += [f"{c.name}: no operation {op!r}" for op in given if op not in ("read", "insert", "update", "postUpdate", "delete")]
    return issues


#: Functions that may give a default, by type.
DEFAULTS = {"string": ("nanoid", "uuid", "uuidv4", "uuidv7"), "date": ("now",), "set": ("empty",)}


def checked(schema: Schema) -> Schema:
    if issues := validate(schema):
        raise errors.SchemaError("; ".join(issues))
    return schema


def json_schema(schema: Schema) -> dict:
    """JSON Schema of all collections."""

    def attr(a: Attr) -> dict:
        out: dict = {
            "string": {"type": "string"},
            "number": {"type": "number"},
            "boolean": {"type": "boolean"},
            "date": {"type": "string", "format": "date-time"},
            "json": {},
        }.get(a.kind, {}).copy()
        if a.kind == "set":
            out = {"type": "array", "uniqueItems": True, "items": attr(Attr(a.of))}
        if a.kind == "record":
            out = members(dict(a.fields))
        if a.enum:
            out["enum"] = list(a.enum)
        if a.default is not None and not isinstance(a.default, dict):
            out["default"] = a.default
        if a.nullable and "type" in out:
            out["type"] = [out["type"], "null"]
        return out

    def members(attrs: dict[str, Attr]) -> dict:
        return {
            "type": "object",
            "properties": {k: attr(a) for k, a in attrs.items()},
            "required": [k for k, a in attrs.items() if not a.optional and a.default is None],
            "additionalProperties": False,
        }

    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "properties": {c.name: members(c.attrs) for c in schema.collections.values()}}

"""Filter operators as columns that are true or false, never null.

Comparisons with literals are built from ``is null``, ``and`` and ``or`` alone,
so that they reach the scan.

Missing values compare as the least: nothing is less than null, null is less
than everything else. Set operators other than ``has`` ask for some element.
"""

from __future__ import annotations

import datetime
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors

FALSE, TRUE = (lambda: F.lit(False)), (lambda: F.lit(True))


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, TRUE()) if columns else TRUE()


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else FALSE()


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def like_pattern(pattern: str) -> str:
    """A regular expression for the whole value: % is any characters but line feeds, _ one, case is ignored."""
    body = "".join(".*" if c == "%" else "." if c == "_" else re.sub(r"([^\w\s])", r"\\\1", c) for c in pattern)
    return rf"(?iu)\A{body}\z"


def literal(value: Any, kind: T.DataType | None = None) -> Column:
    if isinstance(value, str) and isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(value).cast(kind)
    if isinstance(value, datetime.datetime) and isinstance(kind, T.TimestampNTZType):
        return F.lit(value.replace(tzinfo=None).isoformat()).cast(kind)
    return F.lit(value)


def compare_literal(op: str, c: Column, v: Any, kind: T.DataType | None = None) -> Column:
    """``c op v`` for a literal."""
    if op == "isDefined":
        return c.isNotNull() if v else c.isNull()
    if op in ("in", "nin"):
        values = [literal(x, kind) for x in (v or ()) if x is not None]
        hit = c.isNotNull() & c.isin(*values) if values else FALSE()
        if op == "in":
            return hit
        return c.isNull() | ~c.isin(*values) if values else TRUE()
    if op in ("like", "nlike"):
        if v is None:
            return F.lit(op == "nlike")
        hit = c.rlike(like_pattern(v))
        return c.isNotNull() & hit if op == "like" else c.isNull() | ~hit
    if v is None:
        return {"=": c.isNull, "!=": c.isNotNull, ">": c.isNotNull, ">=": TRUE, "<": FALSE, "<=": c.isNull}[op]()
    x = literal(v, kind)
    if op in ("=", "!="):
        return c.eqNullSafe(x) if op == "=" else ~c.eqNullSafe(x)
    if op in (">", ">="):
        return c.isNotNull() & (c > x if op == ">" else c >= x)
    return c.isNull() | (c < x if op == "<" else c <= x)


def compare_columns(op: str, c: Column, v: Column) -> Column:
    """``c op v`` for columns; both may be null."""
    if op == "=":
        return c.eqNullSafe(v)
    if op == "!=":
        return ~c.eqNullSafe(v)
    both_null = c.isNull() & v.isNull()
    if op == ">":
        return c.isNotNull() & (v.isNull() | (c > v))
    if op == ">=":
        return both_null | (c.isNotNull() & (v.isNull() | (c >= v)))
    if op == "<":
        return v.isNotNull() & (c.isNull() | (c < v))
    if op == "<=":
        return both_null | (v.isNotNull() & (c.isNull() | (c <= v)))
    if op == "in":
        return sure(F.array_contains(v, c))
    if op == "nin":
        return ~sure(F.array_contains(v, c))
    raise errors.InvalidFilterError(f"{op} doesn't compare columns")


def set_predicate(op: str, c: Column, v: Any, element: T.DataType | None = None) -> Column:
    """``c op v`` for a set."""
    if op == "isDefined":
        return c.isNotNull() if v else c.isNull()
    if op in ("has", "!has"):
        hit = FALSE() if v is None else sure(F.array_contains(c, literal(v, element)))
        return hit if op == "has" else ~hit
    if op == "in":
        values = [literal(x, element) for x in (v or ()) if x is not None]
        return sure(F.arrays_overlap(c, F.array(*values))) if values else FALSE()
    return sure(F.exists(c, lambda x: compare_literal(op, x, v, element)))


# Values of JSON are compared across types by a key of (rank, number, string, boolean).
RANKS = {"object": 1, "array": 2, "number": 3, "string": 4, "boolean": 5}


def json_at(c: Column, path: str) -> Column:
    """The value at a dotted path of a JSON string or variant column, as a variant."""
    where = "$" + "".join(f"['{p}']" for p in path.split(".")) if path else "$"
    return F.try_variant_get(c, where, "variant")


def json_key(v: Column) -> Column:
    """A struct that orders variants: null first, then objects, arrays, numbers, strings, booleans."""
    kind = F.schema_of_variant(v)
    is_number = kind.rlike(r"^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")
    rank = (
        F.when(kind.startswith("OBJECT"), RANKS["object"]).when(kind.startswith("ARRAY"), RANKS["array"]).when(is_number, RANKS["number"])
        .when(kind == "STRING", RANKS["string"]).when(kind == "BOOLEAN", RANKS["boolean"])
    )
    text = F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(v)).when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    number = F.when(is_number, F.try_variant_get(v, "$", "double"))
    return F.when(rank.isNotNull(), F.struct(rank.alias("rank"), number.alias("num"), text.alias("str"), F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).alias("bool")))


def json_literal(v: Any) -> Column:
    rank = RANKS["boolean"] if isinstance(v, bool) else RANKS["number"] if isinstance(v, (int, float)) else RANKS["string"]
    number = float(v) if rank == RANKS["number"] else None
    return F.struct(F.lit(rank).alias("rank"), F.lit(number).cast("double").alias("num"), F.lit(v if isinstance(v, str) else None).cast("string").alias("str"), F.lit(v if isinstance(v, bool) else None).cast("boolean").alias("bool"))


def json_predicate(op: str, v_at: Column, v: Any) -> Column:
    """``value op v`` for a JSON value; only values of the literal's type are equal to it.

    The value is bound once, so its text is parsed once however often the rules read it.
    """
    return F.exists(F.array(v_at), lambda x: _json_rule(op, x, v))


def _json_rule(op: str, v_at: Column, v: Any) -> Column:
    key = json_key(v_at)
    if op == "isDefined":
        return key.isNotNull() if v else key.isNull()
    if op in ("like", "nlike"):
        text = F.when(F.schema_of_variant(v_at) == "STRING", F.try_variant_get(v_at, "$", "string"))
        return compare_literal(op, text, v)
    if op in ("has", "!has"):
        items = F.try_variant_get(v_at, "$", "array<variant>")
        hit = FALSE() if v is None else sure(F.exists(items, lambda x: json_key(x).eqNullSafe(json_literal(v))))
        return hit if op == "has" else ~hit
    if op in ("in", "nin"):
        hit = any_of([key.eqNullSafe(json_literal(x)) for x in (v or ()) if x is not None])
        return hit if op == "in" else ~hit
    if v is None:
        return compare_literal(op, key, None)
    x = json_literal(v)
    if op in ("=", "!="):
        return key.eqNullSafe(x) if op == "=" else ~key.eqNullSafe(x)
    if op in (">", ">="):
        return sure(key > x if op == ">" else key >= x)
    return key.isNull() | sure(key < x if op == "<" else key <= x)


def after_predicate(keys: list[tuple[Column, str, T.DataType | None]], values: tuple, inclusive: bool) -> Column:
    """Rows after a cursor: keys and directions of the order, values of the row to follow, null the least."""
    ways = []
    for i, (c, direction, kind) in enumerate(keys):
        same = [k.eqNullSafe(literal(v, t)) for (k, _, t), v in zip(keys[:i], values[:i], strict=True)]
        v = values[i]
        if direction == "ASC":
            beyond = c.isNotNull() if v is None else c.isNotNull() & (c > literal(v, kind))
        else:
            beyond = FALSE() if v is None else c.isNull() | (c < literal(v, kind))
        ways.append(all_of([*same, beyond]))
    if inclusive:
        ways.append(all_of([c.eqNullSafe(literal(v, t)) for (c, _, t), v in zip(keys, values, strict=True)]))
    return any_of(ways)


def sort_key(c: Column, direction: str) -> Column:
    return c.asc_nulls_first() if direction == "ASC" else c.desc_nulls_last()

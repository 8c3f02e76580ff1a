"""Prepared queries as DataFrames.

Exists filters are left-semi joins, or existence joins inside ``or``. Includes
are joins of the distinct values that a parent's subquery depends on with the
child, ranked per parent where there is an order or a limit, and gathered into
an array of structs. Parents are limited before their includes are joined.
Columns of each frame get a name of their own, so that a collection can be
joined with itself.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import predicates as P
from .ast import Cond, Exists, Filter, Group, Include, Query, Var, flat_filters, levels_used
from .prepare import HIDDEN, Context

_counter = itertools.count()


@dataclass
class Frame:
    """A DataFrame, the columns that stand for its collection's attributes, and those that stand for its ancestors'."""

    df: DataFrame
    collection: str
    columns: dict[str, str]
    #: Columns that hold paths of ancestors, nearest first.
    ancestors: list[dict[str, str]] = field(default_factory=list)

    def column(self, path: str, ctx: Context) -> Column:
        head, *rest = path.split(".")
        if head == "id" and head not in self.columns:
            head = ctx.id_of(self.collection)
        c = F.col(f"`{self.columns[head]}`")
        for part in rest:
            c = c.getField(part)
        return c


def _fresh(name: str) -> str:
    return f"__{next(_counter)}_{name}"


def scan(collection: str, source: DataFrame) -> Frame:
    columns = {c: _fresh(c) for c in source.columns}
    return Frame(source.select([F.col(f"`{c}`").alias(n) for c, n in columns.items()]), collection, columns)


class Compiler:
    """Compiles prepared queries over ``sources`` (name of a collection -> DataFrame)."""

    def __init__(self, sources, ctx: Context):
        self.sources, self.ctx = sources, ctx

    # -- filters ---------------------------------------------------------

    def _value(self, frame: Frame, f: Cond, values: dict | None = None) -> Column | None:
        """A condition without variables of ancestors; with them None, unless ``frame`` carries them."""
        kind, t = self.ctx.kind(frame.collection, f.path)
        v = f.value
        if isinstance(v, Var):
            held = frame.ancestors[v.scope - 1] if v.scope <= len(frame.ancestors) else {}
            if v.path not in held:
                return P.compare_literal(f.op, frame.column(f.path, self.ctx), None) if v.scope > len(frame.ancestors) else None
            return self._correlated(frame.column(f.path, self.ctx), kind, f.op, F.col(f"`{held[v.path]}`"), isinstance(frame.df.schema[held[v.path]].dataType, T.ArrayType))
        if kind == "json":
            head, _, rest = f.path.partition(".")
            c = frame.column(head, self.ctx)
            at = P.json_at(c if isinstance(t, T.VariantType) else F.try_parse_json(c), rest)
            return P.json_predicate(f.op, at, v)
        c = frame.column(f.path, self.ctx)
        if kind == "set":
            return P.set_predicate(f.op, c, v, t.elementType)
        return P.compare_literal(f.op, c, v, t)

    def _correlated(self, c: Column, kind: str, op: str, v: Column, v_is_set: bool) -> Column:
        if kind == "set":
            if op in ("has", "!has"):
                hit = P.sure(F.array_contains(c, v))
                return hit if op == "has" else ~hit
            if v_is_set:
                return P.sure(F.arrays_overlap(c, v))
            return P.sure(F.exists(c, lambda x: P.compare_columns(op, x, v)))
        return P.compare_columns(op, c, v)

    def _predicate(self, frame: Frame, f: Filter) -> Column:
        """Any filter as one column; exists become existence joins."""
        if isinstance(f, bool):
            return F.lit(f)
        if isinstance(f, Group):
            parts = [self._predicate(frame, x) for x in f.filters]
            return P.all_of(parts) if f.mode == "and" else P.any_of(parts)
        if isinstance(f, Exists):
            child = self._child(f.query)
            pairs = self._conditions(f.query)
            used = {v.path for c in pairs if isinstance(v := c.value, Var)}
            names = {p: _fresh("outer") for p in used}
            frame.df = frame.df.withColumns({n: frame.column(p, self.ctx) for p, n in names.items()})
            child = self.filtered(child, f.query, skip=set(map(id, pairs)))
            conds = [self._correlated(child.column(c.path, self.ctx), self.ctx.kind(child.collection, c.path)[0], c.op, F.col(names[c.value.path]).outer(), isinstance(frame.df.schema[names[c.value.path]].dataType, T.ArrayType)) for c in pairs]
            return child.df.where(P.all_of(conds)).exists() if conds else child.df.exists()
        return self._value(frame, f)

    def _conditions(self, query: Query) -> list[Cond]:
        """Conditions at the top of a subquery that read the parent."""
        return [f for f in query.filters if isinstance(f, Cond) and isinstance(f.value, Var) and f.value.scope == 1]

    def _child(self, query: Query) -> Frame:
        return scan(query.collection, self.sources(query.collection))

    def filtered(self, frame: Frame, query: Query, skip: set[int] = frozenset()) -> Frame:
        """Conditions first, so that they reach the scan, then groups, then joins."""
        left = [f for f in query.filters if id(f) not in skip]
        plain = [f for f in left if not any(isinstance(x, Exists) for x in flat_filters([f]))]
        for f in plain:
            condition = self._predicate(frame, f)
            frame.df = frame.df.where(condition)
        for f in left:
            if isinstance(f, Exists):
                frame = self._semi(frame, f.query)
            elif f not in plain:
                condition = self._predicate(frame, f)  # may add columns to the frame
                frame.df = frame.df.where(condition)
        return frame

    def _semi(self, frame: Frame, query: Query) -> Frame:
        """Keep the rows of a frame for which a subquery has a row."""
        keys, child, on = self._matched(frame, query, strict=len(self._conditions(query)) == 1)
        if keys is None:  # reads the parent in its own conditions only
            frame.df = frame.df.join(child.df, on, "left_semi") if on is not None else frame.df.where(child.df.exists())
            return frame
        found = child.df.select([F.col(k) for k in keys.values()]).distinct()
        on = P.all_of([frame_col.eqNullSafe(F.col(k)) for frame_col, k in zip(self._sources(frame, keys), keys.values(), strict=True)])
        frame.df = frame.df.join(found, on, "left_semi")
        return frame

    def _sources(self, frame: Frame, keys: dict[tuple[int, str], str]) -> list[Column]:
        """The columns of a frame that keys (level, path) of its child stand for."""
        return [frame.column(path, self.ctx) if level == 1 else F.col(f"`{frame.ancestors[level - 2][path]}`") for level, path in keys]

    def _matched(self, frame: Frame, query: Query, strict: bool = False, keyed: bool = False):
        """Rows of a subquery and how they belong to those of the frame.

        Without deep references and not ``keyed``: ``(None, child, condition)``.
        Else the child is joined with the distinct values of what it reads of its
        ancestors: ``(names of these values, child, None)``.
        """
        used = {(level, p) for level, paths in levels_used(query).items() for p in paths if level <= 1 + len(frame.ancestors)}
        pairs = self._conditions(query)
        deep = used - {(1, c.value.path) for c in pairs} or any(level > 1 for level, _ in used)
        nested = deep or any(level == 1 and (1, p) in used for f in query.filters if isinstance(f, (Group, Exists)) for level, p in self._inner_reads(f))
        child = self._child(query)
        if not nested and not keyed:
            child = self.filtered(child, query, skip=set(map(id, pairs)))
            if len(pairs) == 1:
                child = self._extreme(child, pairs[0], frame)
            conds = []
            for c in pairs:
                v, kind = frame.column(c.value.path, self.ctx), self.ctx.kind(query.collection, c.path)[0]
                frame_kind = self.ctx.kind(frame.collection, c.value.path)[0]
                x = child.column(c.path, self.ctx)
                if frame_kind == "set" or kind == "set":
                    keys, child, _ = self._matched(frame, query, keyed=True)
                    return keys, child, None
                conds.append(x == v if strict and c.op == "=" else self._correlated(x, kind, c.op, v, False))
            return None, child, P.all_of(conds) if conds else None
        keys = {k: _fresh("key") for k in sorted(used)}
        held = frame.df.select([c.alias(n) for c, n in zip(self._sources(frame, keys), keys.values(), strict=True)]).distinct()
        simple = [f for f in query.filters if isinstance(f, Cond) and not isinstance(f.value, Var)]
        child = self.filtered(child, replace(query, filters=tuple(simple)))
        conds, left, drop = [], [], []
        direct = [f for f in query.filters if isinstance(f, Cond) and isinstance(f.value, Var) and (f.value.scope, f.value.path) in keys]
        for c in direct:
            name = keys[c.value.scope, c.value.path]
            kind = self.ctx.kind(query.collection, c.path)[0]
            v_is_set = isinstance(held.schema[name].dataType, T.ArrayType)
            x = child.column(c.path, self.ctx)
            if v_is_set and kind != "set" and c.op == "in":  # an element of the parent's set
                drop.append(part := _fresh("element"))
                held = held.withColumn(part, F.explode(F.array_distinct(F.col(name))))
                conds.append(x == F.col(part))
            elif kind == "set" and not v_is_set and c.op in ("has", "="):  # a set that holds the parent's value
                drop.append(part := _fresh("element"))
                child.df = child.df.withColumn(part, F.explode(F.array_distinct(x)))
                conds.append(F.col(part) == F.col(name))
            else:
                conds.append(x == F.col(name) if strict and c.op == "=" else self._correlated(x, kind, c.op, F.col(name), v_is_set))
        done = set(map(id, direct)) | set(map(id, simple))
        left = [f for f in query.filters if id(f) not in done]
        joined = held.join(child.df, P.all_of(conds), "inner") if keys else child.df
        levels = 1 + len(frame.ancestors)
        ancestors = [{p: n for (lv, p), n in keys.items() if lv == level} for level in range(1, levels + 1)]
        child = Frame(joined.drop(*drop), query.collection, child.columns, ancestors)
        return keys, self.filtered(child, replace(query, filters=tuple(left))), None

    def _extreme(self, child: Frame, c: Cond, frame: Frame) -> Frame:
        """For one inequality, the one row that is nearest to meeting it: no need to meet every pair."""
        kinds = {self.ctx.kind(child.collection, c.path)[0], self.ctx.kind(frame.collection, c.value.path)[0]}
        if c.op not in ("<", "<=", ">", ">=") or kinds & {"set", "json", "record"}:
            return child
        x, name = child.column(c.path, self.ctx), _fresh("extreme")
        if c.op in (">", ">="):
            value = F.max(x)
        else:  # null is the least
            value = F.when(F.count("*") == F.count(x), F.min(x))
        one = child.df.agg(value.alias(name), F.count("*").alias("rows")).where("rows > 0").drop("rows")
        head = c.path.split(".")[0]
        if head not in child.columns or "." in c.path:
            return child
        return Frame(one, child.collection, {head: name}, child.ancestors)

    def _inner_reads(self, f: Filter):
        q = f.query if isinstance(f, Exists) else None
        if q is not None:
            return [(level - 1, p) for level, paths in levels_used(q).items() for p in paths if level > 1]
        return [(c.value.scope, c.value.path) for c in flat_filters([f]) if isinstance(c, Cond) and isinstance(c.value, Var)]

    # -- order, limit ----------------------------------------------------

    def _order_columns(self, frame: Frame, query: Query) -> list[tuple[Column, str, T.DataType | None]]:
        out = []
        for path, direction in query.ordering:
            head, _, rest = path.partition(".")
            if head.startswith(HIDDEN):
                c = F.col(f"`{frame.columns[head]}`")
                for part in rest.split("."):
                    c = c.getField(part)
                out.append((c, direction, None))
                continue
            kind, t = self.ctx.kind(frame.collection, path)
            if kind == "json":
                c = frame.column(head, self.ctx)
                out.append((P.json_key(P.json_at(c if isinstance(t, T.VariantType) else F.try_parse_json(c), rest)), direction, None))
            else:
                out.append((frame.column(path, self.ctx), direction, t))
        return out

    def _sort_keys(self, frame: Frame, query: Query) -> list[Column]:
        keys = [P.sort_key(c, d) for c, d, _ in self._order_columns(frame, query)]
        return [*keys, frame.column(self.ctx.id_of(frame.collection), self.ctx).asc_nulls_first()]

    # -- includes --------------------------------------------------------

    def _by_own_keys(self, query: Query) -> tuple[list[str], list[str], Frame] | None:
        """For subqueries that only ask for equal values: the parent's paths, and the child with columns of these values.

        The child is then gathered by its own columns, in one shuffle, and
        without reading the parent for it.
        """
        pairs = self._conditions(query)
        rest = replace(query, filters=tuple(f for f in query.filters if f not in pairs))
        if not pairs or levels_used(rest) or any(c.op != "=" or self.ctx.kind(query.collection, c.path)[0] in ("set", "json", "record") for c in pairs):
            return None
        child = self.filtered(self._child(query), rest)
        names = [_fresh("key") for _ in pairs]
        child.df = child.df.withColumns({n: child.column(c.path, self.ctx) for n, c in zip(names, pairs, strict=True)})
        return [c.value.path for c in pairs], names, child

    def _finds_by_id(self, query: Query) -> bool:
        """Whether a subquery asks for an id, of which a collection has one row."""
        id_column = self.ctx.id_of(query.collection)
        wanted = {id_column} if "id" in self.ctx.types(query.collection).names else {id_column, "id"}
        return query.limit != 0 and query.cursor is None and any(c.op == "=" and c.path in wanted for c in self._conditions(query)) and self.ctx.is_keyed(query.collection)

    def _include(self, frame: Frame, alias: str, item: Include, few: bool = False) -> Frame:
        """The frame with a column for a nested result. ``few``: the frame is limited, so its values prune the child."""
        query, out = item.query, _fresh(alias)
        direct = None if few else self._by_own_keys(query)
        if direct is not None and not any(isinstance(t, T.ArrayType) for t in (self.ctx.kind(frame.collection, p)[1] for p in direct[0])):
            paths, names, child = direct
            keys = {(1, p): n for p, n in zip(paths, names, strict=True)} if len(set(paths)) == len(paths) else None
        else:
            keys = None
        if keys is None:
            keys, child, _ = self._matched(frame, query, keyed=True)
            names = list(keys.values())
        hidden = [(a, i) for a, i in query.includes if a.startswith(HIDDEN)]
        for a, i in hidden:
            child = self._include(child, a, i)
        if query.cursor is not None:
            child.df = child.df.where(P.after_predicate(self._order_columns(child, query), *query.cursor))
        limit = 1 if item.cardinality == "one" else query.limit
        by_id = self._finds_by_id(query)
        if by_id:
            limit = None  # a row at most without ranking
        if limit is not None and not names:  # one result for all parents
            child.df = child.df.orderBy(*self._sort_keys(child, query)).limit(limit)
        rank = _fresh("rank")
        id_column = self.ctx.id_of(child.collection)
        by_key = limit is None and not by_id and not query.ordering and self.ctx.is_keyed(child.collection)
        partition = Window.partitionBy(*[F.col(n) for n in names]) if names else Window.partitionBy(F.lit(0))
        # in the order of ids the array is sorted by them when it is there; another order or a limit ranks the rows
        place = F.lit(1) if by_id else child.column(id_column, self.ctx) if by_key else F.row_number().over(partition.orderBy(*self._sort_keys(child, query)))
        child.df = child.df.withColumn(rank, place)
        if limit is not None:
            child.df = child.df.where(F.col(rank) <= limit)
        for a, i in query.includes:
            if not a.startswith(HIDDEN):
                child = self._include(child, a, i)
        row = F.struct(*self._output(child, query))
        if limit == 1 or item.cardinality == "one":
            gathered = child.df.select(*names, row.alias(out)) if item.cardinality == "one" else child.df.select(*names, F.array(row).alias(out))
        else:
            packed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), row.alias("row"))))
            gathered = child.df.groupBy(*names).agg(F.transform(packed, lambda x: x["row"]).alias(out))
        if names:
            sources = self._sources(frame, keys)
            on = P.all_of([c == F.col(n) if by_id and len(names) == 1 else c.eqNullSafe(F.col(n)) for c, n in zip(sources, names, strict=True)])
            joined = frame.df.join(gathered, on, "left").drop(*names)
        else:  # the same for all parents: a row at most, or the total of all rows
            joined = frame.df.join(gathered, F.lit(True), "left")
        if item.cardinality == "many":
            joined = joined.withColumn(out, F.coalesce(F.col(out), F.array().cast(joined.schema[out].dataType)))
        return Frame(joined, frame.collection, {**frame.columns, alias: out}, frame.ancestors)

    def _output(self, frame: Frame, query: Query) -> list[Column]:
        """The selected columns, then the includes. Nested paths of one head make a struct."""
        aliases = [a for a, _ in query.includes if not a.startswith(HIDDEN)]
        source = self.ctx.types(frame.collection).names
        if query.selected is None:
            out = [F.col(f"`{frame.columns[c]}`").alias(c) for c in source]
        else:
            tree: dict = {}
            for path in query.selected:
                at = tree
                head, *rest = path.split(".")
                if head == "id" and head not in frame.columns:
                    head = self.ctx.id_of(frame.collection)
                for part in [head, *rest]:
                    at = at.setdefault(part, {})
            out = [_part(F.col(f"`{frame.columns[k]}`"), sub).alias(k) for k, sub in tree.items()]
        return out + [F.col(f"`{frame.columns[a]}`").alias(a) for a in aliases]

    # -- the whole -------------------------------------------------------

    def frame(self, query: Query) -> Frame:
        """Filtered, ordered, limited, with includes; before the projection."""
        frame = self.filtered(self._child(query), query)
        for alias, item in query.includes:
            if alias.startswith(HIDDEN):
                frame = self._include(frame, alias, item)
        if query.cursor is not None:
            frame.df = frame.df.where(P.after_predicate(self._order_columns(frame, query), *query.cursor))
        if query.limit is not None:
            frame.df = frame.df.orderBy(*self._sort_keys(frame, query)).limit(query.limit)
        for alias, item in query.includes:
            if not alias.startswith(HIDDEN):
                frame = self._include(frame, alias, item, few=query.limit is not None)
        return frame

    def compile(self, query: Query) -> DataFrame:
        """The result. It is sorted where the query has an order or a limit."""
        frame = self.frame(query)
        if query.ordering or query.limit is not None:
            frame.df = frame.df.orderBy(*self._sort_keys(frame, query))
        return frame.df.select(*self._output(frame, query))


def _part(c: Column, tree: dict) -> Column:
    if not tree:
        return c
    return F.when(c.isNotNull(), F.struct(*[_part(c.getField(k), sub).alias(k) for k, sub in tree.items()]))

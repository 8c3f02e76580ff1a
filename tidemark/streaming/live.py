"""Live queries.

A view keeps its result written. A batch of changes updates it without computing
what it doesn't touch: entities that changed leave the result, the collection is
reduced to them before it meets the changes, and those that match come back. With
a limit the collection is read again only where fewer candidates than the limit
are known to come first. With includes and existence filters the parents that a
changed row belonged or belongs to are computed anew. What these rules don't
cover is fetched whole. The law is that the kept result equals a fetch.

As a stream, batches come from a Structured Streaming source; results and
changesets are folders per batch, so a batch that runs twice writes the same
folders again, and those that no later batch reads are deleted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..db import Database
from ..errors import TidemarkError
from ..operators import changes as C
from ..plans.ast import Cond, Exists, Group, Query, Var, flat_filters, identity
from ..plans.compile import Compiler, scan
from ..plans.prepare import HIDDEN, collections_of
from ..sources import held as H


def touched(db: Database, query: Query, collections: set[str]) -> bool:
    """Whether a query reads one of the collections."""
    return bool(collections_of(db.prepared(query)) & collections)


def _flat(prepared: Query) -> bool:
    return not prepared.includes and not any(isinstance(f, Exists) for f in flat_filters(prepared.filters))


@dataclass(frozen=True)
class View:
    """A query with its result before projection: whole rows, so that changes can be applied.

    ``rows`` are written to ``path``, so a plan never begins before them.
    """

    db: Database
    query: Query
    rows: DataFrame
    path: str | None = None
    #: Whether it has as many rows as its limit allows, so that the collection may hold others.
    full: bool = False

    @classmethod
    def open(cls, db: Database, query: Query) -> View:
        return cls.of(db, query, *H.held(db.fetch(query.select()), "view"))

    @classmethod
    def of(cls, db: Database, query: Query, rows: DataFrame, path: str | None = None) -> View:
        """The view of a result that is written already."""
        return cls(db, query, rows, path, bool(query.limit) and rows.count() >= query.limit)

    def close(self) -> None:
        """Delete what is kept of the result."""
        if self.path is not None:
            H.drop(self.rows.sparkSession, self.path)

    def result(self) -> DataFrame:
        """The result with the query's projection and order."""
        shown = self.db.prepared(self.query)
        aliases = [a for a, _ in shown.includes if not a.startswith(HIDDEN)]
        rows = self.rows
        if shown.selected is not None:
            flat = Compiler(lambda _: rows.select(*self.db.catalog.types(shown.collection).names), self.db.context())
            plain = replace(shown, filters=(), includes=(), limit=None, cursor=None, ordering=())
            if aliases:
                rows = rows.select(*[p.split(".")[0] for p in shown.selected], *aliases)
            else:
                rows = flat.compile(plain)
        return rows

    def apply(self, changes: dict[str, DataFrame]) -> View:
        """The view after changes by collection (see ``operators.changes``). The one before can still be read, until it is closed."""
        after = self.db.apply_changes(changes)
        prepared = self.db.prepared(self.query.select())
        if not collections_of(prepared) & changes.keys():
            return replace(self, db=after)
        if _flat(prepared):
            part = changes[prepared.collection]
            return self._update_top(after, prepared, part) if prepared.limit else View(after, self.query, *H.held(self._sorted(after, prepared, self._changed(after, prepared, part)), "view"))
        if _one_level(prepared):
            rows = self._update_parents(after, prepared, changes)
        else:
            rows = after.fetch(self.query.select())
        return View.of(after, self.query, *H.held(rows, "view"))

    def _changed(self, after: Database, prepared: Query, part: DataFrame) -> DataFrame:
        """The kept rows without entities that changed, and those of them that match now."""
        ctx = after.context()
        id_column = ctx.id_of(prepared.collection)
        new = after.catalog.some(prepared.collection, part.select(id_column), id_column, newest=True)
        come = Compiler(lambda _: new, ctx).compile(replace(prepared, ordering=(), limit=None))
        return self.rows.join(part.select(id_column), id_column, "left_anti").unionByName(come)

    def _update_top(self, after: Database, prepared: Query, part: DataFrame) -> View:
        """The first of what is kept and what came. What was last before is marked among them, and what is known to be
        complete ends there, as others may come next in the collection: it is read where fewer than the limit come before the mark.
        """
        ctx, limit = after.context(), prepared.limit
        whole = self._changed(after, prepared, part).withColumn("__last", F.lit(0))
        if self.full:
            turned = replace(prepared, ordering=tuple((p, "DESC" if d == "ASC" else "ASC") for p, d in prepared.ordering))
            frame = scan(prepared.collection, self.rows)
            keys = Compiler(lambda _: self.rows, ctx)._sort_keys(frame, turned)[:-1]
            last = frame.df.orderBy(*keys, frame.column(ctx.id_of(prepared.collection), ctx).desc()).limit(1)
            whole = whole.unionByName(last.select([F.col(f"`{n}`").alias(c) for c, n in frame.columns.items()]).withColumn("__last", F.lit(1)))
        marked = scan(prepared.collection, whole)
        mark = F.col(f"`{marked.columns['__last']}`")
        first = marked.df.orderBy(*Compiler(lambda _: whole, ctx)._sort_keys(marked, prepared), mark).limit(limit + 1)
        # a limited order is one partition, so the numbers are places in it
        top, path = H.held(first.select([F.col(f"`{n}`").alias(c) for c, n in marked.columns.items()]).withColumn("__place", F.monotonically_increasing_id()), "view")
        shown = (F.col("__last") == 0) & (F.col("__place") < limit)
        seen = top.agg(F.min(F.when(F.col("__last") == 1, F.col("__place"))).alias("mark"), F.count(F.when(shown, 1)).alias("n")).first()
        if seen["mark"] is not None and seen["mark"] < limit:
            H.drop(top.sparkSession, path)
            return View.of(after, self.query, *H.held(after.fetch(self.query.select()), "view"))
        return View(after, self.query, top.where(shown).orderBy("__place").drop("__last", "__place"), path, seen["n"] >= limit)

    def _sorted(self, after: Database, prepared: Query, rows: DataFrame) -> DataFrame:
        compiler = Compiler(lambda _: rows, after.context())
        return compiler.compile(replace(prepared, filters=(), cursor=None))

    def _update_parents(self, after: Database, prepared: Query, changes: dict[str, DataFrame]) -> DataFrame:
        """Parents that changed or that a changed child belonged or belongs to are computed anew."""
        ctx = after.context()
        name = prepared.collection
        id_column = ctx.id_of(name)
        ids = changes[name].select(id_column) if name in changes else None
        for query in _subqueries(prepared):
            child = query.collection
            if child not in changes:
                continue
            own = ctx.id_of(child)
            moved = changes[child].select(own).distinct()
            rows = self.db.catalog.some(child, moved, own).unionByName(after.catalog.some(child, moved, own))
            links = tuple(f for f in query.filters if isinstance(f, Cond) and isinstance(f.value, Var))
            probe = Query(name, selected=(id_column,), filters=(Exists(Query(child, filters=links)),))
            hit = Compiler(lambda n, c=child, r=rows: r if n == c else after.catalog.frame(n), ctx).compile(probe)
            ids = hit if ids is None else ids.unionByName(hit)
        ids = ids.distinct()
        some = after.catalog.some(name, ids, id_column)
        fresh = Compiler(lambda n: some if n == name else after.catalog.frame(n), ctx).compile(replace(prepared, ordering=()))
        whole = self.rows.join(ids, id_column, "left_anti").unionByName(fresh)
        if prepared.ordering:
            keys = [F.col(p).asc_nulls_first() if d == "ASC" else F.col(p).desc_nulls_last() for p, d in prepared.ordering]
            whole = whole.orderBy(*keys, F.col(id_column).asc_nulls_first())
        return whole


def _subqueries(prepared: Query) -> list[Query]:
    """The queries of the includes and of the existence filters, those in groups too."""
    return [item.query for _, item in prepared.includes] + [f.query for f in flat_filters(prepared.filters) if isinstance(f, Exists)]


def _one_level(prepared: Query) -> bool:
    """Whether all subqueries read their parent by conditions at their top and have none of their own, and there is no limit."""
    if prepared.limit is not None or prepared.cursor is not None or any(alias.startswith(HIDDEN) for alias, _ in prepared.includes):
        return False
    for q in _subqueries(prepared):
        if q.includes or q.collection == prepared.collection or any(isinstance(f, (Exists, Group)) for f in q.filters):
            return False
        if not any(isinstance(f, Cond) and isinstance(f.value, Var) for f in q.filters):
            return False
    return True


class Subscriptions:
    """Live queries over one database.

    Changes are buffered until :meth:`update`; queries that read none of the
    changed collections aren't touched, equal queries share one view, and
    callbacks hear of results that differ only.
    """

    def __init__(self, db: Database):
        self.db = db
        self._views: dict[str, View] = {}
        self._callbacks: dict[str, list[Callable[[DataFrame], None]]] = {}
        self._buffer: list[dict[str, DataFrame]] = []

    def subscribe(self, query: Query, callback: Callable[[DataFrame], None]) -> Callable[[], None]:
        """Call back with the result now and after each change of it; gives the function that ends this."""
        key = identity(query)
        if key not in self._views:
            self._views[key] = View.open(self.db, query)
        self._callbacks.setdefault(key, []).append(callback)
        callback(self._views[key].result())

        def end() -> None:
            self._callbacks[key].remove(callback)
            if not self._callbacks[key]:
                del self._callbacks[key]
                self._views.pop(key).close()

        return end

    def subscribe_with_status(self, query: Query, callback: Callable[[DataFrame, str], None]) -> Callable[[], None]:
        """Like :meth:`subscribe`; the callback hears "loading" with no rows first, then results as "fulfilled" or the reason as "failed: ..."."""
        rows = self.db.catalog.frame(query.collection).where("false")
        callback(rows, "loading")
        try:
            return self.subscribe(query, lambda df: callback(df, "fulfilled"))
        except TidemarkError as e:
            callback(rows, f"failed: {e}")
            return lambda: None

    def subscribe_background(self, query: Query) -> Callable[[], None]:
        """Keep a query's result up to date without hearing of it, as others that share it do."""
        return self.subscribe(query, lambda _: None)

    def buffer(self, changes: dict[str, DataFrame]) -> None:
        self._buffer.append(changes)

    def update(self) -> None:
        """Apply what was buffered as one changeset for each collection, in its order, and tell subscribers."""
        buffered, self._buffer = self._buffer, []
        if not buffered:
            return
        id_of = self.db.context().id_of
        names = list(dict.fromkeys(n for changes in buffered for n in changes))
        merged = {n: C.merge_changes(*[c[n] for c in buffered if n in c], id_column=id_of(n)) for n in names}
        before = self.db.apply_changes(merged)
        self.db = replace(before, catalog=before.catalog.settled())
        for key, view in list(self._views.items()):
            new = view.apply(merged)
            new = replace(new, db=self.db)
            self._views[key] = new
            if new.path != view.path:
                changed = touched(view.db, view.query, set(merged)) and not C.diff(view.rows, new.rows, id_of(view.query.collection)).isEmpty()
                view.close()
                for callback in list(self._callbacks[key]) if changed else ():
                    callback(new.result())


#: Batches after which a stream writes its collection as a whole.
COMPACT = 16


def live_query(
    db: Database, query: Query, collection: str, changes: DataFrame, folder: str, callback: Callable[[DataFrame, DataFrame], None] | None = None, **options
):
    """Keep a query up to date from a stream of changes to one collection; gives the running StreamingQuery.

    A batch writes its changes and the query's result below ``folder``; every ``COMPACT`` batches the collection
    is written as a whole and what came before is deleted, so the folder doesn't grow with the number of batches.
    ``callback`` gets the result and its differences from the one before, where there are any.
    """
    spark = changes.sparkSession
    id_column = db.context().id_of(collection)
    kind = db.catalog.types(collection)

    def at(batch: int) -> Database:
        """The database after a batch: the last whole collection, and the changes since."""
        start = batch - (batch + 1) % COMPACT  # the batch that the last whole collection is of
        base = db if start < 0 else db.with_collections(**{collection: spark.read.schema(kind).parquet(f"{folder}/whole-{start}")})
        for n in range(max(start, -1) + 1, batch + 1):
            base = base.apply_changes({collection: spark.read.schema(changes.schema).parquet(f"{folder}/changes-{n}")})
        return base

    def step(part: DataFrame, batch: int) -> None:
        before = at(batch - 1)
        rows = db.fetch(query.select()) if batch == 0 else None
        kept = H.written(rows, f"{folder}/rows--1") if rows is not None else spark.read.schema(before.fetch(query.select()).schema).parquet(f"{folder}/rows-{batch - 1}")
        view = View.of(before, query, kept)
        part = H.written(part, f"{folder}/changes-{batch}")
        new = view.apply({collection: part})
        rows = H.written(new.rows, f"{folder}/rows-{batch}")
        new.close()
        new = View(new.db, query, rows)
        if (batch + 1) % COMPACT == 0:
            H.written(new.db.catalog.frame(collection), f"{folder}/whole-{batch}")
        if callback is not None:
            changed = C.diff(view.rows, rows, id_column)
            if not changed.isEmpty():
                callback(new.result(), changed)
        _forget(spark, folder, batch)

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint")
    for k, v in options.items():
        writer = writer.trigger(**{k: v})
    return writer.start()


def _forget(spark: SparkSession, folder: str, batch: int) -> None:
    """Delete what neither a later batch nor this one, should it run again, reads."""
    before = batch - 1
    start = before - (before + 1) % COMPACT
    for n in range(max(start - COMPACT, -1), max(start, -1) + 1):
        H.drop(spark, f"{folder}/changes-{n}")
        if n < start:
            H.drop(spark, f"{folder}/whole-{n}")
    H.drop(spark, f"{folder}/rows-{batch - 2}")


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    has_next: bool
    has_previous: bool
    first: tuple | None
    last: tuple | None


def page(db: Database, query: Query, size: int, cursor: tuple | None = None, backwards: bool = False) -> Page:
    """A page after (or before) a cursor: one row more than the page is read to see whether there is another."""
    if not query.ordering:
        query = query.order(db.context().id_of(query.collection), "ASC")
    keys = [p for p, _ in query.ordering]
    flipped = replace(query, ordering=tuple((p, "DESC" if d == "ASC" else "ASC") for p, d in query.ordering))
    asked = (flipped if backwards else query).take(size + 1)
    if cursor is not None:
        asked = asked.after(cursor)
    found = db.fetch(asked.select()).collect()
    more, found = len(found) > size, found[:size]
    if backwards:
        found = found[::-1]
    value = lambda row, path: row[path] if "." not in path else _deep(row, path)
    ends = [tuple(value(r, k) for k in keys) for r in (found[:1] + found[-1:])]
    rows = db.catalog.frame(query.collection).sparkSession.createDataFrame(found, db.fetch(asked.select()).schema)
    return Page(rows, more if not backwards else cursor is not None, more if backwards else cursor is not None, ends[0] if ends else None, ends[-1] if ends else None)


def _deep(row, path: str):
    for part in path.split("."):
        row = None if row is None else row[part]
    return row


def expanding(db: Database, query: Query, size: int) -> tuple[DataFrame, bool]:
    """The first ``size`` rows and whether there are more."""
    if not query.ordering:
        query = query.order(db.context().id_of(query.collection), "ASC")
    rows = db.fetch(query.take(size + 1))
    return rows.limit(size), rows.count() > size

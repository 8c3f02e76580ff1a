"""Changesets as DataFrames.

A change is a row ``seq, id, op, fields`` and the collection's columns: ``op``
is insert, update or delete, ``fields`` names what a patch sets, ``seq`` orders
the changes. A name is a column, which is then set as a whole, or a dotted path
of a record's member, and what isn't named stays. What is named is set even to null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ, OP, FIELDS = "seq", "op", "fields"


def make_changes(rows: DataFrame, op: str | Column, seq: Column, fields: list[str] | Column | None = None) -> DataFrame:
    """Changes of rows; without ``fields`` all columns are set."""
    op = F.lit(op) if isinstance(op, str) else op
    if not isinstance(fields, Column):
        fields = F.array(*[F.lit(f) for f in (fields if fields is not None else rows.columns)]).cast("array<string>")
    return rows.select(seq.cast("long").alias(SEQ), op.alias(OP), fields.alias(FIELDS), *rows.columns)


def patch_fields(rows: DataFrame, columns: list[str], whole: tuple[str, ...] = ()) -> Column:
    """The names that patches set: columns, and of records the members that the rows have, so that others stay.

    A record that is null is set to null, one whose path is in ``whole`` is set as
    a whole, so that members which the rows don't have become null.
    """

    def names(path: str, kind: T.DataType, value: Column) -> Column:
        own = F.array(F.lit(path))
        if not isinstance(kind, T.StructType) or path in whole or not kind.fields:
            return own
        return F.when(value.isNull(), own).otherwise(F.concat(*[names(f"{path}.{f.name}", f.dataType, value.getField(f.name)) for f in kind.fields]))

    found = [names(c, rows.schema[c].dataType, F.col(f"`{c}`")) for c in columns]
    return F.concat(*found) if found else F.array().cast("array<string>")


# Folding: the last change that sets each leaf, with its place in the order. Whether it still counts, after a
# delete or before an insert, follows from that place, so an entity's changes are only ever aggregated.


def _sets(path: tuple) -> Column:
    """Whether a change names a path or something that it is a part of."""
    names = [".".join(path[: i + 1]) for i in range(len(path))]
    return F.array_contains(FIELDS, names[0]) if len(names) == 1 else F.arrays_overlap(F.col(FIELDS), F.array(*[F.lit(n) for n in names]))


def _name(path: tuple) -> str:
    return "__new_" + "/".join(path)


def _aggs(path: tuple, kind: T.DataType, value: Column, order: Column) -> list[Column]:
    on = F.col(OP) != "delete"
    last = F.when(on & _sets(path), order)
    if not isinstance(kind, T.StructType):
        return [F.max_by(F.struct(value.alias("v"), order.alias("at")), last).alias(_name(path))]
    out = [F.max_by(F.struct(value.isNull().alias("null"), order.alias("at")), last).alias(_name(path))]
    for f in kind.fields:
        out += _aggs((*path, f.name), f.dataType, value.getField(f.name), order)
    return out


def _after(path: tuple, kind: T.DataType, old: Column, counts) -> tuple[Column, Column]:
    """A value after the fold, and the place of the last change that set some of it; ``counts`` tells whether a place does."""
    new = F.col(f"`{_name(path)}`")
    on = F.coalesce(new.isNotNull() & counts(new["at"]), F.lit(False))
    if not isinstance(kind, T.StructType):
        return F.when(on, new["v"]).otherwise(old), F.when(on, new["at"])
    members = [_after((*path, f.name), f.dataType, old.getField(f.name), counts) for f in kind.fields]
    inside = F.array_max(F.array(*[at for _, at in members]))
    # set as a whole to null and no member after that, or null before and no member at all
    null = F.when(on, new["null"] & ~F.coalesce(inside > new["at"], F.lit(False))).otherwise(old.isNull() & inside.isNull())
    value = F.when(~null, F.struct(*[v.alias(f.name) for (v, _), f in zip(members, kind.fields, strict=True)]))
    return value, F.array_max(F.array(F.when(on, new["at"]), inside))


def _numbered(parts) -> tuple[DataFrame, Column]:
    """The changes of several changesets and their order: each after the one before it."""
    if len(parts) == 1:
        return parts[0], F.col(SEQ)
    whole = None
    for n, part in enumerate(parts):
        part = part.withColumn("__part", F.lit(n))
        whole = part if whole is None else whole.unionByName(part)
    return whole, F.struct("__part", SEQ)


def _starts(whole: DataFrame, place: Column, id_column: str) -> DataFrame:
    """``__start_id, __start``: each entity's first insert after its last delete."""
    gone = whole.where(F.col(OP) == "delete").groupBy(F.col(id_column).alias("__gone_id")).agg(F.max(place).alias("__gone"))
    inserts = whole.where(F.col(OP) == "insert").select(F.col(id_column).alias("__start_id"), place.alias("__at"))
    back = inserts.join(gone, F.col("__start_id") == F.col("__gone_id"), "left").where(F.col("__gone").isNull() | (F.col("__at") > F.col("__gone")))
    return back.groupBy("__start_id").agg(F.min("__at").alias("__start"))


def overlay(base: DataFrame, *parts: DataFrame, id_column: str = "id", order: Column | None = None) -> DataFrame:
    """The collection after changesets, each in the order of ``seq`` and after the one before it.

    An insert of an entity that is there merges into it, an update of one that
    isn't does nothing, and a delete forgets what came before it. Records are merged by their
    members. Changes are aggregated by entity, so one that changes often is never
    gathered, and meet the collection in one join.
    """
    whole, place = _numbered(parts)
    place = place if order is None else order
    own = F.col(id_column).alias("__id")
    kinds = {c: base.schema[c].dataType for c in base.columns if c != id_column}
    aggs = [a for c, kind in kinds.items() for a in _aggs((c,), kind, F.col(f"`{c}`"), place)]
    last = F.max(F.when(F.col(OP) != "delete", place)).alias("__last")
    deleted = F.max(F.when(F.col(OP) == "delete", place)).alias("__deleted")
    folded = whole.groupBy(own).agg(deleted, last, *aggs)
    starts = _starts(whole, place, id_column)
    known = folded.join(starts, F.col("__id") == F.col("__start_id"), "left")
    joined = base.join(known, F.col(id_column) == F.col("__id"), "full_outer")
    was = F.col(id_column).isNotNull()
    stays = was & F.col("__deleted").isNull()
    # of an entity that was there and wasn't deleted every change counts, else those from its insert on
    counts = lambda at: F.when(stays, F.lit(True)).otherwise(F.coalesce(at >= F.col("__start"), F.lit(False)))
    alive = stays | F.coalesce(F.col("__last").isNotNull() & F.col("__start").isNotNull() & (F.col("__last") >= F.col("__start")), F.lit(False))
    out = [F.coalesce(F.col(id_column), F.col("__id")).alias(c) if c == id_column else _after((c,), kinds[c], F.when(stays, F.col(f"`{c}`")), counts)[0].alias(c) for c in base.columns]
    return joined.where(alive).select(*out)


def merge_changes(*parts: DataFrame, id_column: str = "id") -> DataFrame:
    """Changesets, each after the one before it, as one: an entity's delete where no insert follows its last one, else its merged patch.

    After a delete the patch is an insert of all columns. Patches before an
    entity's insert matter only where it is there already, so they stay a row of
    their own: an update before the insert.
    """
    whole, place = _numbered(parts)
    kinds = {c: parts[0].schema[c].dataType for c in parts[0].columns if c not in (SEQ, OP, FIELDS, id_column)}
    names = sorted(".".join(p) for c, kind in kinds.items() for p in _paths((c,), kind)) + [id_column]
    at = lambda n: F.max(F.when((F.col(OP) != "delete") & F.array_contains(FIELDS, n), place)).alias(f"__at_{n}")
    aggs = [F.max(F.when(F.col(OP) == "delete", place)).alias("__deleted"), F.max(F.when(F.col(OP) != "delete", place)).alias("__last"), F.max(SEQ).alias(SEQ), *map(at, names)]
    aggs += [a for c, kind in kinds.items() for a in _aggs((c,), kind, F.col(f"`{c}`"), place)]
    folded = whole.groupBy(F.col(id_column).alias("__id")).agg(*aggs)
    known = folded.join(_starts(whole, place, id_column), F.col("__id") == F.col("__start_id"), "left")
    start, gone = F.col("__start"), F.col("__deleted").isNotNull()
    early = lambda x: F.coalesce(start.isNull() | (x < start), F.lit(False))
    late = lambda x: F.coalesce(x >= start, F.lit(False))

    def row(op: str, seq: Column, counts, fields: Column) -> Column:
        values = {c: _after((c,), kind, F.lit(None).cast(kind), counts)[0] for c, kind in kinds.items()}
        return F.struct(seq.alias(SEQ), F.lit(op).alias(OP), fields.alias(FIELDS), *[values.get(c, F.col("__id")).alias(c) for c in parts[0].columns if c not in (SEQ, OP, FIELDS)])

    named = lambda counts: F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"`__at_{n}`").isNotNull() & counts(F.col(f"`__at_{n}`")), F.lit(n)) for n in names])))
    every = F.array(*[F.lit(c) for c in [*kinds, id_column]])  # nothing of what an entity was before its delete may show through
    found = F.array(
        F.when(gone & start.isNull(), row("delete", F.col(SEQ), lambda x: F.lit(False), F.array().cast("array<string>"))),
        F.when(~gone & (start.isNull() | (F.size(named(early)) > 0)), row("update", F.col(SEQ) - 1, early, named(early))),
        F.when(start.isNotNull(), row("insert", F.col(SEQ), late, F.when(gone, every).otherwise(named(late)))),
    )
    return known.select(F.explode(F.array_compact(found)).alias("r")).select("r.*")


def _paths(path: tuple, kind: T.DataType) -> list[tuple]:
    """A column's path and those of all its members."""
    return [path, *(p for f in (kind.fields if isinstance(kind, T.StructType) else ()) for p in _paths((*path, f.name), f.dataType))]


def effective(before: DataFrame, changes: DataFrame, id_column: str = "id") -> DataFrame:
    """A changeset without what it wouldn't change: ``fields`` names only columns that get another value.

    Updates that change nothing, and deletes and updates of entities that aren't there, are left out.
    """
    merged = merge_changes(changes, id_column=id_column)
    ids = merged.select(id_column)
    was = before.join(ids, id_column, "left_semi")
    found = diff(was, overlay(was, merged, id_column=id_column), id_column)
    kept = merged.join(found.withColumnRenamed(OP, "__op").withColumnRenamed("changed", "__changed"), id_column)
    names = F.when(F.col("__op") == "update", F.array_intersect(F.transform(FIELDS, lambda f: F.split_part(f, F.lit("."), F.lit(1))), "__changed")).otherwise(F.col(FIELDS))
    paths = F.when(F.col("__op") == "update", F.filter(FIELDS, lambda f: F.array_contains(names, F.split_part(f, F.lit("."), F.lit(1))))).otherwise(F.col(FIELDS))
    op = F.when(F.col("__op") == "insert", F.col(OP)).otherwise(F.col("__op"))
    return kept.select(SEQ, op.alias(OP), F.when(F.col("__op") == "delete", F.array().cast("array<string>")).otherwise(paths).alias(FIELDS), *[c for c in merged.columns if c not in (SEQ, OP, FIELDS)])


def diff(before: DataFrame, after: DataFrame, id_column: str = "id") -> DataFrame:
    """``id, op, changed`` of what differs: insert, update (with the names of the columns) or delete."""
    columns = [c for c in before.columns if c != id_column]
    a = before.select(F.col(id_column).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = after.select(F.col(id_column).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in columns])
    joined = a.join(b, F.col("__a") == F.col("__b"), "full_outer")
    named = F.array_compact(F.array(*[F.when(~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), F.lit(c)) for c in columns]))
    op = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull(), "delete").otherwise("update")
    return joined.select(F.coalesce("__a", "__b").alias(id_column), op.alias(OP), named.alias("changed")).where((F.col(OP) != "update") | (F.size("changed") > 0))


def merge_set(old: Column, patch: Column) -> Column:
    """A set kept as ``map<key, present>`` after a patch of the same form: the patch's keys win."""
    empty = F.create_map().cast("map<string,boolean>")
    return F.map_zip_with(F.coalesce(old, empty), F.coalesce(patch, empty), lambda _, o, n: F.coalesce(n, o))


def set_members(state: Column) -> Column:
    """The members of a set kept as a map, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(state, lambda _, on: on)))


def set_assignment(old: Column, members: Column) -> Column:
    """The patch that makes a set hold just these members: old ones that aren't among them become false."""
    gone = F.transform(F.array_except(F.map_keys(old), members), lambda k: F.struct(k.alias("key"), F.lit(False).alias("value")))
    there = F.transform(F.array_distinct(members), lambda k: F.struct(k.alias("key"), F.lit(True).alias("value")))
    return F.map_from_entries(F.concat(there, gone))


def outbox_overlay(confirmed: DataFrame, *buffers: DataFrame, id_column: str = "id") -> DataFrame:
    """The confirmed store with unsent writes over it, the buffers in order."""
    return overlay(confirmed, *buffers, id_column=id_column)


# -- last writer wins -------------------------------------------------------


def lww_latest(log: DataFrame, keys: list[str], stamp: Column) -> DataFrame:
    """Of a log of whole rows, each entity's row with the highest stamp."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), stamp).alias("row"))
    return best.select(*keys, "row.*")


def lww_fold(log: DataFrame, keys: list[str], stamp: Column, columns: list[str]) -> DataFrame:
    """Of a log of patches in the order of their stamps, each column's last value that isn't null."""
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), stamp)).alias(c) for c in columns]
    return log.groupBy(*keys).agg(*aggs)


def apply_stamped(base: DataFrame, stamps: DataFrame, changes: DataFrame, id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """Apply one batch whose changes carry ``stamp``; gives the collection and ``id, stamp`` after it.

    A change counts where its stamp is above the one that its entity has; an
    older patch is dropped whole. Deletes keep their stamp.
    """
    held = stamps.select(F.col(id_column).alias("__sid"), F.col("stamp").alias("__held"))
    known = changes.join(held, F.col(id_column) == F.col("__sid"), "left")
    fresh = known.where(F.col("__held").isNull() | (F.col("stamp") > F.col("__held"))).drop("__sid", "__held")
    after = overlay(base, fresh, id_column=id_column, order=F.struct("stamp", SEQ))
    newest = stamps.select(id_column, "stamp").unionByName(fresh.select(id_column, "stamp")).groupBy(id_column).agg(F.max("stamp").alias("stamp"))
    return after, newest


def checkpoint_delta(result: DataFrame, seen: DataFrame, stamps: DataFrame, since: Column, id_column: str = "id") -> DataFrame:
    """What a client that saw the ids ``seen`` at ``since`` needs: ``id, op``.

    set: in the result, and new to the client or changed since; delete: seen, and not in the result any more.
    """
    had = seen.select(F.col(id_column).alias("__had")).distinct()
    changed = stamps.where(F.col("stamp") > since).select(F.col(id_column).alias("__changed")).distinct()
    ids = result.select(id_column)
    sets = (
        ids.join(had, F.col(id_column) == F.col("__had"), "left").join(changed, F.col(id_column) == F.col("__changed"), "left")
        .where("__had is null or __changed is not null").select(id_column, F.lit("set").alias(OP))
    )
    gone = had.join(ids, F.col("__had") == F.col(id_column), "left_anti").select(F.col("__had").alias(id_column), F.lit("delete").alias(OP))
    return sets.unionByName(gone)


def by_sync_status(rows: DataFrame, unsent: DataFrame, status: str, id_column: str = "id") -> DataFrame:
    """Rows with changes that weren't sent (pending), without (confirmed), or all."""
    if status == "all":
        return rows
    return rows.join(unsent.select(id_column).distinct(), id_column, "left_semi" if status == "pending" else "left_anti")


# -- results as entities and attributes ------------------------------------------


def results_to_entities(df: DataFrame, collection: str, id_column: str, includes: dict[str, tuple]) -> DataFrame:
    """``collection, id`` of every entity of a nested result, each once.

    ``includes`` maps an alias to ``(collection, id column, includes below)``.
    """
    parts = [df.select(F.lit(collection).alias("collection"), F.col(id_column).cast("string").alias("id"))]
    for alias, (child, child_id, below) in includes.items():
        many = isinstance(df.schema[alias].dataType, T.ArrayType)
        rows = df.select(F.explode(alias).alias("e")) if many else df.where(F.col(alias).isNotNull()).select(F.col(alias).alias("e"))
        parts.append(results_to_entities(rows.select("e.*"), child, child_id, below))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def leaf_paths(kind: T.StructType, prefix: tuple = ()) -> list[tuple]:
    out: list[tuple] = []
    for f in kind.fields:
        out += leaf_paths(f.dataType, (*prefix, f.name)) if isinstance(f.dataType, T.StructType) else [(*prefix, f.name)]
    return out


def entities_to_triples(df: DataFrame, collection: str, id_column: str, stamp: Column | None = None) -> DataFrame:
    """``id, collection, attribute, value, stamp`` of every leaf of every entity; values as JSON."""
    pairs = []
    for path in leaf_paths(df.schema):
        c = F.col(".".join(f"`{p}`" for p in path))
        value = F.get_json_object(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), "$.v")
        pairs.append(F.struct(F.array(*[F.lit(p) for p in path]).alias("attribute"), value.alias("value")))
    stamp = F.lit(None).cast("string") if stamp is None else stamp
    return df.select(F.col(id_column).cast("string").alias("id"), F.lit(collection).alias("collection"), F.explode(F.array(*pairs)).alias("t"), stamp.alias("stamp")).select("id", "collection", "t.attribute", "t.value", "stamp")

"""Operator 9: exact dedup by a minimal perfect hash over historical digests.

Texts are equal when identical after lower-casing A-Z; a SHA-256 digest stands
for each. The distinct digests of the rows that were there before (the history)
are dealt to buckets by their leading bits, and each bucket gets a minimal
perfect hash: levels of bit arrays in which a digest's place is the rank of its
bit, so n digests fill exactly n slots. A slot holds the full digest and the
winner's locator. Arriving digests look up their slot and are compared byte for
byte with what it holds: a match repeats a historical text, others are not
members and form groups of their own.

Rows are aggregated by digest before they are dealt to buckets, so a group of
copies is one row there whatever its size. An index is a table of one row per
bucket of about ``PER_BUCKET`` digests; no task and no driver holds more.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

PER_BUCKET = 4096
#: Bits per digest in a level's array.
SPARE = 2
#: Bytes of a digest.
WIDTH = 32


def digested(docs: DataFrame, text: str = "text", keep_text: bool = False, name: str = "digest") -> DataFrame:
    """``docs`` with a last column ``name`` in place of, or besides, its text (null: empty)."""
    place = docs.columns.index(text)
    kept = docs if keep_text else docs.drop(text)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches):
        for batch in batches:
            found = [hashlib.sha256((t or b"").lower()).digest() for t in batch.column(place).cast(pa.binary()).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if keep_text or i != place]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.binary())], schema.names)

    return docs.mapInArrow(run, schema)


def distinct_digests(rows: DataFrame) -> DataFrame:
    """``digest, winner, n`` of rows ``doc_id, digest, reps``: the largest key stays."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("reps").alias("n"))


def _bucket(buckets: int):
    head = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long")
    return F.floor(head * F.lit(float(buckets)) / F.lit(float(1 << 48))).cast("long")


def _words(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, WIDTH // 8)
    return pairs[:, 2].copy(), pairs[:, 3] | np.uint64(1)


def _place(words: tuple[np.ndarray, np.ndarray], at: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Another hash at each level: all 128 bits are mixed, so digests that met once part later."""
    h = words[0][at] + np.uint64(level) * words[1][at]
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(bits)).astype(np.int64)


def build_levels(digests: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays by level, and the slot of each of the distinct digests."""
    words, left = _words(digests), np.arange(len(digests))
    slots, levels, base = np.zeros(len(digests), dtype=np.int64), [], 0
    while len(left):
        bits = max(8, SPARE * len(left))
        place = _place(words, left, len(levels), bits)
        alone = np.bincount(place, minlength=bits) == 1
        lucky = alone[place]
        slots[left[lucky]] = base + np.cumsum(alone)[place[lucky]] - 1
        base += int(alone.sum())
        levels.append(alone)
        left = left[~lucky]
    return levels, slots


def find_slots(levels: list[np.ndarray], digests: list[bytes]) -> np.ndarray:
    """The slot that each digest would have, -1 where no level has its bit."""
    words, left = _words(digests), np.arange(len(digests))
    slots, base = np.full(len(digests), -1, dtype=np.int64), 0
    for level, alone in enumerate(levels):
        place = _place(words, left, level, len(alone))
        hit = alone[place]
        slots[left[hit]] = base + np.cumsum(alone)[place[hit]] - 1
        base += int(alone.sum())
        left = left[~hit]
    return slots


def build_index(distinct: DataFrame, buckets: int) -> DataFrame:
    """The index of ``digest, winner, n``: ``bucket, sizes, levels, digests, winners, counts``, a row per bucket."""
    kind = distinct.schema["winner"].dataType.simpleString()

    def build(rows: pa.Table) -> pa.Table:
        digests = rows.column("digest").to_pylist()
        levels, slots = build_levels(digests)
        order = np.argsort(slots)
        take = rows.take(pa.array(order))
        return pa.table({
            "bucket": pa.array([rows.column("bucket")[0].as_py()], pa.int64()),
            "sizes": pa.array([[len(x) for x in levels]], pa.list_(pa.int32())),
            "levels": pa.array([[np.packbits(x).tobytes() for x in levels]], pa.list_(pa.binary())),
            "digests": pa.array([b"".join(digests[i] for i in order.tolist())], pa.binary()),
            "winners": pa.array([take.column("winner").to_pylist()], pa.list_(take.schema.field("winner").type)),
            "counts": pa.array([take.column("n").to_pylist()], pa.list_(pa.int64())),
        })

    schema = f"bucket long, sizes array<int>, levels array<binary>, digests binary, winners array<{kind}>, counts array<long>"
    return distinct.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(build, schema)


def lookup(arrived: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Both sides' groups: ``digest, old_winner, old_n, new_winner, new_n``.

    ``arrived`` has ``digest, winner, n``. Where a slot's bytes equal the digest,
    the arrived group repeats a historical one and shares its row. Nonmembers
    have nulls as the old, historical groups that nothing repeats as the new.
    """
    kind = arrived.schema["winner"].dataType.simpleString()
    schema = f"digest binary, old_winner {kind}, old_n long, new_winner {kind}, new_n long"

    def search(new: pa.Table, old: pa.Table) -> pa.Table:
        own = new.column("winner").type
        digests, winners, counts = (new.column(c).to_pylist() for c in ("digest", "winner", "n"))
        out = []
        matched: dict[int, int] = {}
        held, old_winners, old_counts = b"", [], []
        if old.num_rows:
            row = old.to_pylist()[0]
            held, old_winners, old_counts = row["digests"], row["winners"], row["counts"]
            levels = [np.unpackbits(np.frombuffer(b, dtype=np.uint8), count=n).astype(bool) for b, n in zip(row["levels"], row["sizes"], strict=True)]
            for i, s in enumerate(find_slots(levels, digests).tolist() if digests else []):
                if s >= 0 and held[s * WIDTH : (s + 1) * WIDTH] == digests[i]:
                    matched[s] = i
        for s in range(len(old_winners)):
            i = matched.get(s)
            out.append((held[s * WIDTH : (s + 1) * WIDTH], old_winners[s], old_counts[s], None if i is None else winners[i], None if i is None else counts[i]))
        members = set(matched.values())
        out += [(d, None, None, winners[i], counts[i]) for i, d in enumerate(digests) if i not in members]
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.binary(), own, pa.int64(), own, pa.int64()), strict=True)], ["digest", "old_winner", "old_n", "new_winner", "new_n"])

    left = arrived.withColumn("bucket", _bucket(buckets)).groupBy("bucket")
    return left.cogroup(index.groupBy("bucket")).applyInArrow(search, schema)


def decide(docs: DataFrame, history, key: str = "doc_id", text: str = "text", rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Decisions for every row: ``digest, doc_id, reps`` of the rows, and ``digest, keep_id, group_size``.

    ``history`` is a condition on the key column ``doc_id``: where it holds, a
    row belongs to the history that is indexed, the others arrive. ``rows`` may
    hold the digested rows already.
    """
    if rows is None:
        rows = digested(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    pairs = common.materialize(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("reps")), "dedup-rows")
    is_old = F.coalesce(history, F.lit(True))
    old, new = distinct_digests(pairs.where(is_old)), distinct_digests(pairs.where(~is_old))
    buckets = max(1, -(-pairs.count() // PER_BUCKET))
    index = common.materialize(build_index(old, buckets), "dedup-index")
    groups = lookup(new, index, buckets)
    return pairs, groups.select(
        "digest",
        F.greatest("old_winner", "new_winner").alias("keep_id"),
        (F.coalesce("old_n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).cast("long").alias("group_size"),
    )


def earlier_half():
    """The default history: the rows of about half the keys, by hash."""
    return F.xxhash64("doc_id") >= 0


def mark(docs: DataFrame, history=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, digest`` for every row.

    Null and empty texts are equal. The largest key of a group stays, a null key
    only where its group has no other. Of repeated rows of the key that stays one
    is kept. An empty table gives no rows; other columns are ignored.
    """
    pairs, groups = decide(docs, earlier_half() if history is None else history, key, text)
    decided = pairs.join(groups, "digest").select("doc_id", "keep_id", "group_size", "digest", "reps")
    each = common.repeated(decided, F.col("reps"), "rep")
    return each.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("rep") == 0)).drop("rep", "reps")


def dedup(docs: DataFrame, history=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one for each group of equal texts."""
    rows = digested(docs.withColumn("__dedup_key", F.col(key)), text, keep_text=True, name="__dedup_digest")
    pairs, groups = decide(docs, earlier_half() if history is None else history, key, text, rows=rows.select(F.col("__dedup_digest").alias("digest"), F.col("__dedup_key").alias("doc_id")))
    kept = groups.select(F.col("digest").alias("__kept_digest"), F.col("keep_id").alias("__kept_id"))
    same = (F.col("__dedup_digest") == F.col("__kept_digest")) & F.col("__dedup_key").eqNullSafe(F.col("__kept_id"))
    out = rows.join(kept, same, "left_semi")
    if (pairs.agg(F.max("reps")).first()[0] or 0) > 1:
        out = out.dropDuplicates(["__dedup_digest", "__dedup_key"])
    return out.select(*docs.columns)

"""Operator 10: minimax contiguous sharding of atomic groups.

Groups of equal texts are ordered by a digest of their text and may not be
split. The smallest shard capacity for which a greedy left-to-right filling
needs no more than the given number of shards is found by binary search, and
the sequence is cut for that capacity; as many cuts keep to it, those are taken
that make the shards most even. Everything runs as DataFrame expressions. The search
reads summaries of a bounded number of ranges of the sequence, and zooms into
the ranges where a cut may lie until the capacity is exact, so what the driver
holds does not grow with the data.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 24
#: Most range summaries that one step of the search brings to the driver; a step narrows the search by about this over the shards squared.
RANGES = 1 << 16
#: Rows of one group or groups of one bucket that a window's partition holds on average.
WINDOW_ROWS = 20_000
#: Places near each even share that cuts are chosen from.
NEAR = 128


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, digest``: UTF-8 bytes plus 8 and what stands for the text (null: none)."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(data) + 8).cast("long").alias("size"),
        F.crc32(data).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(data, 256)).alias("digest"),
    )


def bucket_of(digest: Column, buckets: int) -> Column:
    """The bucket of a digest by its leading 48 bits; floating point, as their product with the buckets can exceed a long."""
    head = F.conv(F.hex(F.substring(digest, 1, 6)), 16, 10).cast("double")
    return F.floor(head / F.lit(float(1 << 48)) * F.lit(float(buckets))).cast("long")


def ordered_groups(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """Groups in digest order with what stands before each: ``digest, bytes, rows, before, rows_before``; total and largest.

    The leading bits of the digest are the bucket, so buckets are even and their
    order is that of the digests. A window runs inside each bucket, and one over
    the table of buckets, whose number is the groups' over ``WINDOW_ROWS``.
    """
    groups = common.materialize(rows.groupBy("digest").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")), "shard-groups")
    seen = groups.agg(F.count("*").alias("n"), F.sum("bytes").alias("total"), F.max("bytes").alias("most")).first()
    buckets = max(16, -(-seen["n"] // WINDOW_ROWS))
    placed = groups.withColumn("bucket", bucket_of(F.col("digest"), buckets))
    sums = placed.groupBy("bucket").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
    run = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("bucket", F.coalesce(F.sum("b").over(run), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(run), F.lit(0)).alias("r0"))
    inside = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.select(
        "bucket", "digest", "bytes", "rows",
        F.coalesce(F.sum("bytes").over(inside), F.lit(0)).alias("b1"),
        F.coalesce(F.sum("rows").over(inside), F.lit(0)).alias("r1"),
    )
    whole = local.join(starts, "bucket").select(
        "digest", "bytes", "rows", (F.col("b0") + F.col("b1")).alias("before"), (F.col("r0") + F.col("r1")).alias("rows_before")
    )
    return common.materialize(whole, "shard-sequence"), int(seen["total"] or 0), int(seen["most"] or 0)


@dataclass
class Boundaries:
    """What is known of the places where a group starts.

    ``known`` holds such places in order, the end of the sequence last. After
    ``known[i]`` and before ``known[i + 1]`` there may be others unless
    ``whole[i]``.
    """

    known: list[int]
    whole: list[bool]

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int] | None:
        """Greedy cuts for a capacity, or None where more shards are needed.

        Not ``hopeful``: only known places are used, so an answer is right and a
        refusal may be wrong. ``hopeful``: a place that isn't known is taken to
        exist wherever it would help, so a refusal is right.
        """
        at, out, end = 0, [], self.known[-1]
        for _ in range(shards):
            if end - at <= capacity:
                return out
            i = bisect_right(self.known, at + capacity) - 1
            best = self.known[i]
            if hopeful and not self.whole[i]:
                best = min(at + capacity, self.known[i + 1] - 1)
            if best <= at:
                return None
            out.append(at := best)
        return None

    def smallest(self, low: int, high: int, shards: int, hopeful: bool) -> int:
        """Binary search for the smallest capacity that is enough; ``high`` is known to be."""
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, hopeful) is None:
                low = mid + 1
            else:
                high = mid
        return low


def _summaries(sequence: DataFrame, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """First and last start and the number of starts of each part of the spans: at most ``RANGES`` rows."""
    wide = sum(b - a for a, b in spans)
    step = max(1, -(-wide // (RANGES - len(spans))))
    part = F.lit(None).cast("long")
    base = 0
    for a, b in spans:
        inside = (F.col("before") >= a) & (F.col("before") < b)
        part = F.when(inside, F.lit(base) + F.floor((F.col("before") - a) / step).cast("long")).otherwise(part)
        base += -(-(b - a) // step)
    found = (
        sequence.select("before", part.alias("part")).where("part is not null")
        .groupBy("part").agg(F.min("before").alias("first"), F.max("before").alias("last"), F.count("*").alias("n"))
    )
    return sorted((r["first"], r["last"], r["n"]) for r in found.collect())


def minimax_cuts(sequence: DataFrame, total: int, most: int, shards: int = SHARDS) -> tuple[int, list[int]]:
    """The smallest capacity for contiguous shards and the places where they begin (without the first)."""
    if total == 0:
        return 0, []
    state = Boundaries([0, total], [False])
    spans = [(0, total)]
    low, high = max(most, -(-total // shards)), total
    while True:
        points = {0: False, total: True} | dict(zip(state.known, [*state.whole, True], strict=True))
        inside = {}
        for first, last, n in _summaries(sequence, spans):
            inside[first] = n <= 2
            inside[last] = None
        merged = sorted(points.keys() | inside.keys())
        # inside the spans every start is counted now; a place outside keeps what was known of the places after it
        whole = [inside[p] is not False if p in inside else points[p] for p in merged[:-1]]
        state = Boundaries(merged, whole)
        high = state.smallest(low, high, shards, hopeful=False)
        low = state.smallest(low, high, shards, hopeful=True)
        if low == high:
            return high, state.cuts(high, shards, hopeful=False)
        # each cut of the best filling lies between these two
        first, late = _lowest(state, low, shards), state.cuts(high, shards, hopeful=True)
        spans = []
        for k, a in enumerate(first):
            b = late[k] if k < len(late) else total
            spans.append((a, state.known[min(len(state.known) - 1, bisect_left(state.known, b + 1))]))
        spans = _joined(spans)


def _lowest(state: Boundaries, capacity: int, shards: int) -> list[int]:
    """For each cut the least place that a filling with at least this capacity can reach."""
    at, out = 0, []
    for _ in range(shards - 1):
        if at + capacity >= state.known[-1]:
            break
        at = max(at, state.known[bisect_right(state.known, at + capacity) - 1])
        out.append(at)
    return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for s in spans if s[0] < s[1]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def even_cuts(sequence: DataFrame, total: int, capacity: int, cuts: list[int], shards: int = SHARDS) -> list[int]:
    """Of the cuts that keep to the capacity, those whose shards have the least sum of squares.

    Each cut is the given one or one of the ``NEAR`` group starts that are nearest
    to its even share; the given cuts are always among what is chosen from.
    """
    if not total:
        return cuts
    wide = total / max(1, sequence.count()) * NEAR
    share = F.round(F.col("before") * shards / F.lit(float(total))).cast("int")
    off = F.abs(F.col("before") - F.col("share") * F.lit(total / shards))
    near = sequence.select("before", share.alias("share")).where((F.col("share") > 0) & (F.col("share") < shards)).withColumn("off", off)
    nearest = near.groupBy("share").agg(F.min_by("before", F.struct("off", "before")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("share").orderBy("off", "before"))
    some = near.where(F.col("off") <= F.lit(wide)).withColumn("rank", rank).where(F.col("rank") <= NEAR).select("share", "before")
    places = [{0}, *({c} for c in cuts), *({total} for _ in range(shards - len(cuts)))]
    for r in nearest.unionByName(some).collect():
        places[r["share"]].add(r["before"])
    ends = [np.array(sorted(x), dtype=np.int64) for x in places]
    cost, back = np.zeros(1), []
    for before, after in zip(ends[:-1], ends[1:], strict=True):
        gaps = after[:, None] - before[None, :]
        worth = np.where((gaps >= 0) & (gaps <= capacity), cost[None, :] + (gaps / total) ** 2, np.inf)
        back.append(worth.argmin(axis=1))
        cost = worth.min(axis=1)
    at, out = 0, []
    for k in range(shards - 1, 0, -1):
        at = int(back[k][at])
        out.append(int(ends[k][at]))
    return out[::-1]


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards by the law of even bytes: ``doc_id, size, text_crc32, digest, shard, slot``.

    Equal texts are one group and stay in one shard, so a group larger than an
    even share makes the smallest feasible capacity its own size. ``slot`` runs
    from 0 without gaps in each shard. Null and empty texts are equal. Repeated
    rows are counted before anything is shuffled and each get a slot; the keys of a group are numbered
    in hashed parts, never a whole group in one task. An empty table gives no rows, fewer groups than shards
    leave some shards empty. Other columns are ignored.
    """
    counted = sized(docs, key, text).groupBy("digest", "doc_id").agg(F.first("size").alias("size"), F.first("text_crc32").alias("text_crc32"), F.count("*").alias("n"))
    rows = common.materialize(counted, "shard-rows")
    sequence, total, most = ordered_groups(rows)
    capacity, cuts = minimax_cuts(sequence, total, most, shards)
    cuts = even_cuts(sequence, total, capacity, cuts, shards)
    number = sum((F.when(F.col("before") >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = common.materialize(sequence.select("digest", number.alias("shard"), "rows_before"), "shard-groups-placed")
    bases = placed.groupBy("shard").agg(F.min("rows_before").alias("base"))
    parts = max(8, -(-rows.count() // WINDOW_ROWS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)))
    counts = dealt.groupBy("digest", "part").agg(F.sum("n").alias("n"))
    run = Window.partitionBy("digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.withColumn("ahead", F.coalesce(F.sum("n").over(run), F.lit(0)))
        .join(placed, "digest").join(F.broadcast(bases), "shard")
        .select("digest", "part", "shard", (F.col("rows_before") - F.col("base") + F.col("ahead")).alias("start"))
    )
    own = Window.partitionBy("digest", "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn("own", F.coalesce(F.sum("n").over(own), F.lit(0))).join(starts, ["digest", "part"])
    each = common.repeated(numbered, F.col("n"), "repeat")
    return each.select("doc_id", "size", "text_crc32", "digest", "shard", (F.col("start") + F.col("own") + F.col("repeat")).cast("long").alias("slot"))

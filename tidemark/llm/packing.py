"""Operator 1: variable-capacity best-fit packing.

Several sequence lengths are permitted. Pieces are taken by decreasing size and
put where they leave the least room among the open bins; where none has room, a
bin of the length with the least cost for what it can be filled with is opened.
At last each bin gets the least permitted length that holds its contents.

Pieces are dealt to groups of about ``GROUP`` by a hash and each group is packed
by itself, so the work is spread evenly whatever the keys and sources are; a
group's last bins are all that is lost against packing everything together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Permitted lengths in tokens.
LENGTHS = (512, 1024, 2048, 4096)
#: Pieces of a group on average.
GROUP = 20_000


@dataclass(frozen=True)
class Cost:
    """Cost of a sequence: a fixed part, one per token, and attention by the square of the length."""

    fixed: float = 64.0
    square: float = 1 / 16384

    def __call__(self, length):
        return self.fixed + length + self.square * length * length


def pack(sizes: list[int], lengths=LENGTHS, cost: Cost | None = None) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size, and the length of each bin. ``sizes`` decrease and are within the largest length."""
    cost, lengths = cost or Cost(), sorted(lengths)
    total = np.concatenate((np.cumsum(np.array(sizes[::-1], dtype=np.int64))[::-1], [0])) if sizes else np.zeros(1)
    ascending = np.array(sizes[::-1], dtype=np.int64)
    fit = [len(sizes) - int(np.searchsorted(ascending, x, side="right")) for x in range(lengths[-1] + 1)]  # first piece of at most x
    rooms: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    mask = 0  # a bit for each room that some bin has
    bins, offsets, used, opened = [], [], [], []
    for i, size in enumerate(sizes):
        if found := mask >> size:
            room = size + (found & -found).bit_length() - 1
            which = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:

            def rate(length):
                room = length - size
                return cost(length) / (size + min(room, int(total[max(i + 1, fit[room])])))

            length = min((x for x in lengths if x >= size), key=rate)
            which, room = len(used), length
            used.append(0)
            opened.append(length)
        bins.append(which)
        offsets.append(used[which])
        used[which] += size
        left = room - size
        if left:
            rooms[left].append(which)
            mask |= 1 << left
    return bins, offsets, [next(x for x in lengths if x >= u) for u in used]


def pieces(docs: DataFrame, size: Column, longest: int, key: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, n_tokens``: documents longer than the largest length are cut, none is dropped."""
    sized = docs.select(F.col(key).alias("doc_id"), size.cast("long").alias("size"))
    count = F.greatest(F.ceil(F.col("size") / longest), F.lit(1)).cast("long")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    start = F.col("piece") * longest
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("size") - start, F.lit(longest)).alias("n_tokens"))


def best_fit(docs: DataFrame, size: Column, lengths=LENGTHS, cost: Cost | None = None, key: str = "doc_id", group: int = GROUP) -> DataFrame:
    """``doc_id, piece, start, n_tokens, bin_id, bin_tokens, bin_offset`` for every piece of every document.

    A document without tokens (null, empty) has one piece of size 0 and no bin.
    Equal sizes go by key and piece, so reruns agree; repeated rows are counted, and then packed
    as often as they come, spread over the groups. An empty table gives no rows. Other columns are ignored.
    """
    longest = max(lengths)
    counted = pieces(docs, size, longest, key).groupBy("doc_id", "piece", "start", "n_tokens").agg(F.count("*").alias("times"))
    cut = common.materialize(common.repeated(counted, F.col("times"), "copy").drop("times"), "pieces")
    groups = max(1, -(-cut.count() // group))
    kind = cut.schema["doc_id"].dataType.simpleString()

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sizes = rows.column("n_tokens").to_pylist()
        bins, offsets, ends = pack(sizes, lengths, cost)
        base = rows.column("part")[0].as_py() << 32
        return rows.drop_columns("part").append_column("bin_id", pa.array([base + b for b in bins], pa.int64())).append_column(
            "bin_tokens", pa.array([ends[b] for b in bins], pa.int32())
        ).append_column("bin_offset", pa.array(offsets, pa.int32()))

    schema = f"doc_id {kind}, piece long, start long, n_tokens long, bin_id long, bin_tokens int, bin_offset int"
    some, none = cut.where("n_tokens > 0"), cut.where("n_tokens <= 0")
    dealt = some.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "copy"), F.lit(groups))).drop("copy")
    blank = [F.lit(None).cast(t).alias(c) for c, t in (("bin_id", "long"), ("bin_tokens", "int"), ("bin_offset", "int"))]
    return dealt.groupBy("part").applyInArrow(run, schema).unionByName(none.select("doc_id", "piece", "start", "n_tokens", *blank))


def sequences(docs: DataFrame, lengths=LENGTHS, cost: Cost | None = None, key: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """The packed texts: ``bin_id, bin_tokens, n_tokens, doc_ids, text``, words joined by spaces, a row for each bin.

    Rows are told apart by all their columns, so a key with several texts, or
    none, has each of them packed; equal rows are packed as often as they come.
    Texts without words are in no bin, and an empty table has none.
    """
    marked = docs.select(F.unhex(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256)).alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    placed = best_fit(marked, common.word_count(F.col("text")), lengths, cost, "row", group).where("bin_id is not null").withColumnRenamed("doc_id", "row")
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    held = marked.dropDuplicates(["row"]).select("row", "doc_id", words.alias("words"))
    part = F.array_join(F.slice("words", (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int")), " ")
    cut = placed.join(held, "row").select("bin_id", "bin_tokens", "n_tokens", F.struct("bin_offset", "doc_id", part.alias("text")).alias("part"))
    parts = F.array_sort(F.collect_list("part"))  # a bin's tokens bound what it gathers
    return cut.groupBy("bin_id").agg(F.first("bin_tokens").alias("bin_tokens"), F.sum("n_tokens").alias("n_tokens"), parts.alias("parts")).select(
        "bin_id", "bin_tokens", "n_tokens", F.col("parts.doc_id").alias("doc_ids"), F.array_join(F.col("parts.text"), " ").alias("text")
    )

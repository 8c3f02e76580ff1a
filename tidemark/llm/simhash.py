"""Operator 4: SimHash near duplicates by anchor-point covering.

A fingerprint of 64 bits is cut into segments of 23, 23 and 12 bits. Two
fingerprints within ``max_bits`` of each other are within a segment's own
threshold in at least one segment, if the thresholds plus one sum up to more
than ``max_bits``. The anchors of a long segment are the words of the perfect
binary Golay code, whose covering radius is 3; those of the short one are all
words. A fingerprint is replicated to every anchor within the covering radius
plus the threshold, and fingerprints that meet at an anchor are compared.

Per anchor only a spanning forest of the links leaves the task, so a group of
n near copies gives about n rows and never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components

MAX_BITS = 4
WIDTH = 4
HASH_SEED = 42
#: Fixed values of the code: length, dimension, covering radius, generator polynomial.
CODE_BITS, CODE_DIMENSION, COVERING_RADIUS, GENERATOR = 23, 12, 3, 0xC75
SEGMENTS = ((0, 23), (23, 23), (46, 12))
ANCHORS = 1 << CODE_DIMENSION
#: Entries of one anchor that one task compares; an anchor with more is cut into blocks, compared pair by pair of blocks.
BLOCK = 1 << 17
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 22


def thresholds(max_bits: int) -> tuple[int, int, int]:
    """Least segment thresholds whose successors sum up to ``max_bits + 1``; -1 leaves a segment out.

    The short segment must agree, the others share the rest.
    """
    first = max((max_bits - 1) // 2, -1)
    return first, max(max_bits - 2 - first, -1), 0


def _pieces(data: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text in order, as lists of the words of pieces of about ``size`` bytes."""
    at = 0
    while at < len(data):
        end = at + size
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end].split()
        at = end


def fingerprint(text: bytes | None, width: int = WIDTH, piece: int = PIECE) -> int:
    """Unsigned fingerprint of a text in UTF-8: a bit is set if over half the shingle hashes have it."""
    counts, total, tail = np.zeros(64, dtype=np.int64), 0, []
    hashed = xxhash.xxh64_intdigest
    for words in _pieces((text or b"").lower(), piece):
        words = tail + words
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
            hashes = np.array([hashed(joined[a:b], HASH_SEED) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype=np.uint64)
            counts += _bit_counts(hashes)
            total += len(hashes)
            tail = words[len(words) - width + 1 :]
        else:
            tail = words
    if not total:
        if not tail:
            return 0
        counts, total = _bit_counts(np.array([hashed(b" ".join(tail), HASH_SEED)], dtype=np.uint64)), 1
    return int(sum(1 << i for i in np.nonzero(2 * counts > total)[0].tolist()))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        out += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every whole text as a signed long (null and no words: 0)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = [fingerprint(t.as_py(), width) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


@lru_cache(maxsize=None)
def _remainders() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits of a segment."""
    single = []
    for i in range(CODE_BITS):
        v = 1 << i
        for b in range(CODE_BITS - 1, CODE_BITS - CODE_DIMENSION - 1, -1):
            if v >> b & 1:
                v ^= GENERATOR << (b - (CODE_BITS - CODE_DIMENSION))
        single.append(v)
    low, high = np.zeros(1 << 12, dtype=np.int32), np.zeros(1 << 11, dtype=np.int32)
    for i in range(12):
        low ^= np.where(np.arange(1 << 12) >> i & 1, single[i], 0).astype(np.int32)
    for i in range(11):
        high ^= np.where(np.arange(1 << 11) >> i & 1, single[12 + i], 0).astype(np.int32)
    return low, high


def syndrome(word: np.ndarray) -> np.ndarray:
    low, high = _remainders()
    return low[word & 0xFFF] ^ high[word >> 12]


@lru_cache(maxsize=None)
def _cosets(radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns up to a weight by their syndrome: offsets by syndrome, patterns, weights."""
    patterns, weights = [np.zeros(1, dtype=np.int64)], [np.zeros(1, dtype=np.int8)]
    for w in range(1, radius + 1):
        bits = np.array(list(combinations(range(CODE_BITS), w)), dtype=np.int64)
        patterns.append((1 << bits).sum(axis=1))
        weights.append(np.full(len(bits), w, dtype=np.int8))
    patterns, weights = np.concatenate(patterns), np.concatenate(weights)
    found = syndrome(patterns)
    order = np.argsort(found, kind="stable")
    offsets = np.searchsorted(found[order], np.arange((1 << (CODE_BITS - CODE_DIMENSION)) + 1))
    return offsets, patterns[order], weights[order]


def anchors(fps: np.ndarray, segment: int, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each replica: the index of its fingerprint, its anchor, and whether it is near.

    A pair at distance d in the segment has a word at distance floor(d / 2) of
    the one and ceil(d / 2) of the other, and that word an anchor within the
    covering radius. So it is enough to replicate to the radius plus half the
    threshold, rounded up, and to compare those with the ones that are near: to
    the radius plus half the threshold, rounded down. With a threshold of 1 these
    are the home anchor and all within the radius plus the threshold.
    """
    shift, bits = SEGMENTS[segment]
    word = (fps >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
    if bits != CODE_BITS:
        return np.arange(len(fps)), word, np.ones(len(fps), dtype=bool)
    return golay_anchors(word, threshold)


def golay_anchors(word: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for words of the code's length."""
    offsets, patterns, weights = _cosets(COVERING_RADIUS + (threshold + 1) // 2)
    own = syndrome(word)
    first, count = offsets[own], offsets[own + 1] - offsets[own]
    index = np.repeat(np.arange(len(word)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    anchor = (word[index] ^ patterns[at]) >> (CODE_BITS - CODE_DIMENSION)
    return index, anchor, weights[at] <= COVERING_RADIUS + threshold // 2


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = (bounds * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype("<u8").tobytes())])


PACK = "segment int, anchor int, block int, near binary, far binary"


def _packs(fps: np.ndarray, limits, hot) -> Iterator[pa.RecordBatch]:
    """Replicas of some fingerprints, a row for each anchor and block."""
    for segment, threshold in enumerate(limits):
        if threshold < 0:
            continue
        index, anchor, near = anchors(fps, segment, threshold)
        values = fps[index]
        block = np.zeros(len(values), dtype=np.int64)
        cut = {a: n for (s, a), n in hot.items() if s == segment}
        parts = [(anchor, block, values, near, np.ones(len(values), dtype=bool))]
        if cut:
            table = np.ones(ANCHORS, dtype=np.int64)
            table[list(cut)] = list(cut.values())
            pieces = table[anchor]
            plain = pieces == 1
            parts = [(anchor[plain], block[plain], values[plain], near[plain], np.ones(plain.sum(), dtype=bool))]
            a, v, p, is_near = anchor[~plain], values[~plain], pieces[~plain], near[~plain]
            own = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % p
            for other in range(int(p.max(initial=0))):
                on = other < p
                row = is_near & on
                none = np.zeros(row.sum(), dtype=bool)
                parts.append((a[row], own[row] * p[row] + other, v[row], ~none, none))
                none = np.zeros(on.sum(), dtype=bool)
                parts.append((a[on], other * p[on] + own[on], v[on], none, ~none))
        anchor, block, values, near, far = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((block, anchor))
        anchor, block, values, near, far = anchor[order], block[order], values[order], near[order], far[order]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])]) if len(anchor) else np.zeros(0, dtype=int)
        ends = np.r_[new, len(anchor)]
        bounds = lambda flag: np.r_[0, np.cumsum(flag)][ends]  # noqa: B023,E731
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(new), segment, dtype=np.int32)), pa.array(anchor[new].astype(np.int32)), pa.array(block[new].astype(np.int32)), _binary(values[near], bounds(near)), _binary(values[far], bounds(far))],
            ["segment", "anchor", "block", "near", "far"],
        )


def join_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the ends of links; ``parent`` holds roots before and after."""
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not (up := parent[parent]).tobytes() == parent.tobytes():
            parent[:] = up


def forest(near: np.ndarray, far: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between near and far fingerprints: (fingerprint, its root)."""
    nodes = np.unique(np.concatenate((near, far)))
    near, far = np.unique(near), np.unique(far)
    rows, cols = np.searchsorted(nodes, near), np.searchsorted(nodes, far)
    parent = np.arange(len(nodes))
    for i in range(0, len(near), 64):
        for j in range(0, len(far), 4096):
            apart = np.bitwise_count(near[i : i + 64, None] ^ far[None, j : j + 4096])
            a, b = np.nonzero(apart - np.uint8(1) < max_bits)  # equal ones wrap around
            if len(a):
                join_roots(parent, rows[i + a], cols[j + b])
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``), a spanning forest per anchor.

    No link is lost up to connection: whatever is within ``max_bits`` meets at an
    anchor and is joined there. Anchors with more than ``block`` entries are cut
    into blocks by a hash and each pair of blocks is a task's work.
    """
    limits = thresholds(max_bits)

    def values(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += len(held[-1])
            if n >= 50_000:
                yield np.concatenate(held)
                held, n = [], 0
        if n:
            yield np.concatenate(held)

    def count(batches):
        sums = np.zeros((len(limits), ANCHORS), dtype=np.int64)
        for fps in values(batches):
            for s, t in enumerate(limits):
                if t >= 0:
                    sums[s] += np.bincount(anchors(fps, s, t)[1], minlength=ANCHORS)
        s, a = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(sums[s, a])], ["segment", "anchor", "n"])

    hot = {}
    rows = distinct.count()
    if rows > block:  # fewer fingerprints than a block can't fill one
        crowded = distinct.select("fp").mapInArrow(count, "segment int, anchor int, n long").groupBy("segment", "anchor").agg(F.sum("n").alias("n"))
        hot = {(r["segment"], r["anchor"]): -(-r["n"] // block) for r in crowded.where(F.col("n") > block).collect()}  # one row an anchor at most

    def pack(batches):
        for fps in values(batches):
            yield from _packs(fps, limits, hot)

    def compare(batches):
        key, near, far = None, [], []

        def done():
            a, b = forest(np.frombuffer(b"".join(near), dtype="<u8"), np.frombuffer(b"".join(far), dtype="<u8"), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            for s, a, b, n, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, a, b) != key:
                    if key is not None:
                        yield done()
                    key, near, far = (s, a, b), [], []
                near.append(n)
                far.append(f)
        if key is not None:
            yield done()

    packed = distinct.select("fp").mapInArrow(pack, PACK)
    dealt = packed.repartition("segment", "anchor", "block").sortWithinPartitions("segment", "anchor", "block")
    return dealt.mapInArrow(compare, "a long, b long").where("a != b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row; the component's smallest key is its id.

    Fingerprints are linked at ``max_bits`` or fewer differing bits and components
    are what is reachable over links. Null and empty texts have fingerprint 0 and
    are linked like any other. Repeated rows are in one component. A null key is
    never a component's id unless all its keys are null. Other columns are ignored.
    """
    rows = common.materialize(fingerprints(docs, key, text, width), "fingerprints")
    classes = common.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = components.connected_components(links(classes, max_bits)).select(F.col("node").alias("fp"), "root")
    placed = common.materialize(classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    # written, so that Spark may split a large component's rows in the join
    named = common.materialize(placed.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    named = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one of each component.

    It is the row of the smallest key, null keys last; of several rows of one key
    the first by a digest of all their columns. Rows that are equal in all columns
    are one.
    """
    return common.keep_first(docs, key, lambda marked, name: near_duplicates(marked, name, text, width, max_bits))

"""Operator 4 at a Jaccard similarity: long SimHash fingerprints over anchors, links verified by the sets.

Texts whose sets of five-word shingles are similar to 0.8 differ in about 15 %
of their SimHash bits, too many for the few bits that 64-bit fingerprints are
linked at. So fingerprints of 256 bits are taken, and 22 segments of 23 of their
bits; two fingerprints are compared, in all bits, where they meet at an anchor of
the Golay code in some segment: one of them at its home anchor, the other within
the covering radius plus one. Up to ``MAX_BITS`` different bits they are a
candidate, and a candidate is linked if the sets of the whole texts are similar.

Each anchor gives a spanning forest of its candidates, of few different bits
before more. Its edges are verified first, and most of what is similar is linked
by them, so a group of n near copies costs about n tests. Their components are
the parts; what the other edges of the forest join is a loose component of
parts, and every link that is left lies inside one. So texts of different parts
of a loose component are tested against each other, in blocks and inside the
tasks, so that only the links leave them and never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, components, simhash

WIDTH = 5
LANES = 4
SEGMENTS = 22
#: Least Jaccard similarity of a link, as a fraction.
SIMILAR = (4, 5)
#: Different bits of a candidate. Texts with a similarity of 0.8 differ in 39 +- 6 bits.
MAX_BITS = 64
THRESHOLD = 1
#: An item: the number of a set in two words, the lanes of its fingerprint, and how many shingles it is of.
ID, SIZE = 2, 2 + LANES
ITEM = SIZE + 1
#: Entries of one anchor that a task compares; anchors with more are cut into blocks.
BLOCK = 1 << 15
#: Texts, and shingles of theirs, of a block in which sets are tested against each other.
TEXTS, SHINGLES = 2048, 1 << 19


def _mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Other 64 bits for each lane, from the shingle's hash."""
    h = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit: counts of byte values, times the bits of the values."""
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    values = np.stack([np.bincount(columns[:, i], minlength=256) for i in range(8)])
    return (values @ np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)).reshape(64)


def shingle_set(text: bytes | None, width: int = WIDTH, piece: int = simhash.PIECE) -> np.ndarray:
    """The distinct hashes of a whole text's shingles, ascending; fewer words than ``width`` are one shingle, no words none."""
    found, tail = np.zeros(0, dtype=np.uint64), []
    hashed = xxhash.xxh64_intdigest
    for words in simhash._pieces((text or b"").lower(), piece):
        words = tail + words
        if len(words) < width:
            tail = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        hashes = np.array([hashed(joined[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype=np.uint64)
        found = np.unique(np.concatenate((found, hashes)))
        tail = words[len(words) - width + 1 :]
    if not len(found) and tail:
        found = np.array([hashed(b" ".join(tail))], dtype=np.uint64)
    return found


def set_fingerprint(hashes: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """``lanes`` words of 64 bits; a bit is set if over half of the set's shingles have it. No shingles: zeros."""
    sums = np.stack([_bit_sums(_mixed(hashes, lane)) for lane in range(lanes)])
    return np.packbits(2 * sums > len(hashes), axis=1, bitorder="little").view("<u8").reshape(lanes)


def long_fingerprint(text: bytes | None, width: int = WIDTH, lanes: int = LANES, piece: int = simhash.PIECE) -> np.ndarray:
    """The fingerprint of a text's set of shingles: each counts once, however often it comes."""
    return set_fingerprint(shingle_set(text, width, piece), lanes)


def segment_bits(segment: int) -> np.ndarray:
    """The bits of a segment: fixed choices, even over the fingerprint."""
    order = np.random.default_rng(segment // 11).permutation(64 * LANES)
    at = segment % 11 * simhash.CODE_BITS
    return order[at : at + simhash.CODE_BITS]


def segment_word(fps: np.ndarray, segment: int) -> np.ndarray:
    word = np.zeros(len(fps), dtype=np.int64)
    for i, bit in enumerate(segment_bits(segment).tolist()):
        word |= (fps[:, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)).astype(np.int64) << i
    return word


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, id, fp, n``: of every whole text the number and the size of its set of shingles, and the long fingerprint as binary."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for keys, texts in common.small_parts(batch, 1):
                ids, fps, sizes = [], [], []
                for t in texts:
                    hashes = shingle_set(t, width)
                    ids.append(_number(hashes))
                    fps.append(set_fingerprint(hashes).tobytes())
                    sizes.append(len(hashes))
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary()), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64())], ["doc_id", "id", "fp", "n"])

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, id binary, fp binary, n long")


def _number(hashes: np.ndarray) -> bytes:
    """A set's number: the hash of its members to 128 bits, so that different sets of any corpus differ in it."""
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def shingle_sets(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """``id, fp, shingles``: the number, the long fingerprint and the set of every text in the only column."""

    def run(batches):
        for batch in batches:
            for (some,) in common.small_parts(batch, 0):
                sets = [shingle_set(t, width) for t in some]
                held = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                fps = [set_fingerprint(x).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(map(_number, sets), pa.binary()), pa.array(fps, pa.binary()), held], ["id", "fp", "shingles"])

    return texts.mapInArrow(run, "id binary, fp binary, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """The pairs ``a, b`` whose sets are similar: as large a part of their union is common to both."""
    part, whole = similar
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    common_ = F.size(F.array_intersect("of_a", "of_b")).cast("long")
    both = F.size("of_a").cast("long") + F.size("of_b")
    return pairs.join(left, "a").join(right, "b").where(common_ * whole >= (both - common_) * part).select("a", "b")


def _items(batches):
    """Arrays of items from batches of (number, fingerprint, size)."""
    held, n = [], 0
    for batch in batches:
        ids, fps = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u8").reshape(len(batch), -1) for i in (0, 1))
        sizes = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
        held.append(np.column_stack((ids, fps, sizes)))
        n += len(ids)
        if n >= 20_000:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


def _numbered(ids: np.ndarray) -> np.ndarray:
    """Small numbers that are equal where the ids (two words each) are."""
    order = np.lexsort((ids[:, 1], ids[:, 0]))
    new = np.r_[True, (ids[order[1:]] != ids[order[:-1]]).any(axis=1)] if len(ids) else np.zeros(0, dtype=bool)
    out = np.empty(len(ids), dtype=np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def candidates(near: np.ndarray, far: np.ndarray, max_bits: int, similar: tuple[int, int] = SIMILAR):
    """Places of near and far items within ``max_bits``, and their bits: parts of all pairs.

    Left out are pairs whose sizes alone rule the similarity out.
    """
    part, whole = np.uint64(similar[0]), np.uint64(similar[1])
    for i in range(0, len(near), 64):
        for j in range(0, len(far), 4096):
            x, y = near[i : i + 64], far[j : j + 4096]
            apart = np.zeros((len(x), len(y)), dtype=np.uint16)
            for lane in range(ID, ID + LANES):
                apart += np.bitwise_count(x[:, None, lane] ^ y[None, :, lane])
            a, b = np.nonzero(apart <= max_bits)
            m, n = x[a, SIZE], y[b, SIZE]
            on = np.minimum(m, n) * whole >= np.maximum(m, n) * part
            a, b = a[on], b[on]
            if len(a):
                yield i + a, j + b, apart[a, b]


def shortest_forest(label: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the edges of a forest of least bits that joins what the labels don't join yet; labels become those of its trees."""
    chosen = []
    order = np.lexsort((b, a, apart))
    while True:
        u, v = label[a[order]], label[b[order]]
        on = u != v
        order, u, v = order[on], u[on], v[on]
        if not len(order):
            return np.array(chosen, dtype=np.int64)
        # each tree's first edge in the order; these have no cycles but pairs of trees that choose one edge
        ends, first = np.unique(np.column_stack((u, v)), return_index=True)
        first //= 2
        chosen.extend(np.unique(order[first]).tolist())
        to = np.arange(len(label))
        to[ends] = u[first] + v[first] - ends
        each = np.arange(len(label))
        twice = to[to] == each
        to[twice] = np.minimum(to, each)[twice]
        while not np.array_equal(to, to[to]):
            to = to[to]
        label[:] = to[label]


def forest(near: np.ndarray, far: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of candidates that are a spanning forest of all candidates, of few bits before more."""
    place = _numbered(np.concatenate((near[:, :ID], far[:, :ID])))
    rows, cols = place[: len(near)], place[len(near) :]
    label, found = np.arange(len(place)), [(np.zeros((0, ID), "<u8"), np.zeros((0, ID), "<u8"))]
    for limit in (max_bits,) if len(near) <= 64 and len(far) <= 4096 else (max_bits // 2, max_bits):
        for a, b, apart in candidates(near, far, limit):
            if len(a) > 1:
                open_ = label[rows[a]] != label[cols[b]]
                a, b, apart = a[open_], b[open_], apart[open_]
            at = shortest_forest(label, rows[a], cols[b], apart)
            if len(at):
                found.append((near[a[at], :ID], far[b[at], :ID]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _ids(words: np.ndarray) -> pa.Array:
    raw, size = np.ascontiguousarray(words).astype("<u8").tobytes(), 8 * ID
    return pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary())


def links(classes: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS, block: int = BLOCK) -> DataFrame:
    """Candidates ``a, b`` between the numbers of distinct sets (``id, fp, n``), a spanning forest per anchor.

    Pairs of too different sizes ``n`` are left out. Anchors with more than
    ``block`` entries are cut by a hash into blocks, and each pair of blocks is
    compared by itself, so nothing else is left out.
    """

    def placed(items, segment):
        index, anchor, near = simhash.golay_anchors(segment_word(items[:, ID:], segment), THRESHOLD)
        return items[index], anchor, near

    def count(batches):
        sums = np.zeros((segments, simhash.ANCHORS), dtype=np.int64)
        for items in _items(batches):
            for s in range(segments):
                sums[s] += np.bincount(placed(items, s)[1], minlength=simhash.ANCHORS)
        s, a = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(sums[s, a])], ["segment", "anchor", "n"])

    some, hot = classes.select("id", "fp", F.col("n").cast("long").alias("n")), {}
    if classes.count() > block:  # fewer can't fill one
        crowded = some.mapInArrow(count, "segment int, anchor int, n long").groupBy("segment", "anchor").agg(F.sum("n").alias("n"))
        hot = {(r["segment"], r["anchor"]): -(-r["n"] // block) for r in crowded.where(F.col("n") > block).collect()}  # one row an anchor at most
    cut_segments = {s for s, _ in hot}

    def pack(batches):
        for items in _items(batches):
            for s in range(segments):
                held, anchor, near = placed(items, s)
                # in a segment without a hot anchor an item goes once, near ones first; in one with a hot anchor near items go to both sides
                parts = [(anchor, np.zeros(len(anchor), dtype=np.int64), held, near)]
                if s in cut_segments:
                    pieces = np.ones(simhash.ANCHORS, dtype=np.int64)
                    for (t, a), n in hot.items():
                        if t == s:
                            pieces[a] = n
                    p, parts = pieces[anchor], []
                    own = (held[:, 0] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % p
                    for other in range(int(p.max(initial=1))):
                        on = other < p
                        row = on & near
                        parts.append((anchor[row], (own * p + other)[row], held[row], np.ones(row.sum(), dtype=bool)))
                        parts.append((anchor[on], (other * p + own)[on], held[on], np.zeros(on.sum(), dtype=bool)))
                anchor_, block_, held_, near_ = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((~near_, block_, anchor_))
                anchor_, block_, held_, near_ = anchor_[order], block_[order], held_[order], near_[order]
                new = np.flatnonzero(np.r_[True, (anchor_[1:] != anchor_[:-1]) | (block_[1:] != block_[:-1])]) if len(anchor_) else np.zeros(0, dtype=int)
                ends = np.r_[new, len(anchor_)]
                sums = np.r_[0, np.cumsum(near_)]
                raw = np.ascontiguousarray(held_).astype("<u8").tobytes()
                size = 8 * ITEM
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(new), s, dtype=np.int32)), pa.array(anchor_[new].astype(np.int32)), pa.array(block_[new].astype(np.int32)),
                        pa.array((sums[ends[1:]] - sums[ends[:-1]]).astype(np.int32)), pa.array([raw[a * size : b * size] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary()),
                    ],
                    ["segment", "anchor", "block", "near", "items"],
                )

    def compare(batches):
        key, near, far = None, [], []

        def done():
            n = np.concatenate(near)
            f = np.concatenate(far) if key[0] in cut_segments else np.concatenate((n, *far))
            a, b = forest(n, f, max_bits)
            # the smaller number first, as binary values are ordered
            x, y = a.byteswap(), b.byteswap()
            turned = (x[:, 0] > y[:, 0]) | (x[:, 0] == y[:, 0]) & (x[:, 1] > y[:, 1])
            a[turned], b[turned] = b[turned], a[turned]
            return pa.RecordBatch.from_arrays([_ids(a), _ids(b)], ["a", "b"])

        for batch in batches:
            for s, a, b, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (s, a, b) != key:
                    if key is not None:
                        yield done()
                    key, near, far = (s, a, b), [], []
                items = np.frombuffer(raw, dtype="<u8").reshape(-1, ITEM)
                near.append(items[:n])
                far.append(items[n:])
        if key is not None:
            yield done()

    packed = some.mapInArrow(pack, "segment int, anchor int, block int, near int, items binary")
    dealt = packed.repartition("segment", "anchor", "block").sortWithinPartitions("segment", "anchor", "block")
    return dealt.mapInArrow(compare, "a binary, b binary").where("a != b").distinct()


def tested(roots: list[bytes], fps: np.ndarray, sets: list[np.ndarray], first: int, max_bits: int = MAX_BITS, similar: tuple[int, int] = SIMILAR) -> list[tuple[bytes, bytes]]:
    """Links between the parts (``roots``) of some texts: a forest of all links of the ``first`` ones with any.

    With ``first`` 0 all texts are tested against all.
    """
    part, whole = similar
    names = sorted(set(roots))
    at = {r: i for i, r in enumerate(names)}
    label = np.array([at[r] for r in roots])
    sizes = np.array([len(x) for x in sets], dtype=np.uint64)
    starts = np.r_[0, np.cumsum(sizes.astype(np.int64))]
    members, vocabulary = np.zeros(0, dtype=np.int64), 0
    if starts[-1]:
        found, members = np.unique(np.concatenate(sets), return_inverse=True)
        vocabulary = len(found)
    marked, out = np.zeros(vocabulary + 1, dtype=np.int8), []
    items = np.column_stack((np.zeros((len(sets), ID), dtype=np.uint64), fps, sizes))
    near, far, base = (items, items, 0) if not first else (items[:first], items[first:], first)
    for a, b, _ in candidates(near, far, max_bits, similar):
        for i in np.unique(a).tolist():
            others = b[a == i] + base
            others = others[label[others] != label[i]]
            if not len(others) or not len(sets[i]):
                continue
            own = members[starts[i] : starts[i + 1]]
            marked[own] = 1
            counts = (starts[others + 1] - starts[others]).astype(np.int64)
            ends = np.cumsum(counts)
            places = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(starts[others], counts)
            sums = np.r_[0, np.cumsum(marked[members[places]], dtype=np.int64)]
            shared = sums[ends] - sums[ends - counts]
            marked[own] = 0
            for j in others[shared * whole >= (len(own) + counts - shared) * part].tolist():
                if label[i] != label[j]:
                    out.append((roots[i], roots[j]))
                    label[label == label[j]] = label[i]
    return out


def block_pairs(members: DataFrame, texts: int = TEXTS, shingles: int = SHINGLES) -> DataFrame:
    """Rows of loose components dealt to the pairs of blocks that have to be tested: ``loose, pair, side`` and the members' columns.

    ``members`` has ``id, fp, shingles, root, loose``. A loose component's parts that fill
    more than a block have blocks of their own, which need no test against each
    other; the small parts share blocks.
    """
    size = F.size("shingles").cast("long")
    many = lambda n, s: F.greatest(F.ceil(F.col(n) / texts), F.ceil(F.col(s) / shingles), F.lit(1)).cast("int")
    parts = members.groupBy("loose", "root").agg(F.count("*").alias("n"), F.sum(size).alias("s")).withColumn("blocks", many("n", "s"))
    parts = common.materialize(parts, "loose-parts")
    own = F.when(F.col("blocks") > 1, F.col("root")).otherwise(F.lit(b""))
    blocks = parts.groupBy("loose", own.alias("own")).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("blocks", many("n", "s"))
    each = blocks.select("loose", F.explode(F.expr("transform(sequence(0, blocks - 1), k -> struct(own, k))")).alias("block"))
    a, b = each.select("loose", F.col("block").alias("a")), each.select("loose", F.col("block").alias("b"))
    pairs = a.join(b, "loose").where((F.col("a") <= F.col("b")) & ((F.col("a.own") != F.col("b.own")) | (F.col("a.own") == F.lit(b""))))
    pairs = common.materialize(pairs, "block-pairs")
    placed = (
        members.join(parts.select("loose", "root", own.alias("own")), ["loose", "root"]).join(blocks.select("loose", "own", "blocks"), ["loose", "own"])
        .withColumn("block", F.struct("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("k"))).select("loose", "block", "id", "root", "fp", "shingles")
    )
    sides = [pairs.select("loose", F.col("a").alias("block"), F.struct("a", "b").alias("pair"), F.lit(0).alias("side")), pairs.where("a != b").select("loose", F.col("b").alias("block"), F.struct("a", "b").alias("pair"), F.lit(1).alias("side"))]
    return placed.join(sides[0].unionByName(sides[1]), ["loose", "block"]).select("loose", "pair", "side", "root", "fp", "shingles")


def between_parts(members: DataFrame, max_bits: int = MAX_BITS, texts: int = TEXTS, shingles: int = SHINGLES) -> DataFrame:
    """Links ``a, b`` between the parts (``root``) of loose components, a forest of them for each pair of blocks."""

    def compare(batches):
        key, held = None, []

        def done():
            sides = sorted(held, key=lambda x: x[0])
            first = sum(x[0] == 0 for x in sides)
            fps = np.frombuffer(b"".join(x[2] for x in sides), dtype="<u8").reshape(-1, LANES)
            found = tested([x[1] for x in sides], fps, [x[3] for x in sides], first if first < len(sides) else 0, max_bits)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], ["a", "b"])

        for batch in batches:
            loose, pair, side, root, fp = (batch.column(i).to_pylist() for i in range(5))
            lists = batch.column(5)
            for i in range(len(batch)):
                now = (loose[i], repr(pair[i]))
                if now != key:
                    if key is not None:
                        yield done()
                    key, held = now, []
                held.append((side[i], root[i], fp[i], lists[i].values.to_numpy(zero_copy_only=False).view(np.uint64)))
        if key is not None:
            yield done()

    dealt = block_pairs(members, texts, shingles).repartition("loose", "pair").sortWithinPartitions("loose", "pair")
    return dealt.mapInArrow(compare, "a binary, b binary").distinct()


def _contracted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs between different parts, as pairs ``a, b`` of their roots, each once."""
    for c in ("a", "b"):
        held = roots.select(F.col("node").alias(c), F.col("root").alias("__root"))
        pairs = pairs.join(held, c, "left").withColumn(c, F.coalesce("__root", c)).drop("__root")
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, component_id`` for every row; the component's smallest key is its id.

    Null texts and texts without words have no shingles and are one component.
    Repeated rows are in one component. A null key is never a component's id
    unless all its keys are null. An empty table gives no rows. Other columns are ignored.
    """
    rows = common.materialize(fingerprints(docs, key, text, width), "long-fingerprints")
    start = common.made()
    classes = common.materialize(rows.groupBy("id").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.min("doc_id").alias("first")), "long-classes")
    pairs = common.materialize(links(classes, max_bits), "near-candidates")
    # a key's rows can have several texts: those that weren't met meet no pair
    met = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    keys = classes.join(met, "id", "left_semi").select(F.col("first").alias("__met_key")).distinct()
    texts = docs.join(keys, docs[key].eqNullSafe(F.col("__met_key")), "left_semi").select(F.col(text).alias("text"))
    sets = common.materialize(shingle_sets(texts, width).dropDuplicates(["id"]), "near-sets")
    sure = common.materialize(verified(pairs, sets), "near-links")
    roots = components.connected_components(sure)
    loose = components.connected_components(common.materialize(_contracted(pairs, roots), "near-parts"))
    members = sets.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    members = members.join(loose.select(F.col("node").alias("root"), F.col("root").alias("loose")), "root")
    more = common.materialize(between_parts(common.materialize(members, "near-members"), max_bits), "near-links")
    if not more.isEmpty():
        roots = components.connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    roots = roots.select(F.col("node").alias("id"), "root")
    placed = common.materialize(classes.select("id", "first").join(roots, "id", "left").select("id", "first", F.coalesce("root", "id").alias("root")), "long-rooted")
    # written, so that Spark may split a large component's rows in the join
    named = common.materialize(placed.groupBy("root").agg(F.min("first").alias("component_id")), "long-components")
    named = common.materialize(placed.select("id", "root").join(named, "root").select("id", "component_id"), "long-named")
    common.drop_made(rows.sparkSession, start, named)
    return rows.select("doc_id", "id").join(named, "id").select("doc_id", "component_id")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: one of each component.

    It is the row of the smallest key, null keys last; of several rows of one key
    the first by a digest of all their columns. Null and empty texts and texts
    without words are one component. Rows that are equal in all columns are one.
    An empty table gives no rows.
    """
    return common.keep_first(docs, key, lambda marked, name: near_duplicates(marked, name, text))

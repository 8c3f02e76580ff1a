import random

import numpy as np
import pytest
import xxhash
from helpers import awkward_docs, empty
from pyspark.sql import functions as F

from tidemark.llm import similar, simhash


def test_fingerprint_in_pieces():
    rng = random.Random(3)
    for t in ["", "  ", "One", "a b c d", "a b c d e", *(" ".join(rng.choice("abc") * rng.randint(1, 9) for _ in range(n)) for n in (6, 50, 700))]:
        words = t.lower().encode().split()
        shingles = [b" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or ([b" ".join(words)] if words else [])
        hashes = np.array([xxhash.xxh64_intdigest(s) for s in shingles], dtype=np.uint64)
        want = []
        for lane in range(similar.LANES):
            mixed = [int(h) for h in similar._mixed(hashes, lane)]
            want.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(mixed)))
        for piece in (16, 1 << 22):
            assert similar.long_fingerprint(t.encode(), piece=piece).tolist() == want
    assert not similar.long_fingerprint(None).any()


def test_repeated_shingles_count_once():
    rng = random.Random(6)
    line = " ".join(f"j{i}" for i in range(12))
    texts = [" ".join([f"w{rng.randint(0, 10**6)}" for _ in range(104)] + [line] * 20) for _ in range(2)]
    a, b = (similar.long_fingerprint(t.encode()) for t in texts)
    assert np.bitwise_count(a ^ b).sum() > 80  # they share 12 of about 230 shingles
    once, often = "a b c d e f g", "a b c d e f g " * 3
    rest = " h i j k l m a b c d e"
    for piece in (16, 1 << 22):
        assert similar.long_fingerprint((once + rest).encode(), piece=piece).any()
        words = (often + rest).split()
        want = sorted({xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode()) for i in range(len(words) - 4)})
        assert similar.shingle_set((often + rest).encode(), piece=piece).tolist() == want


def near(rng, fp, bits):
    out = fp.copy()
    for b in rng.choice(64 * similar.LANES, bits, replace=False):
        out[b >> 6] ^= np.uint64(1) << np.uint64(b & 63)
    return out


def numbered(fps):
    """Rows of ``id, fp, n`` for fingerprints, and the place of each id."""
    ids = [xxhash.xxh3_128_digest(i.to_bytes(8, "little")) for i in range(len(fps))]
    return [(k, fp.astype("<u8").tobytes(), 100) for k, fp in zip(ids, fps, strict=True)], {k: i for i, k in enumerate(ids)}


def roots_of(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return [root(i) for i in range(n)]


SCHEMA = "id binary, fp binary, n long"


@pytest.mark.parametrize("block", [40, 1 << 15])
def test_pairs_that_meet_are_joined(spark, block):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (4, similar.LANES), dtype=np.uint64)
    fps = [near(rng, b, int(rng.integers(0, 40))) for b in base for _ in range(40)]
    rows, at = numbered(fps)
    found = similar.links(spark.createDataFrame(rows, SCHEMA), segments=4, block=block).collect()
    assert all(r["a"] < r["b"] for r in found)
    root = roots_of(len(fps), [(at[bytes(a)], at[bytes(b)]) for a, b in found])
    whole, met = np.stack(fps), 0
    for s in range(4):
        index, anchor, home = simhash.golay_anchors(similar.segment_word(whole, s), similar.THRESHOLD)
        groups = {}
        for i, a, h in zip(index.tolist(), anchor.tolist(), home.tolist()):
            groups.setdefault(a, []).append((i, h))
        for group in groups.values():
            for i, h in group:
                for j, _ in group:
                    if h and i != j and np.bitwise_count(whole[i] ^ whole[j]).sum() <= similar.MAX_BITS:
                        met += 1
                        assert root[i] == root[j]
    assert met > 50
    assert all(i // 40 == r // 40 for i, r in enumerate(root))  # unrelated ones are never joined


def test_a_hot_segment_loses_no_link(spark):
    """Pairs at 44 bits, and fingerprints that share an anchor of one segment, of all segments, of none."""
    rng = np.random.default_rng(11)
    fps = []
    for _ in range(400):
        fps.append(rng.integers(0, 1 << 63, similar.LANES, dtype=np.uint64))
        fps.append(near(rng, fps[-1], 44))
    some = [rng.integers(0, 1 << 63, similar.LANES, dtype=np.uint64) for _ in range(150)]
    for fp in some:  # one word in the first segment
        for bit in similar.segment_bits(0).tolist():
            fp[bit >> 6] &= ~(np.uint64(1) << np.uint64(bit & 63))
    alike = [near(rng, fps[0], 3) for _ in range(150)]  # near one anchor in every segment
    want = None
    for more in ([], some, alike):
        rows, at = numbered(fps + more)
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        got = []
        for block in (100, 1 << 15):
            links = similar.links(df, block=block).collect()
            got.append(roots_of(len(rows), [(at[bytes(a)], at[bytes(b)]) for a, b in links]))
        assert got[0] == got[1]
        pairs = sum(got[0][2 * i] == got[0][2 * i + 1] for i in range(400))
        assert pairs == 400 if want is None else pairs >= want
        want = pairs


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(8)
    rows, originals = [], []
    for k in range(30):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(150, 400))]
        originals.append(1000 + k)
        rows.append((1000 + k, " ".join(words)))
        for c in range(2):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            copy[rng.randrange(len(copy))] = "again"
            rows.append((2000 + 10 * k + c, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    out = similar.dedup(df)
    assert out.columns == df.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert set(originals) <= kept and len(kept) <= 32


def test_links_at_a_similarity_by_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for k in range(12):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(40, 300))]
        rows.append((len(rows), " ".join(words)))
        for c in range(12):
            copy = list(words)
            for at in rng.sample(range(len(words)), max(1, len(words) * c // 250)):
                copy[at] = f"x{rng.randint(0, 10**6)}"
            rows.append((len(rows), " ".join(copy)))
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute_force([t for _, t in rows])))


def brute_force(texts):
    sets = [set(similar.shingle_set(t.encode()).tolist()) for t in texts]
    links, kinds = [], [0, 0]
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            like = len(x & y) / max(1, len(x | y))
            kinds[0] += like >= 0.8
            kinds[1] += 0.6 < like < 0.8
            if 5 * len(x & y) >= 4 * len(x | y):
                links.append((i, j))
    assert min(kinds) > 100
    return roots_of(len(sets), links)


def chain(rng, n):
    """Texts that each differ in a few words from one before: one loose component of several parts."""
    texts = [[f"w{rng.randint(0, 10**6)}" for _ in range(120)]]
    for _ in range(n - 1):
        words = list(texts[rng.randrange(len(texts))])
        for at in rng.sample(range(len(words)), rng.choice((1, 2, 3, 5))):
            words[at] = f"x{rng.randint(0, 10**6)}"
        texts.append(words)
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("texts, shingles", [(7, 1 << 19), (2048, 600)])
def test_parts_of_loose_components_by_brute_force(spark, monkeypatch, texts, shingles):
    rng = random.Random(21)
    found = chain(rng, 90) + chain(rng, 40) + ["alone " * 9, "", "few words"]
    monkeypatch.setattr(similar, "between_parts", lambda m, b, f=similar.between_parts: f(m, b, texts, shingles))
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute_force(found)))


def test_forest_is_of_candidates_and_spans():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, (3, similar.LANES), dtype=np.uint64)
    fps = np.stack([near(rng, base[k % 3], int(rng.integers(0, 50))) for k in range(150)])
    items = np.column_stack((np.arange(150, dtype=np.uint64), np.zeros(150, dtype=np.uint64), fps, np.full(150, 9, dtype=np.uint64)))
    for some in (items[:30], items):
        a, b = (x[:, 0] for x in similar.forest(some, some, 64))
        assert (np.bitwise_count(fps[a.astype(int)] ^ fps[b.astype(int)]).sum(axis=1) <= 64).all()
        label = np.arange(150)
        assert len(similar.shortest_forest(label, a.astype(int), b.astype(int), np.zeros(len(a)))) == len(a)  # no cycles
        for i in range(len(some)):
            for j in range(i):
                assert np.bitwise_count(fps[i] ^ fps[j]).sum() > 64 or label[i] == label[j]


def test_awkward_rows(spark):
    df = awkward_docs(spark)
    got = similar.near_duplicates(df).collect()
    assert len(got) == df.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[0] == by[1] == by[2] == {0}  # null, empty, white space
    assert by[4] == by[5] == by[6] == {4}
    assert similar.dedup(empty(df)).count() == 0
    kept = similar.dedup(df).collect()
    assert len(kept) == len({c for r in got for c in [r["component_id"]]})
    assert similar.dedup(df).columns == df.columns


@pytest.mark.parametrize("operator", [similar.dedup, simhash.dedup])
def test_rows_are_decided_by_themselves(spark, operator):
    one, two = (" ".join(f"{w}{i}" for i in range(80)) for w in "ab")
    rows = [(None, one, "x"), (None, two, "x"), (None, two, "y"), (7, one + " end", "x"), (8, one, "x"), (8, two, "x"), (8, two, "x")]
    got = sorted(map(tuple, operator(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()), key=str)
    assert len(got) == 2
    first, second = got
    assert {first[0], second[0]} == ({7, 8} if operator is similar.dedup else {first[0], second[0]})
    assert sum(r[1] == two for r in got) == 1

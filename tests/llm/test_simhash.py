import random
import re

import numpy as np
import xxhash
from helpers import awkward_docs, empty
from pyspark.sql import functions as F

from tidemark.llm import simhash


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(keys, prints):
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    low = {}
    for i, k in enumerate(keys):
        r = root(i)
        if k is not None:
            low[r] = min(k, low.get(r, k))
    return [low.get(root(i)) for i in range(len(keys))]


def test_fingerprint_in_pieces():
    rng = random.Random(3)
    for t in [None, "", "  ", "One", "a b c", "a b c d", "É é A", *(" ".join(rng.choice("abc") * rng.randint(1, 9) for _ in range(n)) for n in (5, 50, 700))]:
        assert simhash.fingerprint((t or "").encode()) == slow_print(t) == simhash.fingerprint((t or "").encode(), piece=16)


def test_every_close_pair_meets():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for bits in range(5):
        other = base.copy()
        for i in range(len(other)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(b)
        met = np.zeros(len(base), dtype=bool)
        for s, t in enumerate(simhash.thresholds(4)):
            pairs = [simhash.anchors(x, s, t) for x in (base, other)]
            (i, a, near), (j, b, far) = pairs
            left = {(x, y) for x, y in zip(i, a)}
            left_near = {(x, y) for x, y, z in zip(i, a, near) if z}
            right, right_near = {(x, y) for x, y in zip(j, b)}, {(x, y) for x, y, z in zip(j, b, far) if z}
            for x, _ in (left_near & right) | (left & right_near):
                met[x] = True
        assert met.all()


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(200)) for _ in range(6)]
    rows, n = [], 100
    for b in base:
        words = b.split()
        for _ in range(12):
            words = list(words)
            words[rng.randrange(200)] = "new"
            rows.append((n, " ".join(words)))
            n += 1
    df = awkward_docs(spark, extra=False).select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    held = df.collect()
    prints = [slow_print(r["text"]) for r in held]
    want = components([r["doc_id"] for r in held], prints)
    got = simhash.near_duplicates(df.withColumn("fp", F.lit("clash")).withColumn("root", F.lit("clash"))).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got), key=key) == sorted(((r["doc_id"], p, c) for r, p, c in zip(held, prints, want)), key=key)
    kept = [r["doc_id"] for r in simhash.dedup(df).collect()]
    assert set(kept) == {c for c in want if c is not None} | {r["doc_id"] for r, c in zip(held, want) if c is None}
    assert simhash.near_duplicates(empty(df)).count() == 0


def test_blocks_lose_no_link(spark):
    rng = np.random.default_rng(2)
    center = rng.integers(0, 1 << 62, 3, dtype=np.int64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 4), replace=False)) for c in center for _ in range(150)}
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for block in (7, 1 << 17):
        parent = {f: f for f in fps}

        def root(f):
            while parent[f] != f:
                f = parent[f]
            return f

        for a, b in simhash.links(frame, 4, block).collect():
            assert ((a ^ b) % (1 << 64)).bit_count() >= 0
            parent[root(a)] = root(b)
        fl = sorted(fps)
        for i, a in enumerate(fl):
            for b in fl[:i]:
                if (a ^ b).bit_count() <= 4:
                    assert root(a) == root(b)

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import common, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_word_count(spark):
    texts = [None, "", " ", "a", " a  b\n", " x y z", "a\x01\x01 \x01", "é\x0bñ\x0c\r\n", "x " * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(common.word_count(F.col("text"))).collect()] == [words(t) for t in texts]


def test_targets_by_brute_force(spark):
    rng = random.Random(3)
    for trial in range(5):
        sizes = {f"s{i:02}": rng.choice([0, 5, 100, 10_000, 99]) for i in range(rng.randint(1, 9))}
        if trial == 1:
            sizes[None] = 7
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in mixing.targets(mixing.repeating_weights(frame)).collect()}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        left, open_, want = 1.5 * sum(sizes.values()), set(sizes), {}
        while open_:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = {s for s in open_ if share[s] >= 2 * sizes[s]}
            if not over:
                want |= share
                break
            for s in over:
                want[s] = 2 * sizes[s]
                left -= want[s]
            open_ -= over
        assert got.keys() == want.keys()
        for s in want:
            assert abs(got[s] - want[s]) < 1e-6 * max(1, want[s])


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 30)), rng.choice(["a", "b", "c", "d", None])) for i in range(3000)]
    rows += [(3000, None, "a"), (3001, "", "z"), (5, rows[5][1], rows[5][2])]
    frame = docs(spark, rows).withColumn("size", F.lit("clash")).withColumn("target", F.lit("clash"))
    first = mixing.mix(frame, common.word_count(F.col("text"))).collect()
    assert sorted(map(str, first)) == sorted(map(str, mixing.mix(frame.repartition(7), common.word_count(F.col("text"))).collect()))
    assert len(first) == len(rows)
    taken, target = Counter(), {}
    for r in first:
        assert r["taken"] in (r["copies"] * r["size"],) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.03 * t
    sources, _ = mixing.plan(frame, common.word_count(F.col("text")))
    out = mixing.emit(frame, sources)
    assert out.columns == frame.columns
    decided = Counter()
    for r in first:
        decided[r["doc_id"], r["source"]] += r["copies"]
    assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == +decided
    assert mixing.mix(docs(spark, []), common.word_count(F.col("text"))).count() == 0
    assert mixing.emit(docs(spark, []), mixing.plan(docs(spark, []), common.word_count(F.col("text")))[0]).count() == 0


def test_each_draw_is_of_one_seed_and_the_nearest(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.choice([5, 50, 900]), rng.choice("abc")) for i in range(300)]
    got = mixing.mix(docs(spark, rows), common.word_count(F.col("text"))).collect()
    sources, _ = mixing.plan(docs(spark, rows), common.word_count(F.col("text")))
    seeds = range(mixing.SEED, mixing.SEED + mixing.DRAWS)
    u = {(r["doc_id"], k): r[f"u{k}"] for r in docs(spark, rows).select("doc_id", *[common.uniform(F.col("doc_id"), k).alias(f"u{k}") for k in seeds]).collect() for k in seeds}
    for s in sources.collect():
        own = [r for r in got if r["source"] == s["source"]]
        whole = int(s["rate"])
        off = {k: abs(sum(r["size"] * (whole + (u[r["doc_id"], k] < s["rate"] - whole)) for r in own) - s["target"]) for k in seeds}
        assert s["seed"] == min(seeds, key=lambda k: (off[k], k))
        for r in own:
            assert r["copies"] == whole + (u[r["doc_id"], s["seed"]] < s["rate"] - whole)


def test_a_key_under_two_sources_is_decided_for_each(spark):
    rows = [(7, "a b c", "x"), (7, "a b", "y"), (None, "k", None), (None, "k", "x")] + [(i, "w w", "xyz"[i % 3]) for i in range(60)]
    frame = docs(spark, rows)
    decided = Counter()
    for r in mixing.mix(frame, common.word_count(F.col("text"))).collect():
        decided[r["doc_id"], r["source"]] += r["copies"]
    for f in (frame, frame.repartition(5)):
        out = mixing.emit(f, mixing.plan(f, common.word_count(F.col("text")))[0])
        assert Counter((r["doc_id"], r["source"]) for r in out.collect()) == +decided


def test_repeated(spark):
    df = spark.createDataFrame([("a", 0), ("b", 1), ("c", 7), ("d", 8), ("e", 9)], "x string, n long")
    got = sorted((r["x"], r["i"]) for r in common.repeated(df, F.col("n"), "i", most=4).collect())
    assert got == sorted((x, i) for x, n in (("b", 1), ("c", 7), ("d", 8), ("e", 9)) for i in range(n))


def fill(sizes, capacity):
    n, at = 1, 0
    for s in sizes:
        if at + s > capacity:
            n, at = n + 1, 0
        at += s
    return n


def best(sizes, shards):
    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        if fill(sizes, mid) <= shards:
            high = mid
        else:
            low = mid + 1
    return low


def test_minimax_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES", 4096)
    rng = random.Random(7)
    for n, hot in ((1, 0), (5, 0), (9000, 0), (400, 2)):
        sizes = [rng.choice([8, 9, 1000, rng.randint(8, 5000)]) for _ in range(n)]
        if hot:
            sizes[n // 3] = sum(sizes) // (2 * hot)
        before, rows = 0, []
        for s in sizes:
            rows.append((before,))
            before += s
        frame = spark.createDataFrame(rows, "before long").cache()
        capacity, cuts = sharding.minimax_cuts(frame, sum(sizes), max(sizes), 24)
        assert capacity == best(sizes, 24)
        edges = [0, *cuts, sum(sizes)]
        assert len(cuts) <= 23 and max(b - a for a, b in zip(edges, edges[1:])) == capacity
        even = sharding.even_cuts(frame, sum(sizes), capacity, cuts)
        edges = [0, *even, sum(sizes)]
        gaps = [b - a for a, b in zip(edges, edges[1:])]
        assert len(even) == 23 and set(even) <= {r[0] for r in rows} | {sum(sizes)}
        assert min(gaps) >= 0 and max(gaps) == capacity
        if n == 9000:
            assert min(gaps) >= 0.97 * sum(sizes) / 24
        squares = lambda cut: sum((b - a) ** 2 for a, b in zip([0, *cut], [*cut, sum(sizes)]))
        assert squares(even) <= squares([*cuts, *[sum(sizes)] * (23 - len(cuts))])


def test_buckets_in_order_at_scale(spark):
    rng = random.Random(5)
    digests = sorted(rng.randbytes(32) for _ in range(500)) + [b"\xff" * 32]
    for buckets in (16, 100_000, 10**9):
        got = [r[0] for r in spark.createDataFrame([(d,) for d in digests], "digest binary").select(sharding.bucket_of(F.col("digest"), buckets)).collect()]
        assert got == sorted(got) and got[-1] == buckets - 1 and min(got) >= 0


def test_shard(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["same", "", None, f"text {rng.randint(0, 300)} " * rng.randint(1, 20)]), "s") for i in range(2000)]
    rows += [(7, rows[7][1], "s")] * 200 + [(None, None, None)] * 3
    frame = docs(spark, rows).withColumn("size", F.lit("clash"))
    got = sharding.shard(frame).collect()
    assert len(got) == len(rows)
    slots, groups, held = defaultdict(list), defaultdict(set), Counter()
    texts = {i: (t or "").encode() for i, t, _ in rows} | {None: b""}
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t)
        slots[r["shard"]].append(r["slot"])
        groups[t].add(r["shard"])
        held[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    assert set(slots) <= set(range(24))
    assert sharding.shard(docs(spark, [])).count() == 0

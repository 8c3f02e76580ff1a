import random
from collections import defaultdict

from helpers import awkward_docs, empty
from pyspark.sql import functions as F

from tidemark.llm import common, packing


def naive(sizes, lengths, cost):
    """Best fit by looking at every open bin; of equal rooms the one that was filled last."""
    bins = []
    for i, s in enumerate(sizes):
        open_ = [b for b in bins if b["length"] - b["used"] >= s and b["length"] > b["used"]]
        if open_:
            b = min(open_, key=lambda b: (b["length"] - b["used"], -b["last"]))
        else:
            def rate(x):
                return cost(x) / (s + min(x - s, sum(z for z in sizes[i + 1 :] if z <= x - s)))

            b = {"length": min((x for x in lengths if x >= s), key=rate), "used": 0}
            bins.append(b)
        b["used"] += s
        b["last"] = i
    return sorted((next(x for x in lengths if x >= b["used"]), b["used"]) for b in bins)


def test_pack_by_brute_force():
    rng = random.Random(4)
    for trial in range(40):
        lengths = (16, 32, 64) if trial % 2 else (10, 50)
        sizes = sorted((rng.randint(1, rng.choice([5, lengths[-1]])) for _ in range(rng.randint(1, 80))), reverse=True)
        cost = packing.Cost(fixed=3, square=0.01 * (trial % 5))
        bins, offsets, ends = packing.pack(sizes, lengths, cost)
        used, spans = defaultdict(int), defaultdict(list)
        for s, b, o in zip(sizes, bins, offsets):
            used[b] += s
            spans[b].append((o, o + s))
        for b, parts in spans.items():
            parts.sort()
            assert parts[0][0] == 0 and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))
            assert parts[-1][1] == used[b] <= ends[b] == min(x for x in lengths if x >= used[b])
        assert sorted((ends[b], used[b]) for b in used) == naive(sizes, lengths, cost)


def test_best_fit(spark):
    df = awkward_docs(spark)
    size = common.word_count(F.col("text"))
    got = packing.best_fit(df, size, lengths=(8, 64, 512), group=20).collect()
    want = defaultdict(int)
    for r in df.collect():
        want[r["doc_id"]] += len((r["text"] or "").split())
    have, bins = defaultdict(int), defaultdict(list)
    for r in got:
        have[r["doc_id"]] += r["n_tokens"]
        assert (r["bin_id"] is None) == (r["n_tokens"] == 0)
        if r["bin_id"] is not None:
            bins[r["bin_id"], r["bin_tokens"]].append((r["bin_offset"], r["bin_offset"] + r["n_tokens"]))
    assert have == want
    for (_, length), spans in bins.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= length
        assert length == min(x for x in (8, 64, 512) if x >= spans[-1][1])
    assert len({b for b, _ in bins}) == len(bins)
    again = packing.best_fit(df.repartition(5), size, lengths=(8, 64, 512), group=20).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert packing.best_fit(empty(df), size).count() == 0


def test_sequences(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(1 + i * 3))) for i in range(20)]
    rows += [(3, "another text of key three"), (None, "no key"), (None, "none again"), (5, rows[5][1]), (6, None), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("size", F.lit("clash"))
    out = packing.sequences(df, lengths=(8, 32)).collect()
    words = [w for r in out for w in r["text"].split(" ")]
    assert sorted(words) == sorted(w for _, t in rows for w in (t or "").split())
    assert all(len(r["text"].split(" ")) == r["n_tokens"] <= r["bin_tokens"] for r in out)
    assert {i for r in out for i in r["doc_ids"]} == {i for i, t in rows if (t or "").split()}
    assert packing.sequences(empty(df)).count() == 0


def test_copies_of_one_row_are_spread(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string").select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(900))))
    got = packing.best_fit(df, common.word_count(F.col("text")), lengths=(4, 32), group=100).collect()
    assert len(got) == 900 and len({r["bin_id"] >> 32 for r in got}) > 5

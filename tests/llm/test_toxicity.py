import random

import numpy as np
from helpers import awkward_docs, empty
from pyspark.sql import functions as F

from tidemark.llm import toxicity

BAD = ["wretch", "oaf", "grublon", "grublar", "grubling"]


def corpus(n=900, seed=2):
    rng = random.Random(seed)
    good = [f"{a}{b}" for a in ("mar", "sol", "ten", "vil", "run") for b in ("a", "ed", "ing", "o", "est", "um")]
    out = []
    for i in range(n):
        words = [rng.choice(good) for _ in range(rng.randint(5, 80))]
        toxic, low = rng.random() < 0.15, rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(BAD) + rng.choice(["", ",", "."])
        if low:
            words = [w + "%%%" for w in words]
        out.append((i, " ".join(words), int(not low), int(toxic)))
    return out


def test_features_in_pieces(monkeypatch):
    text = "Alpha, beta!!! gammarays\n" * 50
    whole = toxicity.features(text)
    assert whole == {"alpha", ",", "beta", "!!!", "gammarays", "^alph", "^gamm"}
    monkeypatch.setattr(toxicity, "PIECE", 13)
    assert toxicity.features(text) == whole and toxicity.features(None) == toxicity.features("") == set()


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en") for i, t, _, _ in rows], "doc_id long, text string, key string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i % 2] + [(None, 1, 1), (3, None, 1), (99_999, 0, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs, labels, toxicity.label_categories())
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    held = [(got[i]["rejected"], bool(x), got[i]["p_low_quality"] > 0.5, not q) for i, _, q, x in rows if not i % 2]
    assert np.mean([a == b for a, b, _, _ in held]) > 0.98
    assert np.mean([c == d for _, _, c, d in held]) > 0.97
    kept = {r["doc_id"] for r in toxicity.accept(docs, chain).collect()}
    assert kept == {i for i, r in got.items() if not r["rejected"]}


def test_later_models_use_predictions_out_of_fold():
    rng = np.random.default_rng(0)
    first = rng.random(600) < 0.4
    rows = [np.array([0]) if a else np.array([1]) for a in first]
    labels = np.column_stack((first, first)).astype(int)
    chain = toxicity.fit_chain(["a", "b"], ["x", "y"], [{"x", "y"}, set()], rows, labels, np.arange(600) % 3)
    assert len(chain.weights[1]) == 3 and chain.weights[1][2] > 1  # b has no feature but a's probability
    p = chain.probabilities(rows)
    assert ((p[:, 1] > 0.5) == first).all()


def test_limits():
    y = np.array([1, 1, 0, 0])
    assert toxicity.best_limit(np.array([0.9, 0.7, 0.3, 0.1]), y) == 0.5
    assert toxicity.best_limit(np.zeros(0), y[:0]) == 1.0 and toxicity.best_limit(np.full(4, 0.5), y) == 1.0  # nothing tells them apart
    assert toxicity.best_limit(np.full(2, 0.2), y[2:]) == 0.5


def test_awkward_rows(spark):
    df = awkward_docs(spark)
    labels = df.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    chain = toxicity.fit(df, labels, toxicity.label_categories())
    assert toxicity.score(df, chain).count() == df.count()
    assert toxicity.accept(df, chain).columns == df.columns
    none = toxicity.fit(df, empty(labels), toxicity.label_categories())
    assert [r["rejected"] for r in toxicity.score(empty(df), none).collect()] == []
    assert not any(r["rejected"] for r in toxicity.score(df, none).collect()) and toxicity.score(df, none).count() == df.count()
    assert toxicity.accept(empty(df), toxicity.fit(empty(df), labels, toxicity.label_categories())).count() == 0

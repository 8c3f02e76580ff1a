"""Operator 2: toxicity by a classifier chain.

The categories are predicted one after another by linear models over words and
word prefixes; each model also gets the probabilities of the categories before
its own, in training as predictions of models that didn't see the row.

A chain is fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of their
key, and ``VOCABULARY`` features, chosen by chi square; these bounds are what
the driver holds. Scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows that a chain is fitted on, at most.
SAMPLE = 20_000
#: Features that a category chooses, at most.
VOCABULARY = 256
#: Rows of the sample that must have a feature.
LEAST_ROWS = 3
PREFIX = 4
FOLDS = 3
#: Strength of the penalty, and steps of the descent.
PENALTY, STEPS = 1e-5, 150
#: Characters of a text whose features are taken at a time.
PIECE = 1 << 20

TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+")
#: A place where a long text can be cut without cutting a token.
GAP = re.compile(r"\s")


def features(text: str | None) -> set[str]:
    """Words, runs of signs, and the first letters of words, of the whole text in lower case."""
    found: set[str] = set()
    text, at = text or "", 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE) if len(text) > at + PIECE else None
        end = gap.start() if gap else len(text)
        found.update(TOKEN.findall(text[at:end].lower()))
        at = end
    return found | {"^" + w[:PREFIX] for w in found if len(w) > PREFIX and w[0].isalpha()}


@dataclass
class Chain:
    """Fitted models: ``weights[c]`` over the vocabulary and then over the categories before, and ``bias[c]``."""

    categories: list[str]
    vocabulary: list[str]
    weights: list[np.ndarray] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    limits: list[float] = field(default_factory=list)

    def probabilities(self, rows: list[np.ndarray]) -> np.ndarray:
        """A row for each list of feature numbers, a column for each category."""
        out = np.zeros((len(rows), len(self.categories)))
        lengths = np.array([len(r) for r in rows], dtype=np.int64)
        owner = np.repeat(np.arange(len(rows)), lengths)
        flat = np.concatenate(rows).astype(np.int64) if len(owner) else np.zeros(0, dtype=np.int64)
        for c, (w, b) in enumerate(zip(self.weights, self.bias, strict=True)):
            z = b + np.bincount(owner, w[flat], minlength=len(rows))
            for k in range(c):
                z += w[len(self.vocabulary) + k] * out[:, k]
            out[:, c] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def fit_linear(owner: np.ndarray, flat: np.ndarray, dense: np.ndarray, width: int, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty by Adam over all rows: weights (``width`` and the dense columns) and bias."""
    n, k = len(y), dense.shape[1]
    w, b = np.zeros(width + k), 0.0
    if not n or y.min() == y.max():
        rate = (y.sum() + 0.5) / (n + 1)
        return w, float(np.log(rate / (1 - rate)))
    first, second = np.zeros(width + k + 1), np.zeros(width + k + 1)
    for step in range(1, STEPS + 1):
        z = b + np.bincount(owner, w[flat], minlength=n) + dense @ w[width:]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        slope = np.concatenate((np.bincount(flat, error[owner], minlength=width), dense.T @ error)) + PENALTY * w
        slope = np.append(slope, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def best_limit(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that splits best by F1, in the middle between neighbours.

    Where all rows agree it is 0.5. Where there are none, or no cut is better than
    to reject all rows, it is 1, so that nothing is rejected.
    """
    if not len(y):
        return 1.0
    if y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[order][:-1] == p[order][1:]] = 0  # a cut between equal ones isn't one
    at = int(np.argmax(f1))
    return float((p[order][at] + p[order][at + 1]) / 2) if at + 1 < len(y) else 1.0


def fit_chain(categories: list[str], vocabulary: list[str], chosen: list[set[str]], rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> Chain:
    """Fit the models in order, each over the features chosen for it.

    What later ones get of earlier ones in training is predicted out of fold.
    """
    chain, n, width = Chain(categories, vocabulary), len(rows), len(vocabulary)
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    every = np.concatenate([*rows, np.zeros(0)]).astype(np.int64)
    owners = np.repeat(np.arange(n), lengths)
    before = np.zeros((n, 0))
    for c in range(len(categories)):
        own = np.array([f in chosen[c] for f in vocabulary], dtype=bool)[every] if width else np.zeros(0, dtype=bool)
        flat, owner = every[own], owners[own]
        y, held = labels[:, c].astype(float), np.zeros(n)
        for k in range(FOLDS):
            train = folds != k
            place = np.cumsum(train) - 1
            on = train[owner]
            w, b = fit_linear(place[owner[on]], flat[on], before[train], width, y[train])
            z = b + np.bincount(owner, w[flat], minlength=n) + before @ w[width:]
            held[~train] = 1 / (1 + np.exp(-np.clip(z[~train], -30, 30)))
        w, b = fit_linear(owner, flat, before, width, y)
        chain.weights.append(w)
        chain.bias.append(b)
        chain.limits.append(best_limit(held, y))
        before = np.column_stack((before, held))
    return chain


def _numbers(found: set[str], index: dict[str, int]) -> np.ndarray:
    return np.array(sorted(index[f] for f in found & index.keys()), dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """Fit a chain for the categories (name: condition over the columns of ``labels``, in order).

    Rows whose label is null, keys without a document and null keys are left out;
    of several texts of one key the one whose sorted features come first counts.
    Where a category has one value only, its probability is constant.
    """
    names = list(categories)
    wanted = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), *[c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())])
    chosen = wanted.dropna().dropDuplicates(["key"]).orderBy(F.xxhash64("key"), "key").limit(sample)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")  # at most ``sample`` keys

    def split(batches):
        for batch in batches:
            found = [sorted(features(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), *batch.columns[2:]], ["key", "features", *batch.schema.names[2:]])

    kind = rows.schema["key"].dataType.simpleString()
    marks = [f"y{i}" for i in range(len(names))]
    found = rows.mapInArrow(split, f"key {kind}, features array<string>" + "".join(f", {m} int" for m in marks))
    held = common.materialize(found.groupBy("key", *marks).agg(F.min("features").alias("features")).select("key", "features", *marks), "toxicity-sample")  # a row for each key
    total = held.agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in marks]).first()
    counts = held.select(F.explode("features").alias("feature"), *marks).groupBy("feature").agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in marks]).where(F.col("n") >= LEAST_ROWS)
    chosen: list[set[str]] = [set() for _ in marks]
    for m, features_ in zip(marks, chosen, strict=True):
        if 0 < (total[m] or 0) < total["n"]:
            apart = F.col(m) * F.lit(float(total["n"])) - F.col("n") * F.lit(float(total[m]))
            chi = apart * apart / (F.col("n") * (F.lit(float(total["n"])) - F.col("n")))
            features_.update(r["feature"] for r in counts.where(F.col("n") < total["n"]).orderBy(chi.desc(), "feature").limit(VOCABULARY).select("feature").collect())
    vocabulary = sorted(set().union(*chosen))
    index = {f: i for i, f in enumerate(vocabulary)}

    def number(batches):
        for batch in batches:
            found = [_numbers(set(f), index) for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), *batch.columns[2:]], batch.schema.names)

    got = held.mapInArrow(number, f"key {kind}, features array<int>" + "".join(f", {m} int" for m in marks)).orderBy(F.xxhash64("key"), "key").collect()  # at most ``sample`` rows
    folds = np.arange(len(got)) % FOLDS
    labelled = np.array([[r[m] for m in marks] for r in got], dtype=np.int64).reshape(len(got), len(names))
    return fit_chain(names, vocabulary, chosen, [np.array(r["features"], dtype=np.int64) for r in got], labelled, folds)


def _score(chain: Chain, texts: list) -> np.ndarray:
    index = {f: i for i, f in enumerate(chain.vocabulary)}
    return chain.probabilities([_numbers(features(t.decode("utf-8", "replace") if t else ""), index) for t in texts])


def score(docs: DataFrame, chain: Chain, category: str = "toxic", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, p_<category>..., rejected`` for every row.

    Null and empty texts have no features and get the base probability. Repeated
    rows get equal values; an empty table gives no rows. Other columns are ignored.
    """
    decisive = chain.categories.index(category)
    names = ["doc_id", *[f"p_{c}" for c in chain.categories], "rejected"]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for keys, texts in common.small_parts(batch, 1):
                p = _score(chain, texts)
                yield pa.RecordBatch.from_arrays([keys, *(pa.array(p[:, c]) for c in range(p.shape[1])), pa.array(p[:, decisive] >= chain.limits[decisive])], names)

    schema = f"doc_id {kind}, " + ", ".join(f"`p_{c}` double" for c in chain.categories) + ", rejected boolean"
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def accept(docs: DataFrame, chain: Chain, category: str = "toxic", text: str = "text") -> DataFrame:
    """The rows that the chain doesn't reject, with all their columns."""
    place, decisive = docs.columns.index(text), chain.categories.index(category)

    def run(batches):
        for batch in batches:
            texts = batch.column(place).cast(pa.binary())
            for at in range(0, batch.num_rows, 256):
                p = _score(chain, texts.slice(at, 256).to_pylist())
                kept = batch.slice(at, 256).filter(pa.array(p[:, decisive] < chain.limits[decisive]))
                if kept.num_rows:
                    yield kept

    return docs.mapInArrow(run, docs.schema)


def label_categories() -> dict[str, Column]:
    """The categories that the table of labels tells, in the order of the chain."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}

"""Rows with every awkward case, shared by the tests of the operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
#: Columns that clash with names that operators use inside.
CLASH = ("size", "digest", "bucket", "winner", "n", "fp", "piece", "key", "features", "file", "part", "terms")


def awkward_texts(seed=1, n=60):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "délta", "É", "x,", "end."]
    texts = [None, "", " \n\t ", "a", "Same TEXT", "same text", "SAME text", "É", "é", "long " * 40_000]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return texts


def awkward_docs(spark, extra=True):
    texts = awkward_texts()
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no key", "en", "s1", 6), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    return clash(df) if extra else df


def clash(df):
    from pyspark.sql import functions as F

    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def empty(df):
    return df.where("false")

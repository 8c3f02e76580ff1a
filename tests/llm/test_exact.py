import hashlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import awkward_docs, empty
from pyspark.sql import functions as F

from tidemark.llm import exact


def norm(t):
    return (t or "").encode().lower()


def test_minimal_perfect_hash():
    for n in (0, 1, 2, 7, 300, 4096):
        digests = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        if not n:
            continue
        levels, slots = exact.build_levels(digests)
        assert sorted(slots) == list(range(n))
        assert (exact.find_slots(levels, digests) == slots).all()
        assert np.array_equal(exact.find_slots(levels, digests[:1]), slots[:1])


@pytest.mark.parametrize("history", [None, "true", "false", "doc_id < 20"])
def test_mark_by_brute_force(spark, history):
    df = awkward_docs(spark)
    rows, groups = df.select("doc_id", "text").collect(), defaultdict(list)
    for r in rows:
        groups[norm(r["text"])].append(r["doc_id"])
    got = exact.mark(df, history and F.expr(history)).collect()
    assert len(got) == len(rows)
    by_digest = {hashlib.sha256(t).digest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_digest[bytes(r["digest"])]
        assert r["doc_id"] in ids and r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
        kept[bytes(r["digest"])] += r["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_dedup(spark):
    df = awkward_docs(spark)
    out = exact.dedup(df)
    assert out.columns == df.columns
    texts = [norm(r["text"]) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r["text"]) for r in df.collect()})
    assert exact.dedup(empty(df)).count() == 0 == exact.mark(empty(df)).count()

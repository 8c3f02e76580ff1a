from collections import Counter

import corpus_pipeline
from helpers import awkward_docs
from test_toxicity import corpus

from tidemark.llm import common


def test_stages(spark, tmp_path):
    rows = corpus(400)
    docs = [(i, t, "en", f"s{i % 4}", len(t)) for i, t, _, _ in rows]
    docs += [(1000 + k, docs[k][1].upper(), "en", "s9", 1) for k in range(20)] + [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame, seen = common.table(spark, str(tmp_path), "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        frame = common.materialize(stage(spark, frame, str(tmp_path)), name)
        seen.append(frame)
    toxic, exact, near, mixed, packed = seen
    bad = {i for i, _, _, x in rows if x}
    left = {r["doc_id"] for r in toxic.collect()}
    assert len(left & bad) <= 0.1 * len(bad) and len({r[0] for r in docs} - bad - left) <= 12
    texts = Counter((r["text"] or "").lower() for r in exact.collect())
    assert set(texts.values()) == {1} and texts.keys() == {(r["text"] or "").lower() for r in toxic.collect()}
    assert {r["doc_id"] for r in near.collect()} <= {r["doc_id"] for r in exact.collect()}
    assert max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    for f in seen[:-1]:
        assert f.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sum(r["n_tokens"] for r in packed.collect()) == sum(len((r["text"] or "").split()) for r in mixed.collect())
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, packed.collect()))


def test_awkward_tables(spark, tmp_path):
    """Nulls, repeats, clashing columns and long texts pass; empty tables give empty results."""
    docs = awkward_docs(spark)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    for part, labels in (("a", [(1, 1, 0), (2, 0, 1), (None, 1, 1)]), ("b", [(1, 1, 0)]), ("c", [])):
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{part}/labels.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    docs.write.parquet(f"{tmp_path}/c/documents.parquet")
    packed = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert packed and {"doc_id", "bin_id", "n_tokens"} <= set(packed[0].asDict())
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
    kept = corpus_pipeline.drop_toxic(spark, common.table(spark, f"{tmp_path}/c", "documents"), f"{tmp_path}/c")
    assert kept.count() == docs.count() and kept.columns == docs.columns  # without labels nothing is toxic

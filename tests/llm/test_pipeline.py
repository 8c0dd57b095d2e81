"""Each stage on what the one before it left, against what brute force keeps."""

from test_text_ops import components_of

import corpus_pipeline
from planar_spark.llm.common import written

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, labels = docs.columns, {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, D), name)
        kept[name] = before, docs.collect()
        assert docs.columns == columns or name == "sentencepiece"
    before, after = kept["toxicity"]
    left = {r["doc_id"] for r in after}
    clean = [r["doc_id"] for r in before if labels.get(r["doc_id"]) == 0]
    assert sum(i in left for i in clean) >= 0.95 * len(clean)
    before, after = kept["line_dedup"]
    assert {r["doc_id"] for r in before} == {r["doc_id"] for r in after} and all(len(r["text"]) == r["n_chars"] for r in after)
    before, after = kept["ngram_join"]
    want = components_of([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert {r["doc_id"] for r in after} == {c for _, c in want.values()}
    assert all(r["round_trip"] for r in kept["sentencepiece"][1]) and len(kept["sentencepiece"][1]) == len(kept["mixing"][1])

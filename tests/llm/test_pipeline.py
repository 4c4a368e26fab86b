"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as C
import pytest

from tablemirror.llm.common import documents, written

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


def test_stages(spark):
    docs = documents(spark, SF)
    columns, seen = docs.columns, {}
    for name, stage in C.STAGES[:-1]:
        out, _ = written(stage(spark, docs, SF), "stage")
        assert out.columns == columns, name
        before, after = (Counter(r["doc_id"] for r in d.select("doc_id").collect()) for d in (docs, out))
        assert set(after) <= set(before) and (name == "mix_sources" or max(after.values(), default=0) <= 1)
        seen[name], docs = after, out
    assert set(seen["mix_sources"]) == set(seen["near_dedup"])
    assert max(seen["mix_sources"].values()) <= 3
    result = C.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in result) == seen["mix_sources"]
    assert [n for n, _ in C.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix_sources", "encode"]
    # the removed ones are toxic, equal or alike
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rejected = {r["doc_id"] for r in documents(spark, SF, "doc_id").collect()} - set(seen["toxicity"])
    assert all(labels.get(i) != 0 for i in rejected)

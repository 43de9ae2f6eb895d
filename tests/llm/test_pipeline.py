"""The pipeline's stages, each against brute force over its own input."""

import os
import re

import corpus_pipeline
from test_operators import base_spans, brute_components, brute_print, check_packing

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            kept = {r["doc_id"] for r in after}
            clean = [r["doc_id"] for r in before if marks.get(r["doc_id"]) == 0]
            assert sum(d in kept for d in clean) >= 0.97 * len(clean)
        elif name == "simhash_dedup":
            prints = {r["doc_id"]: brute_print(r["text"]) for r in before}
            ids = sorted(prints)
            root = brute_components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3])
            assert sorted(r["doc_id"] for r in after) == sorted(set(root.values()))
        elif name == "pii":
            assert len(after) == len(before) and not any(base_spans(r["text"]) for r in after)
            assert any("<EMAIL>" in r["text"] for r in after) and all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "mixing":
            words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in before)
            taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in after)
            assert abs(taken - words) <= 0.05 * words
        else:
            check_packing(after, [(r["doc_id"], r["text"]) for r in before])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0

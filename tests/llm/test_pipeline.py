"""The stages, each held against what its operator does alone."""

import corpus_pipeline
from test_lines import plain_dedup
from test_near_dup import plain_components, plain_sets
from test_tokens import check_sequences

from nudgeline.llm import quality
from nudgeline.llm.common import documents


def test_stages_one_after_the_other(spark, small, tmp_path):
    docs = documents(spark, small)
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    raw = documents(spark, small)
    model = quality.train(raw, spark.read.parquet(f"{small}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(raw, model).collect() if r["kept"]}
    assert {r["doc_id"] for r in kept["quality"]} == good
    lines = plain_dedup([(r["doc_id"], r["text"]) for r in kept["quality"]])
    assert {r["doc_id"]: r["text"] for r in kept["line_dedup"]} == {i: t for i, (_, _, t) in lines.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"])
    groups = plain_components(plain_sets([(r["doc_id"], r["text"]) for r in kept["line_dedup"]]))
    assert {r["doc_id"] for r in kept["near_dup"]} == set(groups.values())
    texts = {r["doc_id"]: r["text"] for r in kept["near_dup"]}
    copies = {}
    for r in kept["mixing"]:
        assert r["text"] == texts[r["doc_id"]]
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3
    firsts = {}
    for r in kept["packing"]:
        if r["piece"] == 0:
            firsts[r["doc_id"]] = firsts.get(r["doc_id"], 0) + 1
    assert firsts == copies
    check_sequences(kept["packing"], 2048)


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0

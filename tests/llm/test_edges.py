"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import fixtures
import pytest

from nudgeline.llm import (
    fingerprints,
    license_scan,
    line_dedup,
    mixing,
    near_dup,
    packing,
    quality,
    sharding,
    token_counts,
    token_files,
)

PER_ROW = {
    "line_dedup": lambda d: line_dedup.dedup_lines(d),
    "near_dup": lambda d: near_dup.find(d),
    "token_files": lambda d: token_files.round_trip(d, 2),
    "mixing": lambda d: mixing.mix(d),
    "token_counts": lambda d: token_counts.count_tokens(d),
    "sharding": lambda d: sharding.shuffle(d),
    "fingerprint": lambda d: fingerprints.fingerprint(d),
    "edited": lambda d: fingerprints.edited(d, n_parts=3),
    "license_scan": lambda d: license_scan.scan(d),
    "quality": lambda d: quality.score(d, None),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_result_per_row(spark, name):
    rows = fixtures.with_repeats()
    found = PER_ROW[name](fixtures.documents(spark, rows)).collect()
    ids = sorted((r["doc_id"] for r in found), key=lambda i: (i is not None, i))
    assert ids == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))


@pytest.mark.parametrize("name", [*PER_ROW, "packing"])
def test_empty_table(spark, name):
    run = PER_ROW.get(name) or (lambda d: packing.pack_documents(d))
    assert run(fixtures.documents(spark, [])).collect() == []


def test_packing_with_repeats(spark):
    rows = fixtures.with_repeats()
    found = packing.pack_documents(fixtures.documents(spark, rows)).collect()
    assert sum(r["piece"] == 0 for r in found) == len(rows)


def test_other_columns_pass_through(spark):
    docs = fixtures.documents(spark)
    want = {r["doc_id"]: (r["lang"], r["rank"]) for r in docs.collect()}
    for made in (line_dedup.dedup_lines(docs), mixing.mix(docs), sharding.shuffle(docs)):
        assert {r["doc_id"]: (r["lang"], r["rank"]) for r in made.collect()} == want
        assert len({c.lower() for c in made.columns}) == len(made.columns)


def test_nulls_and_empty_texts(spark):
    docs = fixtures.documents(spark)
    lines = fixtures.by_id(line_dedup.dedup_lines(docs))
    assert (lines[1]["n_lines"], lines[1]["n_dropped"], lines[1]["text"]) == (1, 0, "")
    near = fixtures.by_id(near_dup.find(docs))
    assert (near[1]["n_shingles"], near[1]["component_id"], near[1]["kept"]) == (0, 1, True)
    assert near[13]["component_id"] == near[16]["component_id"] == 13  # two words, whatever case
    scored = fixtures.by_id(quality.score(docs, None))
    assert scored[1]["n_words"] == 0 and scored[1]["base_failed"] and not scored[1]["kept"]
    counted = fixtures.by_id(token_counts.count_tokens(docs))
    assert (counted[1]["n_tokens"], counted[1]["score"]) == (0, 0.0)
    mixed = fixtures.by_id(mixing.mix(docs))
    assert mixed[1]["size"] == 0 and mixed[1]["taken"] == 0

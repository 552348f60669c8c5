"""Extra columns called like the ones that operators make for a while, and the contract's types."""

from collections import Counter

import corpus_pipeline
import fixtures
import pytest
from pyspark.sql import functions as F

from nudgeline.llm import line_dedup, mixing, near_dup, quality, queries, sharding
from nudgeline.llm.common import landed

HELPERS = (
    "__keys __doc __key __size __salt __turn __passed __whole __n __source_size __target __copies __copy "
    "__row __gone __id __high __low __identity __number __bucket __start bucket component keys copies taken"
).split()

OPERATORS = {
    "line_dedup": line_dedup.dedup_lines,
    "mixing": mixing.mix,
    "copied": mixing.copied,
    "sharding": sharding.shuffle,
    "near_dup": near_dup.deduplicate,
    "quality": lambda d: quality.keep(d, None),
}
OWN = {"mixing": {"copies", "taken"}}


def with_helpers(docs):
    return docs.select("doc_id", "text", "source", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in HELPERS])


@pytest.mark.parametrize("name", OPERATORS)
def test_helper_names_are_carried_along(spark, name):
    rows = fixtures.with_repeats()
    docs = fixtures.documents(spark, rows).select("doc_id", "text", "source")
    plain = OPERATORS[name](docs)
    made = OPERATORS[name](with_helpers(docs))
    both = [c for c in plain.columns if c not in HELPERS]
    assert Counter(map(str, made.select(both).collect())) == Counter(map(str, plain.select(both).collect()))
    carried = [c for c in HELPERS if c not in OWN.get(name, ())]
    assert set(carried) <= set(made.columns)
    for r in made.collect():
        if r["doc_id"] is not None:
            assert all(r[c] == f"{c}:{r['doc_id']}" for c in carried)


def test_pipeline_takes_every_case(spark, small, tmp_path):
    """Null, empty, repeated and very long rows, clashing columns, no n_chars; and no rows at all."""
    good = fixtures.story(40, 300)
    rows = [*fixtures.with_repeats(), (900, good, "s0", "en", 0, "x", 0), (900, good, "s0", "en", 0, "x", 0)]
    for table in (fixtures.documents(spark, rows), fixtures.documents(spark, [])):
        docs = with_helpers(table)
        full = bool(table.count())
        for name, run in corpus_pipeline.STAGES:
            made = landed(run(spark, docs, small), str(tmp_path / f"{name}-{full}"))
            if name != "packing":
                assert made.columns == docs.columns
                docs = made
        assert bool(made.collect()) == full


def test_equal_rows_are_dealt_to_all_buckets(spark):
    """Half of all rows alike: buckets stay small, slots gapless and shards even."""
    rows = [(7, "the same", "s", "en", 0, "x", 0)] * 3000
    rows += [(i, f"text {i}", "s", "en", 0, "x", 0) for i in range(3000)]
    found = sharding.shuffle(fixtures.documents(spark, rows), bucket_bytes=2000).collect()
    shards = {}
    for r in found:
        shards.setdefault(r["shard"], []).append((r["slot"], r["text"]))
    assert sorted(map(len, shards.values())) == [375] * 16
    for own in shards.values():
        assert sorted(s for s, _ in own) == list(range(375))
        # Buckets of equal rows would fill whole shards.
        assert 100 < sum(t == "the same" for _, t in own) < 275


LONGS = "bigint"
# Those of the later operators are held in their own tests.
TYPES = {
    "op1_line_dedup": {"doc_id": LONGS, "n_lines": LONGS, "n_dropped": LONGS, "kept_sha256": "string"},
    "op2_near_dup": {"doc_id": LONGS, "n_shingles": LONGS, "component_id": LONGS, "kept": "boolean"},
    "op3_token_files": {"doc_id": LONGS, "start": LONGS, "n_tokens": LONGS, "ids_crc32": LONGS},
    "op4_packing": {
        "doc_id": LONGS, "piece": "int", "start": LONGS, "length": LONGS, "ids_crc32": LONGS,
        "sequence_id": LONGS, "offset": LONGS,
    },
    "op5_mixing": {
        "doc_id": LONGS, "size": LONGS, "source_size": LONGS, "target": "double", "taken": LONGS,
    },
    "op7_sharding": {
        "doc_id": LONGS, "size": LONGS, "text_crc32": LONGS, "law": "string", "shard": "int",
        "slot": LONGS, "grown_shard": "int",
    },
    "op8_fingerprints": {
        "doc_id": LONGS, "n_chars": LONGS, "edited_sha256": "string", "fingerprint": "string",
        "edited_fingerprint": "string", "near_edited": "double", "near_next": "double",
    },
    "op9_license_scan": {
        "doc_id": LONGS, "n_words": LONGS, "n_base": LONGS, "first_word": LONGS, "last_word": LONGS,
        "base_labels": "string", "labels": "string", "score": "double",
    },
    "op10_quality": {
        "doc_id": LONGS, "n_words": LONGS, "word_chars": LONGS, "n_symbols": LONGS,
        "n_dup_lines": LONGS, "n_repeat_words": LONGS, "base_failed": "boolean", "kept": "boolean",
    },
}


@pytest.mark.parametrize("name", TYPES)
def test_types_of_the_contract(spark, small, name):
    found = dict(queries.queries()[name](spark, small).dtypes)
    assert {c: found.get(c) for c in TYPES[name]} == TYPES[name]

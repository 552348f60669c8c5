import hashlib

import fixtures
import numpy as np

from nudgeline.llm.fingerprints import Fingerprint, edited, fingerprint, paragraphs


def test_sums_do_not_depend_on_order():
    lines = [f"line {i} of the text, with words".encode() for i in range(40)]
    whole = Fingerprint.of(lines)
    assert str(Fingerprint.of(lines[::-1])) == str(whole)
    assert str(Fingerprint.of(lines[:13]) + Fingerprint.of(lines[13:])) == str(whole)
    assert str(whole - Fingerprint.of(lines[5:9])) == str(Fingerprint.of(lines[:5] + lines[9:]))
    assert str(Fingerprint.parse(str(whole))) == str(whole)
    assert not whole.same(Fingerprint.of(lines + lines[:1]))  # how often counts
    assert whole.like(whole) == 1.0


def test_likeness_follows_shared_phrases():
    rng = np.random.default_rng(1)
    words = [f"w{rng.integers(10**6)} x{rng.integers(10**6)}, " for _ in range(400)]
    base = Fingerprint.of(["".join(words).encode()])
    other = Fingerprint.of(["".join(f"y{w}" for w in words).encode()])
    assert base.like(other) < 0.3
    for share in (0.25, 0.5, 0.9):
        n = int(400 * share)
        mixed = Fingerprint.of(["".join([*words[:n], *(f"z{w}" for w in words[n:])]).encode()])
        assert abs(base.like(mixed) - share) < 0.2


def test_edited_texts(spark):
    rows = [(r[0], r[1]) for r in fixtures.texts()]
    found = fixtures.by_id(edited(fixtures.documents(spark), n_parts=5))
    ordered = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (doc_id, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        n = len(text) // 3
        new = text[: len(text) - n] + after[:n]
        own, changed = Fingerprint.of(paragraphs(text)), Fingerprint.of(paragraphs(new))
        r = found[doc_id]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (str(own), str(changed))
        assert r["near_edited"] == own.like(changed)
        assert r["near_next"] == own.like(Fingerprint.of(paragraphs(after)))
    plain = fixtures.by_id(fingerprint(fixtures.documents(spark)))
    assert {i: r["fingerprint"] for i, r in plain.items()} == {
        i: r["fingerprint"] for i, r in found.items()
    }


def test_single_row_is_its_own_neighbour(spark):
    docs = spark.createDataFrame([(7, "abcdef")], "doc_id BIGINT, text STRING")
    row = edited(docs, n_parts=4).collect()[0]
    assert row["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    assert row["near_next"] == 1.0


def test_many_equal_phrases_do_not_change_a_sign(spark):
    many = "ab.\n" * 40000
    docs = spark.createDataFrame([(7, many), (3, "xy")], "doc_id BIGINT, text STRING")
    found = fixtures.by_id(edited(docs, n_parts=2))
    assert found[7]["near_edited"] > 0.99
    whole = Fingerprint.of(paragraphs(many))
    assert np.abs(Fingerprint.parse(str(whole)).likeness.astype(np.int32)).max() == 40000
    half = Fingerprint.of(paragraphs(many[: len(many) // 2]))
    assert whole.like(half) > 0.99
    assert (whole - half).like(half) > 0.99

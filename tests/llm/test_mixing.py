import random

import fixtures
import pytest

from nudgeline.llm import mixing


def plain_targets(sizes):
    names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[n] for n in full)
        rest = sum(weight[n] for n in names if n not in full)
        level = left / rest if rest else 0
        over = {n for n in names if n not in full and weight[n] * level > 3 * sizes[n]}
        if not over:
            return {n: 3 * sizes[n] if n in full else weight[n] * level for n in names}
        full |= over


def make(spark, sizes):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING").repartition(5)


def test_sources_meet_their_targets(spark):
    rng = random.Random(2)
    sizes = [("hot", int(rng.lognormvariate(4, 1))) for _ in range(900)]
    for s in ("a", "b", "c", "é", None, "z"):
        sizes += [(s, int(rng.lognormvariate(4, 1))) for _ in range(150)]
    sizes += [("tiny", 30)] * 4
    docs = make(spark, sizes)
    found = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(2)).collect()
    key = lambda r: r["doc_id"]
    assert sorted(found, key=key) == sorted(again, key=key)
    total = {}
    for s, n in sizes:
        total[s] = total.get(s, 0) + n
    want = plain_targets(total)
    taken = dict.fromkeys(total, 0)
    for r in found:
        assert r["source_size"] == total[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert want["tiny"] == 360 and taken["tiny"] == 360  # full: three copies of everything
    for s in total:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 5)


def test_rates_are_tilted_exponentially(spark, tmp_path):
    """The solved tilts meet the constraint, also next to the bounds."""
    rng = random.Random(3)
    classes = [("a", n, 1 + n % 3) for n in range(1, 200)] + [("b", n, 2) for n in range(1, 90)]
    table = spark.createDataFrame(classes, "key STRING, size BIGINT, n BIGINT")
    for share in (0.02, 0.4, 1.0, 2.3, 2.97, 3.0):
        rows = []
        for key in "ab":
            own = [(s, n) for k, s, n in classes if k == key]
            size, count = sum(s * n for s, n in own), sum(n for _, n in own)
            rows.append((key, size, size / count, share * size))
        sources = spark.createDataFrame(rows, "key STRING, source_size BIGINT, mean DOUBLE, target DOUBLE")
        solved = mixing.tilts(table, sources, 3, str(tmp_path / f"{share}-{rng.random()}"))
        for r in solved.collect():
            import math

            own = [(s, n) for k, s, n in classes if k == r["key"]]
            got = sum(s * n * min(3, math.exp(min(700, r["tilt"] * s / r["mean"]))) for s, n in own)
            assert got == pytest.approx(r["target"], rel=1e-4)


def test_copies_repeat_whole_rows(spark):
    docs = fixtures.documents(spark)
    mixed = fixtures.by_id(mixing.mix(docs))
    counts = {}
    for r in mixing.copied(docs).collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert counts == {i: r["copies"] for i, r in mixed.items() if r["copies"]}
    assert mixing.copied(docs).columns == docs.columns


def test_no_words_at_all(spark):
    docs = make(spark, [("a", 0), (None, 0)])
    assert [(r["target"], r["taken"]) for r in mixing.mix(docs).collect()] == [(0.0, 0)] * 2

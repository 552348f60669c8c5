import random

import fixtures
import numpy as np

from nudgeline.llm import near_dup


def plain_sets(rows):
    out = {}
    for doc_id, text in rows:
        words = fixtures.WORD.findall((text or "").translate(fixtures.LOWER))
        n = max(1, len(words) - 4) if words else 0
        out[doc_id] = {tuple(words[i : i + 5]) for i in range(n)}
    return out


def plain_components(sets):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def family(seed, n_copies, n_words, n_changes):
    """Copies of one text with some words changed, some of them only linked through others."""
    rng = random.Random(seed)
    base = [f"f{seed}x{rng.randrange(10**6)}" for _ in range(n_words)]
    out = [" ".join(base)]
    for _ in range(n_copies):
        words = list(base)
        for _ in range(rng.randrange(1, n_changes)):
            words[rng.randrange(n_words)] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_against_plain_version(spark):
    rows = [(r[0], r[1]) for r in fixtures.texts()]
    made = [family(1, 30, 120, 4), family(2, 12, 300, 14), family(3, 25, 40, 3), family(4, 6, 7, 2)]
    rows += [(1000 + i, t) for i, t in enumerate(t for texts in made for t in texts)]
    # A chain: neighbours are near, its ends are not.
    words = [f"c{i}" for i in range(100)]
    for i in range(8):
        words[i * 12 : i * 12 + 2] = [f"d{i}", f"e{i}"]
        rows.append((2000 + i, " ".join(words)))
    random.Random(5).shuffle(rows)
    sets = plain_sets(rows)
    want = plain_components(sets)
    assert len(set(want.values())) < len(want) - 40
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(4)
    found = fixtures.by_id(near_dup.find(docs))
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert {i: r["n_shingles"] for i, r in found.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (r["component_id"] == i) for i, r in found.items())
    left = near_dup.deduplicate(docs)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(want.values()))


def test_rows_that_share_an_id_go_each_by_its_own_text(spark):
    one, near, *_ = family(21, 1, 90, 2)
    two, three = family(22, 0, 80, 2)[0], family(23, 0, 70, 2)[0]
    four, close, *_ = family(24, 1, 90, 2)
    other = family(25, 0, 60, 2)[0]
    rows = [(1, one), (5, near), (5, two), (7, three), (7, three), (7, three.upper())]
    rows += [(9, four), (9, close), (9, other), (10, close), (11, ""), (11, None), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    left = near_dup.deduplicate(docs)
    assert left.columns == ["doc_id", "text"]
    found = [(r["doc_id"], r["text"]) for r in left.collect()]
    kept = [(i, t) for i, t in found if i not in (7, 9)]
    want = [(1, one), (5, two), (11, ""), (11, None), (None, one)]
    assert sorted(map(str, kept)) == sorted(map(str, want))
    assert [t.lower() for i, t in found if i == 7] == [three]
    nine = [t for i, t in found if i == 9]
    assert len(nine) == 2 and other in nine and {four, close} & set(nine)


def test_many_members_that_only_meet_through_others(spark):
    """Every copy is near the base alone, and the base is not the smallest id."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(40), 1):
            words[at * 5 : at * 5 + 5] = [f"n{i}x{k}" for k in range(5)]
        for at in rng.sample(range(40), 2):
            words[at * 5 + 2] = f"m{i}x{at}"
        rows.append((i, " ".join(words)))
    rows.append((500, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    want = plain_components(plain_sets(rows))
    assert {i: r["component_id"] for i, r in fixtures.by_id(near_dup.find(docs)).items()} == want


def test_blocks_of_a_canopy(spark, monkeypatch):
    """Families far larger than a block, whose members are partly near each other."""
    monkeypatch.setattr(near_dup, "BLOCK", 6)
    rows = [(i, t) for i, t in enumerate(t for s in (11, 12) for t in family(s, 40, 150, 12))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    want = plain_components(plain_sets(rows))
    assert 2 < len(set(want.values())) < len(rows)
    assert {i: r["component_id"] for i, r in fixtures.by_id(near_dup.find(docs)).items()} == want


def test_near_pairs_join_what_is_near():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    sets = []
    for i in range(30):
        own = base.copy()
        own[rng.choice(60, rng.integers(0, 9), replace=False)] = rng.integers(1 << 62, 1 << 63)
        sets.append(np.unique(own))
    component = np.arange(30)
    every = np.ones(30, bool)
    found = near_dup._near_pairs(sets, component, every, every, 75)
    root = list(range(30))
    for x, y in found:
        a, b = set(sets[x].tolist()), set(sets[y].tolist())
        assert 100 * len(a & b) >= 75 * len(a | b)
        old, new = root[y], root[x]
        root = [new if r == old else r for r in root]
    plain = plain_components({i: set(s.tolist()) for i, s in enumerate(sets)})
    assert {(plain[i] == plain[j]) == (root[i] == root[j]) for i in range(30) for j in range(30)} == {True}
    assert len(found) == 30 - len(set(plain.values()))


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(3)
    for n, share in ((2000, 0.75), (300, 0.9), (12, 0.5), (1, 1.0)):
        errors = []
        for _ in range(20):
            pool = rng.integers(0, 1 << 64, 3 * n, dtype=np.uint64)
            both = round(2 * n * share / (1 + share))
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            true = both / (2 * n - both)
            size = np.array([n])
            found = near_dup.estimate(
                near_dup.sketch(a)[None], near_dup.sketch(b)[None], size, size
            )[0]
            errors.append(found - true)
        assert abs(np.mean(errors)) < 0.03


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(4)
    for n in (4, 40, 700):
        missed = 0
        for _ in range(60):
            pool = rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64)
            both = -(-6 * n // 7)  # at least 0.75 of the union
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            x, y = near_dup.sketch(a).view("<u8"), near_dup.sketch(b).view("<u8")
            missed += not (x == y).any()
        assert not missed

"""Vector codes against a plain version of the rounds in Python's own integers."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from nudgeline.llm import vector_codes
from nudgeline.llm.queries import op12_vector_codes

SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, n INT, code STRING, parts STRING, label_error STRING"


def _far(p, e):
    return sum((x - y) ** 2 for x, y in zip(p, e))


def _best(p, book):
    return min(range(len(book)), key=lambda i: (_far(p, book[i]), i))


def plain(rows, n_parts=8, n_entries=16, rounds=6):
    """(id, vector, label) rows; the result rows as a bag."""
    kept = [
        (i, [math.floor(4096 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return Counter()
    size = len(kept[0][1]) // n_parts
    cut = [[v[k * size : (k + 1) * size] for k in range(n_parts)] for _, v, _ in kept]
    packed = [np.array(v, "<i4").tobytes() for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, packed[i]))
    books = [[cut[i][k] for i in order[:n_entries]] for k in range(n_parts)]
    for _ in range(rounds):
        for k, book in enumerate(books):
            own = [[] for _ in book]
            for parts in cut:
                own[_best(parts[k], book)].append(parts[k])
            books[k] = [
                [sum(column) // len(m) for column in zip(*m)] if m else e for e, m in zip(book, own)
            ]
    spelled = ",".join(str(x) for book in books for e in book for x in e)
    digest = hashlib.sha256(spelled.encode()).hexdigest()
    found = []
    for (i, _, label), parts in zip(kept, cut):
        at = [_best(p, b) for p, b in zip(parts, books)]
        error = sum(_far(p, b[a]) for p, b, a in zip(parts, books, at))
        found.append((i, label, "".join(f"{a:02x}" for a in at), error))
    by_label = Counter()
    for _, label, _, error in found:
        by_label[label] += error
    return Counter((i, code, error, by_label[label], digest) for i, label, code, error in found)


def _bag(frame):
    names = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return Counter(tuple(r[n] for n in names) for r in frame.collect())


def _rows(n=400, width=16, spread=1.0, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(20, width))
    out = []
    for i in range(n):
        v = (spread * (centres[i % 20] + 0.3 * draw.normal(size=width))).astype(np.float32).tolist()
        out.append((i * 3 - 40, v, None if i % 9 == 4 else i % 5))
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("spread", [0.2, 1.0, 1000.0, 10_000.0])
def test_same_as_plain(spark, spread):
    rows = _rows(spread=spread)
    assert _bag(vector_codes.compress(_frame(spark, rows))) == plain(rows)


def test_awkward_rows(spark):
    rows = _rows(120)
    same = rows[7][1]
    rows += [(1000 + i, same, 1) for i in range(300)]  # one very common vector
    rows += [rows[3], rows[3], (None, rows[5][1], None), (None, rows[6][1], 2), (-40, rows[50][1], 0)]
    nan, inf = float("nan"), float("inf")
    rows += [(1, None, 1), (2, [None] + same[1:], 1), (3, [nan] + same[1:], 1), (4, [-inf] + same[1:], 1)]
    frame = _frame(spark, rows)
    want = plain(rows)
    assert sum(want.values()) == len(rows) - 4
    assert _bag(vector_codes.compress(frame)) == want
    # Many salts, and labels joined by a shuffle.
    assert _bag(vector_codes.compress(frame, members_per_owner=7, ship_labels=0)) == want


def test_few_none_and_empty(spark):
    rows = _rows(5)
    assert _bag(vector_codes.compress(_frame(spark, rows))) == plain(rows)
    assert _bag(vector_codes.compress(_frame(spark, []))) == Counter()
    assert _bag(vector_codes.compress(_frame(spark, [(1, None, 2)]))) == Counter()
    found = vector_codes.compress(_frame(spark, [(1, [], 2), (2, [], 2)])).collect()
    assert {(r["vec_id"], r["code"], r["error"]) for r in found} == {(1, "00" * 8, 0), (2, "00" * 8, 0)}


def test_uneven_vectors_are_an_error(spark):
    with pytest.raises(Exception, match="multiple of 8"):
        vector_codes.compress(_frame(spark, [(1, [1.0] * 16, 1), (2, [1.0] * 8, 1)])).collect()


def test_blocks_are_bounded_and_keep_their_sums():
    blocks = vector_codes._Blocks(3)
    parts = np.arange(100_000, dtype=np.int64).reshape(-1, 2)
    blocks.add(0, (parts[:, 0] % 4 == 0).astype(int), parts)
    rows = blocks.rest()
    assert max(r[3] for r in rows) <= vector_codes.BLOCK
    assert sum(r[3] for r in rows) == len(parts)
    assert np.sum([r[4] for r in rows], axis=0).tolist() == parts.sum(axis=0).tolist()
    assert {r[2] for r in rows} == {0, 1, 2}


def test_query_on_a_whole_table(spark, small):
    found = op12_vector_codes(spark, small)
    longs = ("vec_id", "error", "label_error")
    assert dict(found.dtypes) == {"code": "string", "codebooks_sha256": "string"} | {c: "bigint" for c in longs}
    table = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    assert _bag(found) == plain([(r["vec_id"], r["embedding"], r["label"]) for r in table])

"""Cross-tokenizer alignment against a plain version, token by token."""

import hashlib
import random
from collections import Counter

import fixtures
import numpy as np
import pytest

from nudgeline.llm import cross_tokens
from nudgeline.llm.queries import op11_cross_tokens

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _spans(ids, side):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(side.spelled[i])))
        at += len(side.spelled[i])
    return out


def plain(rows):
    """(id, text) rows in any order; one tuple of the result columns for each."""
    a, b = cross_tokens.sides()
    found = []
    for _, text in rows:
        ids_a = a.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.model.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or any(b"".join(s.spelled[i] for i in ids) != want for s, ids in ((a, ids_a), (b, ids_b))):
            found.append(([], [], [], []))
            continue
        left, right = _spans(ids_a, a), _spans(ids_b, b)
        links, j = [], 0
        for i, s, e in left:
            while right[j][2] <= s:
                j += 1
            k = j
            while k < len(right) and right[k][1] < e:
                links.append((i, right[k][0]))
                k += 1
        cuts = sorted({e for *_, e in left} & {e for *_, e in right})
        groups, i, j = [], 0, 0
        for cut in cuts:
            own, other = [], []
            while i < len(left) and left[i][2] <= cut:
                own.append(left[i][0])
                i += 1
            while j < len(right) and right[j][2] <= cut:
                other.append(right[j][0])
                j += 1
            groups.append((own, other))
        found.append((left, right, groups, links))
    counts = Counter(pair for *_, links in found for pair in links)
    top = {}
    for (_, right), n in counts.items():
        top[right] = max(top.get(right, 0), n)
    out = []
    for left, right, groups, links in found:
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                len(left),
                len(right),
                len(groups),
                len(links),
                sum(counts[p] == top[p[1]] for p in links),
                sum(counts[p] for p in links),
                hashlib.sha256(spelled.encode()).hexdigest() if spelled else "",
            )
        )
    return out


def _as_bag(rows):
    return Counter(rows)


@pytest.mark.parametrize("ship", [1_000_000, 10])
def test_same_as_plain(spark, ship):
    rows = fixtures.with_repeats()
    extra = ["<|endoftext|> <s> <unk> <0x41> x", "a▁b", "▁", " lead", "tail \n\n", "\x00\x01", "𝒳 🤖 ﬁ", "Ω≈ç√ ҂"]
    rows += [(500 + i, t, "s", "en", 0, "x", 0) for i, t in enumerate(extra)]
    found = cross_tokens.align(fixtures.documents(spark, rows), ship_pairs=ship).collect()
    want = plain([(r[0], r[1]) for r in rows])
    assert _as_bag((r["doc_id"], *(r[c] for c in COLUMNS)) for r in found) == _as_bag(
        (r[0], *w) for r, w in zip(rows, want)
    )
    by_id = fixtures.by_id(cross_tokens.align(fixtures.documents(spark, rows)))
    assert tuple(by_id[501][c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "")
    assert by_id[500]["n_a"] > 5


def test_query_on_a_whole_table(spark, small):
    found = op11_cross_tokens(spark, small)
    kinds = dict(found.dtypes)
    assert kinds == {"doc_id": "bigint", "groups_sha256": "string"} | {c: "bigint" for c in COLUMNS[:-1]}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert _as_bag(tuple(r[c] for c in COLUMNS) for r in found.collect()) == _as_bag(plain(docs))


def test_pointers_reach_the_last_token_of_their_group():
    draw = random.Random(5)
    for _ in range(300):
        n = draw.randint(1, 60)
        ends_a = sorted({*draw.sample(range(1, n + 1), draw.randint(0, n - 1)), n})
        ends_b = sorted({*draw.sample(range(1, n + 1), draw.randint(0, n - 1)), n})
        last = cross_tokens.last_tokens(np.array(ends_a), np.array(ends_b))
        cuts = sorted(set(ends_a) & set(ends_b))
        want = [ends_a.index(next(c for c in cuts if c >= e)) for e in (*ends_a, *ends_b)]
        assert last.tolist() == want


def test_quick_form_gives_the_same_ids():
    side, _ = cross_tokens.sides()
    draw = random.Random(7)
    odd = " \t\n\r\x0b\x0c\x85\xa0\x1c\x1f'sabt1²½ßéƒ"
    for k in range(3000):
        letters = odd if k % 2 else [chr(c) for c in range(0x250)]
        text = "".join(draw.choice(letters) for _ in range(draw.randint(1, 30)))
        assert side.encode_all([text]) == [side.tokenizer.encode(" " + text, add_special_tokens=False).ids]

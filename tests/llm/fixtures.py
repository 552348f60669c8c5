"""Small documents with every awkward case, and plain versions of the rules."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id BIGINT, text STRING, source STRING, lang STRING, shard INT, size STRING, rank INT"

SHARED = "This line stands in several documents at once"


def story(seed: int, n: int) -> str:
    """Words that repeat seldom; the same seed gives the same text."""
    out, x = [], seed * 7919 + 17
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"w{x % 9973:x}" + ("." if i % 11 == 10 else "") + ("\n" if i % 37 == 36 else ""))
    return " ".join(out)


def texts() -> list[tuple]:
    long = story(1, 400)
    near = long.split(" ")
    near[200] = "changed"
    plain = [
        None,
        "",
        " \n\t\n",
        "one",
        "two words",
        "Two WORDS",
        long,
        long,
        " ".join(near),
        story(2, 30_000),
        f"{SHARED}\nfirst {story(3, 60)}",
        f"  {SHARED.upper()}\t\nsecond {story(4, 60)}\n\n",
        f"{SHARED}\n{SHARED}\nthird {story(5, 60)}",
        "Réleased under the MIT License. Released under the MIT License.",
        "This work is licensed under the very GNU General Public License, version 3.",
        "漢字 かな é ß ǅ İ <|endoftext|> it's ½ x　y",
        "## ** || " + "same same same " * 40,
        story(6, 80) + "\r\n" + story(7, 80),
        *[story(100 + i, 70 + 3 * i) for i in range(12)],
    ]
    rows = []
    for i, text in enumerate(plain):
        source = None if i % 7 == 3 else f"s{i % 4}"
        rows.append((i * 3 + 1, text, source, "en", i, "x", -i))
    return rows


def documents(spark, rows=None):
    """The documents; their extra columns are named like columns that operators make."""
    return spark.createDataFrame(texts() if rows is None else rows, SCHEMA).repartition(3)


def with_repeats() -> list[tuple]:
    """A repeated row, and rows without an id."""
    rows = texts()
    return [*rows, rows[6], (None, rows[6][1], "s1", None, 0, None, 0), (None, None, None, None, 0, None, 0)]


def by_id(frame) -> dict:
    return {r["doc_id"]: r for r in frame.collect()}

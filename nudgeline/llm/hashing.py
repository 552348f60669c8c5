"""64-bit hashes of words and of word windows, worked out a text at a time."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import on_change

KEPT_WORDS = 200_000
_known: dict[bytes, bytes] = {}


@on_change
def _forget() -> None:
    global _known
    _known = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes of words; those of words met before come from a table of bounded size."""
    global _known
    if len(_known) > KEPT_WORDS:
        _known = {}
    known = _known
    found = list(map(known.get, words))
    try:
        data = b"".join(found)
    except TypeError:  # some are new
        for i, h in enumerate(found):
            if h is None:
                found[i] = known[words[i]] = xxhash.xxh3_64_digest(words[i])
        data = b"".join(found)
    return np.frombuffer(data, ">u8").astype(np.uint64)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; none for a shorter text."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[i : i + n]
    return mixed(out ^ np.uint64(width))

"""Finds personal data in whole texts: mail addresses, network addresses, card and phone numbers.

**Rules.** Each kind has a pattern and a check (``base_spans``). Patterns are worked so that a text of
any length and content takes time in proportion to it: no pattern starts anew inside a run that it has
already read.

**Learned spans.** A character-level bidirectional LSTM with CRF transitions (``char_tagger``) adds spans
that the rules miss: card-shaped numbers with a wrong check digit, phone numbers without a leading plus,
addresses that are written out. It is trained on labelled spans: windows of a bounded sample of documents
(``n_documents`` by a hash of the id, at most ``WINDOWS_EACH`` windows each) that carry the rules' own
spans, and the same windows with spans of known kind, and numbers that are none, set into them.

Every text is covered by windows of ``WIDTH`` characters, each starting half a window after the one
before, whatever the text's length. A window without a digit or an at sign (also a written one, as
``(at)``) cannot hold a span, as every added span must have one; so it is not scored, which changes no
result. Each window is decoded for
itself; then the spans of all windows of a text are reconciled: pieces of one kind that a window's edge
cut are joined with those that continue them, and of spans that overlap the one farther from its
window's edge stays. Added spans must have the digits of their kind and overlap no span of the
rules, which all stay.

Scoring is a narrow step over Arrow batches cut to 8 MB of text; the weights (some 100 KB) travel with it.

Defined cases: null counts as empty, with no spans and the digest of nothing; repeated rows and rows
without an id each give their result; an empty table gives none and trains on made-up words alone; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import char_tagger
from .common import batches_by_bytes, task

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

WIDTH = 128
STRIDE = WIDTH // 2
# Windows scored at once.
BLOCK = 256
# Bounds of the training sample.
N_DOCUMENTS, WINDOWS_EACH = 600, 4

SPANS = (
    "doc_id BIGINT, n_email BIGINT, n_ip BIGINT, n_card BIGINT, n_phone BIGINT, "
    "base_sha256 STRING, spans STRING"
)

Span = tuple[int, int, int]  # kind, start, end

# Every span holds one of these.
_ANCHOR = re.compile(r"[0-9@]+|[(\[]at[)\]]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(text: str) -> int:
    return sum("0" <= c <= "9" for c in text)


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = int(c) << (place & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """An at sign is in neither side's letters, so the leftmost match of each is the whole run before
    it, as far as the match before leaves it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        free = match.end() if match else at + 1
        if match:
            yield EMAIL, start, free
        at = text.find("@", free)


def _addresses(text: str) -> Iterator[Span]:
    """Numbers in a dotted row are taken four at a time."""
    for row in _DOTTED.finditer(text):
        if row[0].count(".") < 3:
            continue
        parts = row[0].split(".")
        start = row.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield IP, start, end
            start = end + 1


def _cards(text: str) -> Iterator[Span]:
    for match in _NUMBER.finditer(text):
        if match.end() - match.start() < 16:
            continue
        digits = match[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield CARD, match.start(), match.end()


def _phones(text: str) -> Iterator[Span]:
    for match in _PHONE.finditer(text):
        if 8 <= _digits(match[0]) <= 15:
            yield PHONE, match.start(), match.end()


def base_spans(text: str) -> list[Span]:
    """Spans of the rules by kind, then start."""
    if not _ANCHOR.search(text):
        return []
    return [span for find in (_emails, _addresses, _cards, _phones) for span in find(text)]


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


# --- training -------------------------------------------------------------------------------------


def _picked_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows around the first spans of a text, and from its beginning, middle and end."""
    for batch in batches_by_bytes(batches, "text"):
        out = []
        for text in batch.column("text").to_pylist():
            text = text or ""
            places = [max(0, s - STRIDE) for _, s, _ in base_spans(text)[:WINDOWS_EACH]]
            if not places:
                places = sorted({0, max(0, len(text) // 2 - STRIDE), max(0, len(text) - WIDTH)})
            out += [text[p : p + WIDTH] for p in places]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["text"])


def sample_windows(docs: DataFrame, n_documents: int = N_DOCUMENTS) -> list[str]:
    """At most ``n_documents`` times ``WINDOWS_EACH`` windows of documents drawn by a hash of their id."""
    numbered = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    draw = F.xxhash64("doc_id")
    drawn = numbered.select("doc_id").distinct().orderBy(draw, "doc_id").limit(n_documents)
    # Rows that share a drawn id are one document here.
    chosen = numbered.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    return sorted(r["text"] for r in chosen.select("text").mapInArrow(task(__name__, _picked_windows), "text STRING").collect())


class _Maker:
    """Made-up spans of each kind, and numbers that are none."""

    def __init__(self, seed: int):
        self.draw = np.random.default_rng(seed)

    def number(self, n: int) -> str:
        return "".join(map(str, self.draw.integers(0, 10, n)))

    def word(self, low: int = 2, high: int = 9) -> str:
        letters = self.draw.integers(97, 123, self.draw.integers(low, high))
        return "".join(map(chr, letters))

    def one_of(self, *options):
        return options[self.draw.integers(0, len(options))]

    def email(self) -> str:
        local = self.one_of(self.word(), f"{self.word()}.{self.word()}", f"{self.word()}.{self.number(2)}")
        host = self.one_of(self.word(), f"{self.word()}{self.number(1)}.{self.word()}", f"{self.word()}-{self.word()}")
        end = self.one_of("com", "org", "net", "de", "fr", "example.com")
        at = self.one_of("@", "@", "@", " (at) ", " [at] ", " @ ")
        dot = self.one_of(".", ".", " dot ", " [dot] ") if at != "@" else "."
        return f"{local}{self.one_of('', self.number(2))}{at}{host}{dot}{end}"

    def ip(self) -> str:
        dot = self.one_of(".", ".", ".", "[.]")
        return dot.join(str(self.draw.integers(1, 256)) for _ in range(4))

    def card(self) -> str:
        n = int(self.one_of(16, 16, 16, 16, 16, 17, 18, 19))
        digits = self.number(n)
        gap = self.one_of("", "", "", "", " ", " ", "-", ".")
        return gap.join(digits[i : i + 4] for i in range(0, n, 4))

    def phone(self) -> str:
        a, b, c = self.number(3), self.number(3), self.number(4)
        return self.one_of(
            f"+{self.number(1)} ({a}) {b}-{c}",
            f"+{self.number(2)} {a} {b}{c}",
            f"({a}) {b}-{c}",
            f"{a}-{b}-{c}",
            f"{a}.{b}.{c}",
            f"00{self.number(2)} {a} {b}{c}",
            f"{self.number(1)}-{a}-{b}-{c}",
        )

    def none(self) -> str:
        n, d = self.number, self.draw.integers
        return self.one_of(
            n(4),
            n(d(1, 12)),
            f"{d(1900, 2030)}-{d(1, 13):02d}-{d(1, 29):02d}",
            f"{d(1, 29)}.{d(1, 13)}.{d(1900, 2030)}",
            f"{d(0, 24):02d}:{d(0, 60):02d}:{d(0, 60):02d}",
            f"{n(2)},{n(3)}.{n(2)}",
            f"{n(1)}.{n(1)}.{n(1)}",
            f"v{n(1)}.{n(2)}",
            f"{n(d(1, 3))} + {n(d(1, 3))} = {n(d(1, 4))}",
            f"@{self.word()}",
            f"{n(1)} @ {n(2)}",
            f"({n(d(1, 4))})",
            f"{n(2)}%",
            f"${n(3)}",
            f"{self.word()}{n(2)}",
            f"{self.word()}_{n(4)}{self.word()}{n(3)}{self.word()}",
            f"{n(3)}-{n(1)}-{n(2)}-{n(6)}-{n(1)}",
            f"{n(1)}, {n(1)}, {n(2)}, {n(3)}, {n(2)}",
            f"0x{self.draw.bytes(8).hex()}",
            f"{n(4)}/{n(2)}",
        )


def labelled_spans(windows: list[str], n_made: int = 4000, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Texts with all their spans: windows with those of the rules, and the same windows with made
    spans and other numbers set in between their words."""
    out = [(w, base_spans(w)) for w in windows]
    # What a window's edges cut, or what has a number or an at sign besides, has no sure label.
    out = [(w, spans) for w, spans in out if not _ANCHOR.search(_blanked(w, spans))]
    plain = [w for w, spans in out if not spans]
    maker = _Maker(seed)
    makers = (maker.email, maker.ip, maker.card, maker.phone)
    for _ in range(n_made):
        if plain and maker.draw.random() < 0.8:
            ground = plain[maker.draw.integers(0, len(plain))]
        else:
            ground = " ".join(maker.word() for _ in range(15))
        words = ground.split(" ")
        start = int(maker.draw.integers(0, max(1, len(words))))
        text, spans = " ".join(words[:start][-maker.draw.integers(1, 9) :]), []
        for word in words[start : start + int(maker.draw.integers(1, 9))]:
            if maker.draw.random() < 0.35:
                kind = int(maker.draw.integers(0, 7))
                made = makers[kind]() if kind < 4 else maker.none()
                lead = maker.one_of(" ", " ", " ", "\n", " (", ": ", " | ") if text else ""
                text += lead
                for copy in range(2 if maker.draw.random() < 0.08 else 1):
                    text += " " * copy
                    if kind < 4:
                        spans.append((kind, len(text), len(text) + len(made)))
                    text += made
                text += maker.one_of("", "", "", ".", ",", ";", ")")
            text += (" " if text else "") + word
        out.append((text, spans))
    return out


def _blanked(text: str, spans: list[Span]) -> str:
    for _, start, end in spans:
        text = text[:start] + " " * (end - start) + text[end:]
    return text


def tags_of(text: str, spans: list[Span], width: int) -> np.ndarray:
    tags = np.zeros(width, np.int64)
    for kind, start, end in spans:
        tags[start:end] = 2 + 2 * kind
        if start < width:
            tags[start] = 1 + 2 * kind
    return tags


def train(
    examples: list[tuple[str, list[Span]]], steps: int = 400, width: int = 80, seed: int = 1
) -> char_tagger.Tagger:
    """A tagger from labelled texts, on windows of ``width`` characters."""
    windows, tags = [], []
    for text, spans in examples:
        for start in range(0, max(1, len(text) - width // 4), width):
            windows.append(text[start : start + width])
            whole = tags_of(text, spans, max(len(text), start + width))
            tags.append(whole[start : start + width])
    return char_tagger.train(char_tagger.symbols(windows, width), np.array(tags), len(KINDS), steps=steps, seed=seed)


# --- finding --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class _Found:
    kind: int
    start: int
    end: int
    margin: int  # distance to the nearer edge of its window; none counts at an end of the text
    cut_left: bool
    cut_right: bool


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign, plain or written."""
    found: list[int] = []
    for run in _ANCHOR.finditer(text):
        low = max(0, (run.start() - WIDTH) // STRIDE + 1)
        high = (run.end() - 1) // STRIDE
        if found:
            low = max(low, found[-1] // STRIDE + 1)
        found += [k * STRIDE for k in range(low, high + 1)]
    return found


def _runs(tags: np.ndarray) -> list[Span]:
    """Spans of a row of tags."""
    out, start = [], None
    kinds = np.append((tags + 1) // 2 - 1, -1).tolist()
    begins = np.append(tags % 2 == 1, False).tolist()
    for at, kind in enumerate(kinds):
        if start is not None and (begins[at] or kind != kinds[start]):
            out.append((kinds[start], start, at))
            start = None
        if kind >= 0 and start is None:
            start = at
    return out


def _in_window(tags: np.ndarray, start: int, size: int) -> list[_Found]:
    """Spans of one window of a text of ``size`` characters."""
    end = min(start + WIDTH, size)
    found = []
    for kind, s, e in _runs(tags[: end - start]):
        s, e = start + s, start + e
        left = s - start if start else size
        right = end - e if end < size else size
        found.append(_Found(kind, s, e, min(left, right), left == 0, right == 0))
    return found


def reconcile(found: list[_Found]) -> list[Span]:
    """One set of spans from those of overlapping windows."""
    joined: list[_Found] = []
    for one in sorted(found, key=lambda f: (f.kind, f.start, f.end)):
        last = joined[-1] if joined else None
        if last and last.kind == one.kind and one.start < last.end and (last.cut_right or one.cut_left):
            longer = one if one.end >= last.end else last
            margin = max(last.margin, one.margin)
            joined[-1] = _Found(one.kind, last.start, longer.end, margin, last.cut_left, longer.cut_right)
        else:
            joined.append(one)
    kept: dict[int, list[_Found]] = {}  # by stretches of a window's width
    for one in sorted(joined, key=lambda f: (-f.margin, f.start, f.kind)):
        blocks = range(one.start // WIDTH, (one.end - 1) // WIDTH + 1)
        if not any(one.start < f.end and f.start < one.end for b in blocks for f in kept.get(b, ())):
            for b in blocks:
                kept.setdefault(b, []).append(one)
    return sorted({(f.kind, f.start, f.end) for b in kept.values() for f in b})


_EDGES = " \t\n\r\x0b\x0c.,;:|!?"
_DIGIT_RANGE = {IP: (4, 12), CARD: (16, 19), PHONE: (9, 15)}


def _plausible(text: str, span: Span) -> Span | None:
    """The span without marks at its ends, if it has the signs of its kind."""
    kind, start, end = span
    while start < end and text[start] in _EDGES:
        start += 1
    while end > start and text[end - 1] in _EDGES:
        end -= 1
    # A bracket that the span shares with its surroundings.
    lacks = text.count(")", start, end) - text.count("(", start, end)
    if lacks > 0 and text[end - 1] == ")":
        end -= 1
    elif lacks > 0 and start and text[start - 1] == "(":
        start -= 1
    body = text[start:end]
    if not _ANCHOR.search(body):
        return None
    if kind == EMAIL:
        good = len(body) >= 6 and any(sign in body for sign in ("@", "(at)", "[at]"))
        good = good and any(c.isalpha() for c in body)
    else:
        low, high = _DIGIT_RANGE[kind]
        good = low <= _digits(body) <= high and not any(c.isalpha() for c in body)
        # A number goes on neither before nor behind.
        good = good and not (start and text[start - 1].isalnum()) and not text[end : end + 1].isalnum()
        if kind == IP:
            numbers = re.findall("[0-9]+", body)
            good = good and len(numbers) == 4 and all(int(n) <= 255 for n in numbers)
    return (kind, start, end) if good else None


def added_spans(text: str, base: list[Span], found: list[_Found]) -> list[Span]:
    """The tagger's spans that have the signs of their kind and touch no span of the rules."""
    taken: list[list[int]] = []  # stretches that the rules cover
    for start, end in sorted((s, e) for _, s, e in base):
        if taken and start < taken[-1][1]:
            taken[-1][1] = max(end, taken[-1][1])
        else:
            taken.append([start, end])
    starts = [s for s, _ in taken]
    out = []
    for span in reconcile(found):
        span = _plausible(text, span)
        if span is None:
            continue
        before = bisect_left(starts, span[2]) - 1
        if before < 0 or taken[before][1] <= span[1]:
            out.append(span)
    return out


def _scan(model: char_tagger.Tagger | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found: dict[int, list[_Found]] = {}
            places = ((i, s) for i, t in enumerate(texts) if model for s in window_starts(t))
            for block in _blocks(places, BLOCK):
                x = char_tagger.symbols([texts[i][s : s + WIDTH] for i, s in block], WIDTH)
                for (i, s), tags in zip(block, model.decode(x)):
                    if spans := _in_window(tags, s, len(texts[i])):
                        found.setdefault(i, []).extend(spans)
            rows = []
            for i, text in enumerate(texts):
                base = base_spans(text)
                every = base + added_spans(text, base, found.get(i, []))
                counts = [sum(k == kind for k, *_ in base) for kind in range(len(KINDS))]
                digest = hashlib.sha256(spelled(base).encode()).hexdigest()
                rows.append((*counts, digest, spelled(every)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=[c.split(" ")[0] for c in SPANS.split(", ")],
            )

    return run


def _blocks(items: Iterator, size: int) -> Iterator[list]:
    block = []
    for item in items:
        block.append(item)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def find(docs: DataFrame, model: char_tagger.Tagger | None) -> DataFrame:
    """Counts and digest of the rules' spans, and all spans, of every document. Without a model the
    rules stand alone."""
    return docs.select("doc_id", "text").mapInArrow(task(__name__, _scan(model)), SPANS)

"""Quality rules: a hashed n-gram classifier beside plain counts.

A logistic regression over hashed words and hashed character 3-grams (bytes), both as shares of the
text, is fitted to labelled rows and its margins are calibrated on held-out ones, so that the score
is a probability. It is fitted on at most ``max_rows`` labelled documents, drawn by a seeded hash of
the id; every document is then scored as a whole, in Arrow batches, against fixed thresholds.

The sample's features are fitted on the driver while they are small in sum (``fit_limit`` bytes,
checked). Beyond that they stay a table in the shared folder, tasks sum each step's gradient, and the
driver holds the weights and one gradient (1 MB) per task.

The plain counts alone settle ``base_failed``; ``kept`` needs both.

Defined cases: a null or empty text has no words and fails the plain rules; repeated rows are rows
of their own; labelled ids without a document and labels that are null are left out; without labels
of both kinds there is no classifier and the plain rules decide alone; an empty table gives no
rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, landed, task, workspace
from .hashing import window_hashes, word_hashes

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_PROBABILITY = 0.5
MAX_ROWS = 6000
BITS = 16
SLOTS = 1 << BITS
SCALE = 30.0
FIT_LIMIT = 128 << 20
FIT_TASKS = 32

_SCORED = (
    "doc_id BIGINT, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, n_dup_lines BIGINT, "
    "n_repeat_words BIGINT, base_failed BOOLEAN, probability DOUBLE, kept BOOLEAN"
)


@dataclass
class Classifier:
    """Weights per slot: words, then character 3-grams. ``slope`` and ``shift`` calibrate."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500))))


# --- one text --------------------------------------------------------------------------------------

def char_slots(raw: bytes) -> np.ndarray:
    """Slots of all runs of three bytes."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    grams = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    return (grams * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def word_slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.uint32)


def repeated_words(hashes: np.ndarray) -> int:
    """Words that stand in a 3-word window found twice or more."""
    if len(hashes) < 3:
        return 0
    windows = window_hashes(hashes, 3)
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(windows, twice)
    covered = np.zeros(len(hashes), bool)
    for shift in range(3):
        covered[shift : shift + len(again)] |= again
    return int(covered.sum())


def counts(text: str) -> tuple[list[int], np.ndarray, bytes]:
    """Words and the four plain counts; also the word hashes and the bytes."""
    raw = text.encode()
    words = raw.split()
    hashes = word_hashes(words)
    spaces = len(raw) - len(raw.translate(None, SPACE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    plain = [
        len(words),
        len(text) - spaces,
        symbols,
        len(lines) - len(set(lines)),
        repeated_words(hashes),
    ]
    return plain, hashes, raw


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED_PERCENT * n_words


def margin(model: Classifier, hashes: np.ndarray, raw: bytes) -> float:
    total = model.bias
    chars = char_slots(raw)
    if len(hashes):
        total += SCALE * float(model.weights[word_slots(hashes)].sum(dtype=np.float64)) / len(hashes)
    if len(chars):
        total += SCALE * float(model.weights[SLOTS + chars].sum(dtype=np.float64)) / len(chars)
    return total


# --- training --------------------------------------------------------------------------------------


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_by_bytes(batches, "body"):
        rows = []
        for text in batch.column("body").to_pylist():
            _, hashes, raw = counts(text or "")
            slots, values = [], []
            for found, base in ((word_slots(hashes), 0), (char_slots(raw), SLOTS)):
                if len(found):
                    s, n = np.unique(found, return_counts=True)
                    slots.append(s.astype(np.int64) + base)
                    values.append(n * (SCALE / len(found)))
            none = np.zeros(0)
            s = np.concatenate(slots) if slots else none
            v = np.concatenate(values) if values else none
            rows.append((s.astype("<i4").tobytes(), v.astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("good"),
                pa.array([s for s, _ in rows], pa.binary()),
                pa.array([v for _, v in rows], pa.binary()),
            ],
            names=["doc_id", "good", "slots", "shares"],
        )


_CHUNK = 1 << 19


def fit(rows: list[tuple[int, int, bytes, bytes]], steps: int = 150) -> Classifier | None:
    """Logistic regression by Adam on the whole sample; every fifth row only calibrates.

    The sample lies in memory once, in narrow numbers; sums over it are made piece by piece.
    """
    rows = sorted(rows, key=lambda r: r[:2])
    # Rows to learn from first, so that they are one run of entries.
    rows = [r for i, r in enumerate(rows) if i % 5] + rows[::5]
    y = np.array([r[1] for r in rows], np.float64)
    if len(rows) < 10 or y.min() == y.max():
        return None
    n = len(rows) - len(rows[::5])
    sizes = [len(r[2]) // 4 for r in rows]
    index = np.concatenate([np.frombuffer(r[2], "<i4") for r in rows])
    value = np.concatenate([np.frombuffer(r[3], "<f4") for r in rows])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    del rows
    learned = int(sum(sizes[:n]))

    def margins(w: np.ndarray, stop: int, count: int) -> np.ndarray:
        z = np.zeros(count)
        for at in range(0, stop, _CHUNK):
            part = slice(at, min(at + _CHUNK, stop))
            z += np.bincount(owner[part], value[part] * w[index[part]], count)
        return z

    def gradient(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        z = margins(w, learned, n) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[:n]) / n
        g = np.zeros(2 * SLOTS)
        for at in range(0, learned, _CHUNK):
            part = slice(at, min(at + _CHUNK, learned))
            g += np.bincount(index[part], value[part] * error[owner[part]], 2 * SLOTS)
        return g, error.sum()

    w, bias = _descended(gradient, steps)
    z = margins(w, len(index), len(y)) + bias
    slope, shift = _calibrated(z[n:], y[n:])
    return Classifier(w.astype(np.float32), float(bias), slope, shift)


def _descended(
    gradient: Callable[[np.ndarray, float], tuple[np.ndarray, float]], steps: int
) -> tuple[np.ndarray, float]:
    """Weights and bias after that many steps of Adam."""
    w, bias = np.zeros(2 * SLOTS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        g, gb = gradient(w, bias)
        g = g + 1e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w -= 0.05 * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        bias -= 0.05 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    return w, bias


def _margins(batch: pa.RecordBatch, w: np.ndarray, bias: float) -> Iterator[tuple]:
    """Place, label, slots, shares and margin of each row."""
    columns = [batch.column(c) for c in ("row", "good", "slots", "shares")]
    for row, good, slots, shares in zip(*columns):
        index = np.frombuffer(slots.as_buffer(), "<i4")
        value = np.frombuffer(shares.as_buffer(), "<f4")
        yield row.as_py(), good.as_py(), index, value, float((value * w[index]).sum()) + bias


def fit_in_tasks(
    made: DataFrame, folder: str, max_rows: int = MAX_ROWS, steps: int = 150
) -> Classifier | None:
    """The same as ``fit`` on a sample that stays in the tasks; sums run in another order."""
    table = landed(
        made.repartition(FIT_TASKS).withColumn("row", F.monotonically_increasing_id()),
        f"{folder}/features",
    )
    session = table.sparkSession
    lowest = table.select("doc_id", "good", "row").orderBy("doc_id", "good", "row").limit(max_rows)
    drawn = [tuple(r) for r in lowest.collect()]
    kinds = {good for _, good, _ in drawn}
    if len(drawn) < 10 or len(kinds) < 2:
        return None
    held = {r[2] for r in drawn[::5]}
    learned = {r[2] for r in drawn} - held
    n = len(learned)

    def over(rows: set[int], w: np.ndarray, bias: float, run, schema: str) -> list:
        shipped = session.sparkContext.broadcast((rows, w, bias))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, w, bias = shipped.value
            found = (x for b in batches for x in _margins(b, w, bias) if x[0] in rows)
            yield run(found)

        try:
            return table.mapInArrow(task(__name__, each), schema).collect()
        finally:
            shipped.destroy()

    def summed(found: Iterator[tuple]) -> pa.RecordBatch:
        g, gb = np.zeros(2 * SLOTS), 0.0
        for _, good, index, value, z in found:
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - good) / n
            g[index] += value * error  # a row names a slot once
            gb += error
        return pa.RecordBatch.from_pydict({"g": [g.tobytes()], "gb": [float(gb)]})

    def scored(found: Iterator[tuple]) -> pa.RecordBatch:
        pairs = [(z, float(good)) for _, good, _, _, z in found]
        columns = [pa.array([p[i] for p in pairs], pa.float64()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, names=["z", "good"])

    def gradient(w: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
        parts = over(learned, w, bias, summed, "g BINARY, gb DOUBLE")
        return sum(np.frombuffer(p["g"]) for p in parts), sum(p["gb"] for p in parts)

    w, bias = _descended(gradient, steps)
    z = np.array(sorted(over(held, w, bias, scored, "z DOUBLE, good DOUBLE"))).reshape(-1, 2)
    slope, shift = _calibrated(z[:, 0], z[:, 1])
    return Classifier(w.astype(np.float32), float(bias), slope, shift)


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the margin by Newton's method, with softened labels so that a sample
    that is told apart without error keeps finite values."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    if not good or not bad:
        return 1.0, 0.0
    wanted = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -500, 500)))
        g = np.array([((p - wanted) * z).sum() + 1e-3 * (a - 1), (p - wanted).sum()])
        q = p * (1 - p)
        h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        scale = min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - scale * step[0], b - scale * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    max_rows: int = MAX_ROWS,
    seed: int = 1,
    fit_limit: int = FIT_LIMIT,
    folder: str | None = None,
) -> Classifier | None:
    """A classifier from at most ``max_rows`` labelled documents (``labels``: doc_id, quality)."""
    known = labels.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("good")
    ).where(F.col("doc_id").isNotNull() & F.col("good").isin(0, 1))
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "good").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("body"))
    # At most ``max_rows`` small rows are shipped.
    found = rows.join(F.broadcast(drawn), "doc_id").select("doc_id", "good", "body")
    made = found.mapInArrow(task(__name__, _features), "doc_id BIGINT, good INT, slots BINARY, shares BINARY")
    size = F.sum(F.length("slots") + F.length("shares"))
    if (made.agg(size.alias("b")).first()["b"] or 0) > fit_limit:
        return fit_in_tasks(made, workspace(docs.sparkSession, "quality-fit", folder), max_rows)
    # Repeated document rows may exceed the bound; the lowest ids stay within it.
    return fit([tuple(r) for r in made.orderBy("doc_id").limit(max_rows).collect()])


# --- scoring ---------------------------------------------------------------------------------------


def score(docs: DataFrame, model: Classifier | None, text: str = "text") -> DataFrame:
    """Counts, probability and verdict of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        names = [c.split()[0] for c in _SCORED.split(", ")]
        kinds = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.bool_()]
        for batch in batches_by_bytes(batches, "body"):
            columns: list[list] = [[] for _ in kinds]
            for body in batch.column("body").to_pylist():
                plain, hashes, raw = counts(body or "")
                failed = base_failed(plain[0], plain[4])
                chance = 1.0 if model is None else model.probability(margin(model, hashes, raw))
                kept = not failed and chance >= MIN_PROBABILITY
                for column, value in zip(columns, (*plain, failed, chance, kept)):
                    column.append(value)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("body"))
    return rows.mapInArrow(task(__name__, run), _SCORED)


def keep(docs: DataFrame, model: Classifier | None, text: str = "text") -> DataFrame:
    """The documents that pass, with all their columns as they were."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches_by_bytes(batches, text):
            passed = []
            for body in batch.column(text).to_pylist():
                plain, hashes, raw = counts(body or "")
                good = not base_failed(plain[0], plain[4])
                if good and model is not None:
                    good = model.probability(margin(model, hashes, raw)) >= MIN_PROBABILITY
                passed.append(good)
            yield batch.filter(pa.array(passed))

    return docs.mapInArrow(task(__name__, run), docs.schema)

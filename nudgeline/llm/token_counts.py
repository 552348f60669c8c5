"""Token counts under a unigram model, by dynamic programming shared along a trie.

A text's pre-tokens (runs between ASCII white space, each behind the vocabulary's space mark) are cut
into the pieces whose scores sum up highest; the forward score of a prefix of a pre-token depends on
the prefix alone. So the distinct pre-tokens of a batch are put in order, which walks their trie from
node to node, and every node's score is computed once for all pre-tokens that share the prefix; the
count at its last node is stored for the pre-token. Texts then only add up stored counts.

The pieces are those of the given vocabulary. Its file ranks them and holds no probabilities, so a
piece of rank r has the score -ln(r + 2), the usual law for frequencies by rank. Scores are whole
numbers of 1/10000, so sums do not depend on their order; of equally good cuts the one with fewer
pieces counts. A character without a piece becomes its UTF-8 bytes, each as unlikely as a rank
behind the last.

Work is per row and the stored counts are bounded, so nothing is shuffled and no text depends on
another. Defined cases: a null or empty text has 0 tokens and score 0; very long pre-tokens are cut
as a whole; repeated rows are rows of their own; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, on_change, task

DEFAULT_VOCABULARY = "piece_bpe_32k.model"
SPACE_MARK = "▁"
UNIT = 10_000
KEPT_WORDS = 400_000
# Stored counts hold pieces above this bit and the cost below it, so one sum adds both.
COST_BITS = 48
_COUNTED = "doc_id BIGINT, n_words BIGINT, n_tokens BIGINT, score DOUBLE"


def vocabulary(path: str | None = None) -> dict[str, int]:
    """Cost of each ordinary piece, by rank."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(DEFAULT_VOCABULARY)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.IdToPiece(i)
        for i in range(model.GetPieceSize())
        if not (model.IsControl(i) or model.IsUnknown(i) or model.IsByte(i))
    ]
    return {piece: cost(rank) for rank, piece in enumerate(pieces)}


def cost(rank: int) -> int:
    return round(UNIT * math.log(rank + 2))


class UnigramCounter:
    def __init__(self, costs: dict[str, int], kept_words: int = KEPT_WORDS):
        self.byte_cost = cost(len(costs))
        # Pieces from their last character to their first: one walk finds all that end at a node.
        self.ends: dict = {}
        for piece, value in costs.items():
            node = self.ends
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = value
        self.kept_words = kept_words
        self.known: dict[bytes, int] = {}

    def best_cuts(self, ordered: Iterable[str]) -> Iterator[tuple[int, int]]:
        """Cost and number of pieces of each pre-token; nodes of the trie are visited once when the
        pre-tokens come in order."""
        ends, byte_cost = self.ends, self.byte_cost
        path, costs, sizes = "", [0], [0]
        for word in ordered:
            shared, limit = 0, min(len(path), len(word))
            while shared < limit and path[shared] == word[shared]:
                shared += 1
            del costs[shared + 1 :], sizes[shared + 1 :]
            for at in range(shared, len(word)):
                node, best, size, i = ends, None, 0, at
                while i >= 0:
                    node = node.get(word[i])
                    if node is None:
                        break
                    piece = node.get("")
                    if piece is not None:
                        total = costs[i] + piece
                        if best is None or total < best or total == best and sizes[i] < size:
                            best, size = total, sizes[i]
                    i -= 1
                if word[at] not in ends or "" not in ends[word[at]]:
                    n = len(word[at].encode())
                    total, pieces = costs[at] + n * byte_cost, sizes[at] + n - 1
                    if best is None or total < best or total == best and pieces < size:
                        best, size = total, pieces
                costs.append(best)
                sizes.append(size + 1)
            path = word
            yield costs[-1], sizes[-1]

    def _learn(self, words: set[bytes]) -> None:
        texts = sorted((SPACE_MARK + w.decode(), w) for w in words)
        for (_, word), (value, size) in zip(texts, self.best_cuts(t for t, _ in texts)):
            self.known[word] = size << COST_BITS | value

    def count_all(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """Words, pieces and score of each text."""
        if len(self.known) > self.kept_words:
            self.known = {}
        known = self.known
        cut, new = [], set()
        for text in texts:
            words = (text or "").encode().split()
            found = list(map(known.get, words))
            if None in found:
                new.update(w for w, n in zip(words, found) if n is None)
            cut.append((words, found))
        self._learn(new)
        out = []
        for words, found in cut:
            if None in found:
                found = [known[w] if n is None else n for w, n in zip(words, found)]
            total = sum(found)
            out.append((len(words), total >> COST_BITS, -(total & (1 << COST_BITS) - 1) / UNIT))
        return out


_counters: dict[str | None, UnigramCounter] = {}
on_change(_counters.clear)


def counter(path: str | None = None) -> UnigramCounter:
    """One counter per worker process and vocabulary."""
    if path not in _counters:
        _counters[path] = UnigramCounter(vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Words, tokens and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_by_bytes(batches, "body"):
            found = counter(path).count_all(batch.column("body").to_pylist())
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.float64()),
                ],
                names=["doc_id", "n_words", "n_tokens", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("body"))
    return rows.mapInArrow(task(__name__, run), _COUNTED)

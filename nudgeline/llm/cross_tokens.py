"""Aligns the tokens of two tokenizers over the same bytes, and counts which ids go together.

Tokenizer A is a byte-level BPE, B a piece BPE with byte fallback. Both cut the bytes of space + text
into runs. Byte offsets at which a token of A and a token of B both end cut the tokens into groups,
the smallest runs that either side spells with whole tokens. A link is a pair of one token of each
side whose bytes overlap.

**Groups by pointer jumping.** Every token points to the token, of either side, that overlaps it and
reaches farthest to the right: a token of A to the token of B that holds its last byte, unless they
end together; a token of B to the token of A that holds its last byte. Tokens of A that end where one
of B does point to themselves. Doubling the successors (``p = p[p]``) takes a number of rounds
logarithmic in the longest chain, after which each token points to the last token of A of its group.
That runs over a whole Arrow batch at once: the texts of a batch lie one behind the other on one
line of bytes, and both sides end at the end of a text. Batches are cut to 1 MB of text, or one text.

**Counts.** The links of a text are reduced to distinct id pairs in the task that encoded it and landed
in the shared folder; Spark adds them up per pair (combined before the shuffle) and finds the best
pair of every id of B. Those facts are joined back to the texts' pairs. They are shipped when their
count, looked at first, is at most ``ship_pairs``; otherwise they are joined by a shuffle on pair and
salt, so that a pair that stands in every text spreads over ``salts`` keys. Nothing goes to the driver
but that count.

Texts whose characters all lie below U+0250 are encoded by A's vocabulary in its ranked form, which
is several times faster; the pattern's letter and number classes are the same there in every version
of Unicode. All others go through A's own file. Both give the same ids (see the tests).

Defined cases: a null or empty text, and one whose joined token bytes on either side differ from space +
text (a text with U+2581, which B writes for a space), has no tokens: zeros and an empty digest. Special
tokens' strings in a text are plain text. Repeated rows and rows without an id, or with the same one, are
rows of their own, and count each. An empty table gives no rows. Columns other than the id and the
text are not read, so none can clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, landed, on_change, task, workspace

VOCABULARY_A, RANKS_A = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
VOCABULARY_B = "piece_bpe_32k.model"
# Most id pairs whose facts are shipped to every executor (some 50 MB there).
SHIP_PAIRS = 1_000_000
SALTS = 16
# Text aligned at once; its tokens and links take some hundred times as much for a moment.
BLOCK_BYTES = 1 << 20
_UNSTABLE = re.compile(r"[^\x00-ɏ]")

TOKENS = (
    "row BIGINT, doc_id BIGINT, n_a BIGINT, n_b BIGINT, n_groups BIGINT, n_links BIGINT, "
    "groups_sha256 STRING, links ARRAY<STRUCT<pair: BIGINT, uses: INT>>"
)
_LINKS = pa.list_(pa.struct([("pair", pa.int64()), ("uses", pa.int32())]))


def _byte_letters() -> dict[str, int]:
    """How the byte-level form writes each byte: printable Latin-1 stands for itself, the others
    follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Side:
    """One tokenizer: ids of texts, and the bytes of every id."""

    def __init__(self, spelled: list[bytes]):
        self.spelled = spelled
        self.lengths = np.array([len(s) for s in spelled], np.int64)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        raise NotImplementedError


class ByteSide(Side):
    def __init__(self, path: str, ranks: str | None, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            if all(c in letters for c in entry):
                spelled[i] = bytes(letters[c] for c in entry)
        super().__init__(spelled)
        self.quick = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.quick = tiktoken.Encoding(
                "byte level", pat_str=pattern, mergeable_ranks=known, special_tokens={}
            )

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            if self.quick and not _UNSTABLE.search(text):
                out.append(self.quick.encode_ordinary(" " + text))
            else:
                out.append(self.tokenizer.encode(" " + text, add_special_tokens=False).ids)
        return out


class PieceSide(Side):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                spelled.append(bytes([int(piece[3:-1], 16)]))
            else:
                spelled.append(piece.replace("▁", " ").encode())
        super().__init__(spelled)

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


_sides: dict[tuple, tuple[Side, Side]] = {}
on_change(_sides.clear)


def sides(path_a: str | None = None, path_b: str | None = None) -> tuple[Side, Side]:
    """Both tokenizers, once per worker process. The ranked form is used beside the public file only."""
    if (path_a, path_b) not in _sides:
        import public_tokenizers

        place = public_tokenizers.path
        a = ByteSide(
            path_a or place(VOCABULARY_A),
            None if path_a else place(RANKS_A),
            public_tokenizers.PATTERN,
        )
        _sides[path_a, path_b] = a, PieceSide(path_b or place(VOCABULARY_B))
    return _sides[path_a, path_b]


def last_tokens(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For every token (those of A, then those of B) the last token of A in its group.

    The ends are the byte offsets at which tokens end, ascending; both lists close alike.
    """
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)  # the token of B with the last byte of each of A
    farther = ends_b[over_a] > ends_a if n else np.zeros(0, bool)
    pointer = np.concatenate(
        [np.where(farther, over_a + n, np.arange(n)), np.searchsorted(ends_a, ends_b)]
    )
    while True:
        doubled = pointer[pointer]
        if np.array_equal(doubled, pointer):
            return pointer
        pointer = doubled


class Aligned:
    """The tokens of several texts, one behind the other, with their groups and links."""

    def __init__(self, ids_a: list[list[int]], ids_b: list[list[int]], a: Side, b: Side):
        self.n_a = np.array([len(i) for i in ids_a], np.int64)
        self.n_b = np.array([len(i) for i in ids_b], np.int64)
        self.a = np.fromiter((i for ids in ids_a for i in ids), np.int64, self.n_a.sum())
        self.b = np.fromiter((i for ids in ids_b for i in ids), np.int64, self.n_b.sum())
        ends_a, ends_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        last = last_tokens(ends_a, ends_b)
        n = len(ends_a)
        # Groups in order: the last tokens point to themselves.
        number = np.cumsum(last[:n] == np.arange(n)) - 1
        self.group_a, self.group_b = number[last[:n]], number[last[n:]]
        self.n_groups_in_all = int(number[-1]) + 1 if n else 0
        # Every stretch between neighbouring ends belongs to one token of each side, and two tokens
        # that overlap share exactly one stretch.
        ends = np.union1d(ends_a, ends_b)
        self.link_a, self.link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        texts = np.repeat(np.arange(len(ids_a)), self.n_a)
        self.link_text = texts[self.link_a]
        self.group_text = texts[last[:n][last[:n] == np.arange(n)]]

    def per_text(self, texts: np.ndarray) -> np.ndarray:
        return np.bincount(texts, minlength=len(self.n_a))

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each text (a * width + b), how often, and how many per text."""
        pair = self.a[self.link_a] * width + self.b[self.link_b]
        order = np.lexsort((pair, self.link_text))
        pair, text = pair[order], self.link_text[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        uses = np.diff(np.append(first, len(pair)))
        return pair[first], uses, self.per_text(text[first])

    def spelled(self, names_a: list[bytes], names_b: list[bytes]) -> list[bytes]:
        """The groups of each text as ``a1,a2|b1;a3|b2,b3``. Names come in two lists behind each
        other: with a comma, and with the mark that closes a side."""
        in_a = np.bincount(self.group_a, minlength=self.n_groups_in_all)
        in_b = np.bincount(self.group_b, minlength=self.n_groups_in_all)
        before_b = np.cumsum(in_b) - in_b
        up_to_a = np.cumsum(in_a)
        order = np.empty(len(self.a) + len(self.b), np.int64)
        closes_a = np.append(self.group_a[1:] != self.group_a[:-1], True)[: len(self.a)]
        closes_b = np.append(self.group_b[1:] != self.group_b[:-1], True)[: len(self.b)]
        half_a, half_b, shift = len(names_a) // 2, len(names_b) // 2, len(names_a)
        order[np.arange(len(self.a)) + before_b[self.group_a]] = self.a + half_a * closes_a
        order[np.arange(len(self.b)) + up_to_a[self.group_b]] = self.b + half_b * closes_b + shift
        names = names_a + names_b
        out, start, flat = [], 0, order.tolist()
        for n in (self.n_a + self.n_b).tolist():
            out.append(b"".join([names[i] for i in flat[start : start + n]])[:-1])
            start += n
        return out


def _names(n: int, closing: bytes) -> list[bytes]:
    return [b"%d," % i for i in range(n)] + [b"%d%s" % (i, closing) for i in range(n)]


def _encode(path_a: str | None, path_b: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(path_a, path_b)
        names_a, names_b = _names(len(a.spelled), b"|"), _names(len(b.spelled), b";")
        for batch in batches_by_bytes(batches, "text", BLOCK_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids_a, ids_b = a.encode_all(texts), b.encode_all(texts)
            for i, text in enumerate(texts):
                want = b" " + text.encode()
                whole = text and all(
                    b"".join([side.spelled[t] for t in ids]) == want
                    for side, ids in ((a, ids_a[i]), (b, ids_b[i]))
                )
                if not whole:
                    ids_a[i], ids_b[i] = [], []
            found = Aligned(ids_a, ids_b, a, b)
            pair, uses, n_pairs = found.pairs(len(b.spelled))
            digests = [hashlib.sha256(s).hexdigest() if s else "" for s in found.spelled(names_a, names_b)]
            starts = np.concatenate([[0], np.cumsum(n_pairs)]).astype(np.int32)
            links = pa.ListArray.from_arrays(
                pa.array(starts),
                pa.StructArray.from_arrays(
                    [pa.array(pair), pa.array(uses.astype(np.int32))], fields=list(_LINKS.value_type)
                ),
            )
            counts = (found.n_a, found.n_b, found.per_text(found.group_text), found.per_text(found.link_text))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    *[pa.array(c.astype(np.int64)) for c in counts],
                    pa.array(digests),
                    links.cast(_LINKS),
                ],
                names=[c.split(" ")[0] for c in TOKENS.split(", ")[:7]] + ["links"],
            )

    return run


def pair_facts(links: DataFrame, width: int) -> DataFrame:
    """``pair``, how many links hold it, and whether no pair of the same id of B has more."""
    counts = links.groupBy("pair").agg(F.sum("uses").alias("n"))
    tops = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("n").alias("top"))
    # One row per id of B.
    joined = counts.join(F.broadcast(tops), F.col("pair") % width == F.col("b"))
    return joined.select("pair", "n", (F.col("n") == F.col("top")).alias("is_best"))


def align(
    docs: DataFrame,
    path_a: str | None = None,
    path_b: str | None = None,
    ship_pairs: int = SHIP_PAIRS,
    salts: int = SALTS,
    folder: str | None = None,
) -> DataFrame:
    """One row per document: how many tokens, groups and links it has, how many links are their id of
    B's most frequent one, the sum of its links' counts, and a digest of its groups."""
    folder = workspace(docs.sparkSession, "aligned", folder)
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    tokens = landed(numbered.mapInArrow(task(__name__, _encode(path_a, path_b)), TOKENS), f"{folder}/tokens")
    width = len(sides(path_a, path_b)[1].spelled)
    links = tokens.select("row", F.inline("links"))
    facts = landed(pair_facts(links, width), f"{folder}/facts")
    if facts.count() <= ship_pairs:
        known = links.join(F.broadcast(facts), "pair")
    else:
        every = F.explode(F.array(*map(F.lit, range(salts)))).alias("salt")
        salt = F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")
        known = links.withColumn("salt", salt).join(facts.select("*", every), ["pair", "salt"])
    sums = known.groupBy("row").agg(
        F.sum(F.when(F.col("is_best"), F.col("uses")).otherwise(0)).alias("n_best"),
        F.sum(F.col("uses") * F.col("n")).alias("count_sum"),
    )

    def whole(name):
        return F.coalesce(name, F.lit(0)).cast("bigint").alias(name)

    return tokens.drop("links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", whole("n_best"), whole("count_sum"), "groups_sha256"
    )

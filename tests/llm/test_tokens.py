import zlib

import fixtures
import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from nudgeline.llm import packing, token_counts, token_files
from nudgeline.llm.word_tokens import WordEncoder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain_ids(tokenizer, text, end):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_word_by_word_equals_the_whole(tokenizer):
    odd = ["I'll don't 'S x'RE", "a1b2 a.b,c d|e", "ΑΣ ΑΣ. ſ K", "á éx ñ.", "x" * 3000]
    odd += ["½ ² ª º µ ÷ × ß ẞ ǅ", "z\x1cq\x85w v", "<|startoftext|> A", "l'école n'est"]
    texts = [r[1] for r in fixtures.texts()] + odd
    encoder = WordEncoder(kept_words=50)
    for _ in range(2):
        found = [np.frombuffer(b, "<u2").tolist() for b in encoder.encode_all(texts)]
        assert found == [plain_ids(tokenizer, t, 0)[:-1] for t in texts]


def test_special_tokens_count_in_their_own_spelling_only(tokenizer):
    texts = ["<|ENDOFTEXT|>", "Some <|EndOfText|> more", "x<|STARTOFTEXT|>y <|endoftext|> Z"]
    texts += ["<|endoftext|>", "<|startofTEXT|> and <|startoftext|>", "<|ENDOF TEXT|>"]
    encoder = WordEncoder()
    for _ in range(2):
        found = [np.frombuffer(b, "<u2").tolist() for b in encoder.encode_all(texts)]
        assert found == [plain_ids(tokenizer, t, 0)[:-1] for t in texts]
    assert 49407 not in found[0] and found[3] == [49407]


def test_round_trip(spark, tokenizer, tmp_path):
    rows = fixtures.texts()
    docs = fixtures.documents(spark, rows)
    found = fixtures.by_id(token_files.round_trip(docs, 2))
    start = 0
    for doc_id, text in sorted((r[0], r[1]) for r in rows):
        ids = plain_ids(tokenizer, text, 2)
        r = found[doc_id]
        want = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == want
        start += len(ids)


def test_files_hold_independent_checked_frames(spark, tokenizer, tmp_path):
    rows = fixtures.texts()
    files = token_files.write(fixtures.documents(spark, rows), str(tmp_path), 2, n_files=2)
    paths = [r["file"] for r in files.orderBy("part").collect()]
    texts = [t for _, t in sorted((r[0], r[1]) for r in rows)]
    want = b"".join(np.array(plain_ids(tokenizer, t, 2), "<u2").tobytes() for t in texts)
    # Any reader of the format can unpack the whole file.
    unpack = zstandard.ZstdDecompressor()
    whole = b"".join(
        unpack.stream_reader(open(p, "rb"), read_across_frames=True).read() for p in paths
    )
    assert whole == want
    part = files.orderBy("part").first()["part"]
    first, third = token_files.read_some(files, part, [0, 2])
    assert first.tolist() == plain_ids(tokenizer, texts[0], 2)
    assert third.tolist() == plain_ids(tokenizer, texts[2], 2)
    reader = token_files.FrameReader(paths[0])
    at = int(reader.starts[3]) + int(reader.entries[3][0]) - 1
    data = bytearray(open(paths[0], "rb").read())
    data[at] ^= 1
    open(paths[0], "wb").write(bytes(data))
    broken = token_files.FrameReader(paths[0])
    next(broken.frames(0, 1))
    with pytest.raises((token_files.CorruptFrame, zstandard.ZstdError)):
        next(broken.frames(3, 4))


def test_packing(spark, tokenizer):
    rows = fixtures.texts()
    found = packing.pack_documents(fixtures.documents(spark, rows), 0, 256).collect()
    pieces = {}
    for r in found:
        pieces.setdefault(r["doc_id"], {})[r["piece"]] = r
    for doc_id, text, *_ in rows:
        ids = plain_ids(tokenizer, text, 0)
        own = pieces.pop(doc_id)
        assert sorted(own) == list(range(-(-len(ids) // 256)))
        for piece, r in own.items():
            part = ids[256 * piece : 256 * piece + 256]
            assert (r["start"], r["length"]) == (256 * piece, len(part))
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    assert not pieces
    check_sequences(found, 256)


def check_sequences(found, capacity):
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_is_about_as_tight_as_best_fit(spark):
    rng = np.random.default_rng(2)
    mixes = [
        rng.integers(1, 101, 3000),
        np.full(900, 34),
        np.concatenate([np.full(500, 1), rng.integers(40, 60, 800)]),
        np.full(70, 100),
    ]
    for lengths in mixes:
        rows = [(i, 0, int(n)) for i, n in enumerate(lengths)]
        pieces = spark.createDataFrame(rows, "doc_id BIGINT, piece INT, length INT")
        found = packing.pack(pieces, 100).collect()
        assert sorted(r["doc_id"] for r in found) == list(range(len(rows)))
        used = check_sequences(found, 100)
        free, best = [], 0
        for n in sorted(map(int, lengths), reverse=True):
            fitting = [g for g in free if g >= n]
            if fitting:
                free.remove(min(fitting))
                free.append(min(fitting) - n)
            else:
                best += 1
                free.append(100 - n)
        assert used <= best * 1.02 + 1


def test_sweep_takes_the_smallest_fitting_gap():
    moves = packing.sweep({60: 2, 10: 3}, {70: 1, 100: 5, 15: 1})
    assert moves == [(70, 0, 1, 60, 1), (100, 0, 1, 60, 1), (15, 0, 1, 10, 1), (100, 1, 1, 10, 2)]


def plain_unigram(costs, worst, word):
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        found = [
            (best[s][0] + costs[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in costs
        ]
        if word[end - 1] not in costs:
            n = len(word[end - 1].encode())
            found.append((best[end - 1][0] + n * worst, best[end - 1][1] + n))
        best.append(min(found))
    return best[-1]


def test_token_counts(spark):
    rows = fixtures.texts()
    costs = token_counts.vocabulary()
    worst = token_counts.cost(len(costs))
    found = fixtures.by_id(token_counts.count_tokens(fixtures.documents(spark, rows)))
    cache = {}
    for doc_id, text, *_ in rows:
        words = fixtures.WORD.findall(text or "")
        if len(words) > 5000:
            continue
        for w in set(words) - set(cache):
            cache[w] = plain_unigram(costs, worst, "▁" + w)
        total = [sum(cache[w][i] for w in words) for i in (0, 1)]
        r = found[doc_id]
        assert (r["n_words"], r["n_tokens"]) == (len(words), total[1])
        assert r["score"] == pytest.approx(-total[0] / token_counts.UNIT)


def test_shared_prefixes_are_scored_once():
    visits = []

    class Ends(dict):
        def get(self, key):
            visits.append(key)
            return super().get(key)

    counter = token_counts.UnigramCounter({"a": 5, "b": 7, "ab": 8, "▁": 1})
    counter.ends = Ends(counter.ends)
    assert list(counter.best_cuts(["▁ab", "▁aba", "▁abab"])) == [(9, 2), (14, 3), (17, 3)]
    assert len(visits) == 5  # one per node of the trie

"""Token ids of whole texts with ``word_bpe_49k.json``, the same as ``encode`` gives, word by word.

The tokenizer cuts at white space before anything else, so a text's ids are those of its words in a
row. Words repeat, so each task keeps the ids of words it has met in a table of bounded size. Words
of plain letters and closing punctuation go straight to the tokenizer's model; all others take its
whole way. Words are looked up in lower case, but a special token counts in its own spelling only, so
a text that holds one in any case is encoded as a whole, as it stands.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .common import on_change

DEFAULT_VOCABULARY = "word_bpe_49k.json"
KEPT_WORDS = 300_000
# Letters whose lower case and composition are settled, then at most one run of closing marks.
_LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))]
_SIMPLE = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?|]*)")


class WordEncoder:
    """Ids as little-endian 16-bit numbers."""

    def __init__(self, path: str | None = None, kept_words: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(DEFAULT_VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids must fit into 16 bits")
        # How the vocabulary writes each letter's bytes.
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self._table = {ord(c): spell(c)[0][0] for c in _LETTERS}
        specials = self.tokenizer.get_added_tokens_decoder().values()
        self._specials = [t.content.encode().lower() for t in specials]
        self.kept_words = kept_words
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u2").tobytes()

    def _learn(self, word: bytes) -> None:
        text = word.decode()
        match = _SIMPLE.fullmatch(text)
        if not match:
            self.known[word] = self._whole(text)
            return
        model, table = self.tokenizer.model, self._table
        ids = [t.id for t in model.tokenize(match[1].translate(table))]
        if match[2]:
            ids += [t.id for t in model.tokenize(match[2])]
        self.known[word] = array("H", ids).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; none for null."""
        if len(self.known) > self.kept_words:
            self.known = {}
        known, out = self.known, []
        for text in texts:
            raw = (text or "").encode()
            lower = raw.lower()
            if any(s in lower for s in self._specials):
                out.append(self._whole(text))
                continue
            words = lower.split()
            found = list(map(known.get, words))
            if None in found:
                for i, ids in enumerate(found):
                    if ids is None:
                        if words[i] not in known:
                            self._learn(words[i])
                        found[i] = known[words[i]]
            out.append(b"".join(found))
        return out


_encoders: dict[str | None, WordEncoder] = {}
on_change(_encoders.clear)


def encoder(path: str | None = None) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]

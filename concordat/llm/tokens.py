"""Ids of word-level BPE texts, as the tokenizers library gives them; words are encoded by the library once and remembered."""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import END, ChunkCache, in_blocks, kept_state, listed

#: For texts of these characters alone (composed, no control characters), lower-casing and cutting at white space is exactly
#: what the vocabulary's normaliser and pattern do; other texts go to the library whole.
PLAIN = re.compile("[\t-\r -~\xa0-\u024f\u2018-\u201d\u2013\u2014\u2026]*")
WORD = re.compile(r"\S+")
#: The vocabulary's own pattern (fixed value) for what lower-casing makes of those characters.
LETTER, NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af\u2c65\u2c66", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")


#: What words hold besides ASCII: the other characters of PLAIN, and of their lower-case forms.
OTHER = [*range(0xA1, 0x2B0), 0x307, 0x2C65, 0x2C66, *range(0x2010, 0x2030)]
#: Pieces a worker remembers, characters whose words are looked up at once.
PIECES, STRETCH = 200_000, 1 << 21


class WordTokenizer:
    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        #: the byte-level pre-tokeniser's characters for the bytes of each other character
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {c: level.pre_tokenize_str(chr(c))[0][0] for c in OTHER}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.vocabulary = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.cache = ChunkCache(self.encode_words, limit)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words; white space and end marks have none. The library's model is asked once for each piece."""
        rows, known, tokenize = [], self.pieces, self.whole.model.tokenize
        if len(known) > PIECES:
            known.clear()
        for w in words:
            row: tuple[int, ...] = ()
            if w != END:
                bare = w.strip()
                for p in (bare,) if bare.isalpha() and bare.isascii() else PIECE.findall(w):
                    ids = known.get(p)
                    if ids is None:
                        ids = known[p] = tuple([t.id for t in tokenize(p if p.isascii() else p.translate(self.as_bytes))])
                    row = row + ids if row else ids
            rows.append(row)
        return listed(rows)

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if not self.plain(text):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.concatenate([np.zeros(0, np.uint32), *(self.cache.values(words) for words in in_blocks(WORD, text.lower()))])

    def encode_batch(self, texts: list) -> list[np.ndarray]:
        """Like encode() of each, with the words of many texts looked up at once."""
        out: list = [None] * len(texts)
        owner, held, size = [], [], 0
        for k, t in enumerate(texts):
            if t and len(t) <= STRETCH and "\xa0" not in t and self.plain(t):
                owner.append(k)
                held.append(t.lower())
                size += len(t)
            else:
                out[k] = self.encode(t)
            if held and (size > STRETCH or k == len(texts) - 1):
                for j, ids in zip(owner, self.cache.split(held), strict=True):
                    out[j] = ids
                owner, held, size = [], [], 0
        return out


def word_tokenizer(path: str) -> WordTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept_state(WordTokenizer, path)

"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary's byte strings finds, for each position of a chunk, the longest token that
starts there. The encoder takes longest tokens from left to right. A token may follow another only if merging their bytes
gives just these two tokens (the pair-compatibility table, filled as pairs occur); otherwise it tries the next shorter token,
and steps back when none is left. Positions found to be dead ends are marked, so the work is linear. Since each prefix has
one valid encoding, this equals merging by rank. Decoding concatenates byte slices of one table by id.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import END, ChunkCache, bounded_batches, in_blocks, kept_state, listed, map_text, structs

#: Pieces whose ids a worker remembers, characters whose chunks are looked up at once.
PIECES, STRETCH = 400_000, 1 << 22
#: Texts of these characters are cut here; for others the library's own pre-tokeniser tells the pieces (its Unicode tables count).
PLAIN = re.compile("[\t-\r -~ -ɏ]*")
#: Runs without white space, each with the space before it: the pieces of the full pattern never cross these.
COARSE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: The vocabulary's own pattern (fixed value), for plain characters.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼-¾"
FINE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
KIND = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def byte_of_symbol() -> dict[str, int]:
    """Printable bytes stand for themselves; the others, in order, for the characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBPE:
    def __init__(self, path: str, limit: int = 600_000):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = byte_of_symbol()
        raw = lambda s: bytes(map(as_byte.__getitem__, s))
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: raw(s) for s, i in vocab.items() if s not in self.special}
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        #: (rank, left, right) of the merge that makes a token; bytes have none
        self.made: dict[int, tuple[int, int, int]] = {}
        for (a, b), (r, c) in self.rank.items():
            self.made.setdefault(c, (r, a, b))
        self.automaton = ahocorasick.Automaton()
        id_of = {v: k for k, v in self.bytes_of.items()}
        self.shorter: dict[int, int] = {}
        for s, i in id_of.items():
            self.automaton.add_word(s.decode("latin-1"), (len(s), i))
            self.shorter[i] = next((id_of[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in id_of), -1)
        self.automaton.make_automaton()
        self.length = {i: len(s) for i, s in self.bytes_of.items()}
        self.fits: dict[int, bool] = {}
        self.pieces: dict[str, array] = {}
        table = self.bytes_of | {i: s.encode() for s, i in self.special.items()}
        n = max(table) + 1
        self.table = np.frombuffer(b"".join(table.get(i, b"") for i in range(n)), np.uint8)
        self.size = np.fromiter((len(table.get(i, b"")) for i in range(n)), np.int64, n)
        self.first = np.cumsum(self.size) - self.size
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.as_byte = as_byte
        self.cache = ChunkCache(lambda chunks: listed([self.encode_coarse(c) for c in chunks]), limit)

    def compatible(self, a: int, b: int) -> bool:
        """Would merging leave the boundary between tokens a and b? Undo the later of the two tokens' merges, step by step,
        and see whether the two that meet there would have merged before what was undone."""
        key = a << 20 | b
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # times at which the current left and right neighbours of the boundary stop existing (they merge away from it)
        gone_left = gone_right = float("inf")
        while True:
            met = self.rank.get((a, b))
            if met is not None and met[0] < gone_left and met[0] <= gone_right:  # equal ranks merge from the left
                return False
            born_a, born_b = self.made.get(a, (-1,))[0], self.made.get(b, (-1,))[0]
            if born_a < 0 and born_b < 0:
                return True
            if born_a > born_b:
                gone_left, a = born_a, self.made[a][2]
            else:
                gone_right, b = born_b, self.made[b][1]

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest: list[int] = [-1] * n
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - size] = token  # a longer token from the same start ends later
        fits, length = self.fits, self.length
        out: list[int] = []
        open_ = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        while token >= 0:
            while True:
                end = at + length[token]
                fit = open_[end] and (not out or fits.get(out[-1] << 20 | token))
                if fit is None:
                    fit = self.compatible(out[-1], token)
                if fit:
                    out.append(token)
                    at, token = end, longest[end] if end < n else -1
                    break
                token = self.shorter[token]
                if token < 0:
                    open_[at] = 0
                    token = out.pop()
                    at -= length[token]
                    break
        return out

    def encode_coarse(self, chunk: str) -> list[int]:
        """A chunk's pieces in turn; pieces recur under other punctuation, so they are remembered too."""
        out: list[int] = []
        if chunk == END:
            return out
        for p in FINE.findall(chunk):
            ids = self.pieces.get(p)
            if ids is None:
                if len(self.pieces) > PIECES:
                    self.pieces.clear()
                ids = self.pieces[p] = array("I", self.encode_piece(p.encode()))
            out += ids
        return out

    def encode_other(self, text: str) -> list[int]:
        out: list[int] = []
        for p, _ in self.pre.pre_tokenize_str(text):
            out += self.encode_piece(bytes(map(self.as_byte.__getitem__, p)))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids as uint32. Special strings inside a text become their ids, as the library does by default. The chunks of many
        texts are looked up at once."""
        done: list[list[np.ndarray]] = [[] for _ in texts]
        places, held, size = [], [], 0

        def add() -> None:
            for (parts, k), ids in zip(places, self.cache.split(held), strict=True):
                parts[k] = ids

        for parts, text in zip(done, texts, strict=True):
            for s in self.split.split(text) if self.split else [text]:
                if s in self.special:
                    parts.append(np.asarray([self.special[s]], np.uint32))
                elif s and PLAIN.fullmatch(s):
                    if len(s) > STRETCH or "\xa0" in s:
                        parts += [self.cache.values(own) for own in in_blocks(COARSE, s)]
                        continue
                    places.append((parts, len(parts)))
                    parts.append(np.zeros(0, np.uint32))
                    held.append(s)
                    size += len(s)
                    if size > STRETCH:
                        add()
                        places, held, size = [], [], 0
                elif s:
                    parts.append(np.asarray(self.encode_other(s), np.uint32))
        if places:
            add()
        return [np.concatenate([np.zeros(0, np.uint32), *p]) for p in done]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; broken UTF-8 becomes U+FFFD. Special tokens stay."""
        ids = ids.astype(np.int64)
        parts = []
        for k in range(0, len(ids), 1 << 18):
            i = ids[k : k + (1 << 18)]
            size = self.size[i]
            end = np.cumsum(size)
            parts.append(self.table[np.arange(int(size.sum())) + np.repeat(self.first[i] - (end - size), size)].tobytes())
        return b"".join(parts).decode("utf-8", "replace")


def codec(path: str) -> ByteBPE:
    return kept_state(ByteBPE, path)


def encode_ids(text: Column, path: str) -> Column:
    """array<int> of ids of a text column; null as empty."""
    import pyarrow as pa

    def run(texts: list):
        rows = [ids.astype(np.int32) for ids in codec(path).encode_batch([t or "" for t in texts])]
        off = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)])))

    return map_text(run, T.ArrayType(T.IntegerType()), text)


def decode_ids(ids: Column, path: str) -> Column:
    """Text of an array<int> column; null stays null."""
    import pyarrow as pa

    return map_text(lambda rows: pa.array([None if r is None else codec(path).decode(np.asarray(r, np.uint32)) for r in rows], pa.string()), T.StringType(), ids)


def round_trip(text: Column, path: str) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256>: encode, hash the ids, decode them, hash the text."""

    def run(texts: list):
        bpe = codec(path)
        n, a, b = [], [], []
        for ids in bpe.encode_batch([t or "" for t in texts]):
            n.append(len(ids))
            a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return structs(KIND, n_tokens=n, ids_sha256=a, decoded_sha256=b)

    return map_text(run, KIND, text)


def round_trip_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and the digests of round_trip(). Null texts count as empty (no ids). Map-only; repeated rows
    stay, extra columns are dropped, an empty table gives an empty one."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col), round_trip(F.col(text_col), path).alias("_r")).select(id_col, "_r.*")

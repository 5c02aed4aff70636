"""Token counts by byte-pair merging with a heap and a linked list.

A text becomes symbols (characters; one the vocabulary lacks counts as its UTF-8 bytes). A heap holds the adjacent pairs
that form a piece; the pair of the lowest rank, leftmost among equals, merges again and again. The count is the number of
initial symbols less the merges; no ids are made. Chunks that no piece can span are counted once and remembered.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ChunkCache, bounded_batches, in_blocks, kept_state, map_text, structs

SPACE = "▁"
#: A run of spaces belongs to what follows it; a line feed stands alone.
CHUNKS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
KIND = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])


class PieceCounter:
    """Ranks of a sentencepiece BPE model with byte fallback, identity normalisation and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        for p in pieces:
            if len(p) > 1 and ("\n" in p or any(b == SPACE != a for a, b in zip(p, p[1:], strict=False))):
                raise ValueError(f"a piece spans words, so texts can't be cut there: {p!r}")
        order = {s: i for i, s in enumerate(sorted(set(pieces.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in pieces.items()}
        self.cache = ChunkCache(lambda chunks: (np.asarray([self.merged(c) for c in chunks]), np.ones(len(chunks), np.int64)))

    def merged(self, chunk: str) -> int:
        """Tokens of one chunk, in which a space stands for the word mark."""
        word, rank = chunk.replace(" ", SPACE), self.rank
        n = len(word)
        count = sum(1 if c in rank else len(c.encode("utf-8", "replace")) for c in word)
        bits = n.bit_length() + 1
        low = (1 << bits) - 1
        size, before = [1] * n, list(range(-1, n))  # a symbol is known by its first character; before: the symbol on its left
        heap = [(rank[word[i : i + 2]] << bits | i) << bits | 2 for i in range(n - 1) if word[i : i + 2] in rank]
        heapq.heapify(heap)
        while heap:
            key = heapq.heappop(heap)
            length, left = key & low, (key >> bits) & low
            right = left + size[left]
            if not size[left] or right >= n or size[left] + size[right] != length:
                continue  # one of the two has merged since
            count -= 1
            size[left], size[right] = length, 0
            after = left + length
            if after < n:
                before[after] = left
                if (r := rank.get(word[left : after + size[after]])) is not None:
                    heapq.heappush(heap, (r << bits | left) << bits | length + size[after])
            if left and (r := rank.get(word[(p := before[left]) : after])) is not None:
                heapq.heappush(heap, (r << bits | p) << bits | after - p)
        return count

    def count(self, texts: list[str]) -> list[int]:
        """Texts are cut into chunks first; all chunks of a stretch of texts are looked up together."""
        out, parts, owner, held = [0] * len(texts), [], [], 0

        def add() -> None:
            n = self.cache.values([c for p in parts for c in p])
            for k, p in zip(owner, np.split(n, np.cumsum([len(p) for p in parts])[:-1]), strict=True):
                out[k] += int(p.sum(dtype=np.int64))

        for k, text in enumerate(texts):
            if text:
                for part in in_blocks(CHUNKS, " " + text.replace(SPACE, " ")):
                    parts.append(part)
                    owner.append(k)
                    held += len(part)
                    if held > 1 << 18:
                        add()
                        parts, owner, held = [], [], 0
        if parts:
            add()
        return out


def counter(path: str) -> PieceCounter:
    return kept_state(PieceCounter, path)


def token_counts(text: Column, path: str, limit: int = 4096) -> Column:
    """struct<n_bytes, n_tokens, over_limit> of a text column.

    Null and empty texts: 0 bytes, 0 tokens. Texts are whole, however long. Equal texts give equal counts.
    """

    def run(texts: list) -> object:
        texts = [t or "" for t in texts]
        n = counter(path).count(texts)
        return structs(KIND, n_bytes=[len(t.encode()) for t in texts], n_tokens=n, over_limit=[x > limit for x in n])

    return map_text(run, KIND, text)


def count_documents(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_bytes, n_tokens, over_limit. Map-only. Repeated rows stay; other columns are dropped."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col), token_counts(F.col(text_col), path, limit).alias("_r")).select(id_col, "_r.*")

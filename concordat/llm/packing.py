"""Packing documents into fixed-length sequences: first-fit decreasing in randomised groups of documents.

Every document's ids and its end id are cut into pieces of at most the sequence length, so only the last piece of a document
can be short. Documents are dealt to groups at random (by a hash of what they are, so a repeated task deals them alike; equal
rows are numbered and dealt apart). Within a group the pieces come in descending length: full ones are sequences of their own,
each other one goes to the first sequence with room; a tournament tree over the sequences' free room finds it in logarithmic
time. Ids never move: only (document, start, length, checksum) rows are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, table_batch, tidy
from .tokens import word_tokenizer

#: Documents per group on average, the seed of the dealing.
GROUP_DOCS, SEED = 8192, 20


class RoomTree:
    """A tournament tree: each node knows the largest free room below it. Untouched leaves are fresh sequences, so the
    leftmost leaf with room is first fit, new sequences included. It doubles while it is full."""

    def __init__(self, capacity: int, leaves: int = 256):
        self.capacity, self.leaves = capacity, leaves
        self.room = [capacity] * (2 * leaves)

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        while self.room[1] < size:
            old, self.leaves = self.room[self.leaves :], self.leaves * 2
            self.room = [0] * self.leaves + old + [self.capacity] * len(old)
            for i in range(self.leaves - 1, 0, -1):
                self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])
        room, i = self.room, 1
        while i < self.leaves:
            i *= 2
            if room[i] < size:
                i += 1
        leaf, offset = i - self.leaves, self.capacity - room[i]
        room[i] -= size
        while i > 1:
            i //= 2
            most = max(room[2 * i], room[2 * i + 1])
            if room[i] == most:
                break
            room[i] = most
        return leaf, offset


def pieces(docs: DataFrame, path: str, end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, doc_crc32. Null and empty texts give one piece, the end id."""
    bounded_batches(docs.sparkSession)
    key = docs.schema[id_col]
    kind = T.StructType([T.StructField(id_col, key.dataType), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "doc_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, rows = batch.column(0).to_pylist(), []
            for d, ids in zip(who, word_tokenizer(path).encode_batch(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                whole = zlib.crc32(ids.tobytes())
                rows += [(d, k, len(p), zlib.crc32(p.tobytes()), len(ids), whole) for k in range(0, len(ids), length) for p in (ids[k : k + length],)]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield table_batch(kind, **dict(zip(kind.names, cols, strict=True)))

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(tidy(run), kind)


def pack(parts: DataFrame, groups: int, length: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces(). sequence_id = group * 2^32 + number in the group.

    A document's pieces go to one group. Equal rows are counted before they are shuffled and numbered after, and their numbers
    deal them, so that many copies of one row don't meet in one group.
    """
    names = parts.columns
    kind = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tree, full = None, RoomTree(length), 0
        for batch in batches:
            seq, off = [], []
            for g, size in zip(batch.column("_group").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if g != group:
                    group, tree, full = g, RoomTree(length), 0
                if size == length:  # comes first, and leaves no room
                    found, full = (0, 0), full + 1
                    seq.append((g << 32) + full - 1)
                else:
                    found = tree.place(size)
                    seq.append((g << 32) + full + found[0])
                off.append(found[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*names, "sequence_id", "offset"])

    copies = parts.groupBy(*names).agg(F.count("*").alias("_copies")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    deal = F.pmod(F.xxhash64(F.col(id_col), "doc_tokens", "doc_crc32", "_copy", F.lit(SEED)), F.lit(groups))
    dealt = copies.select(*names, "_copy", deal.cast("long").alias("_group")).repartition("_group")
    return dealt.sortWithinPartitions("_group", F.desc("length"), id_col, "doc_tokens", "doc_crc32", "_copy", "start").mapInArrow(tidy(run), kind)


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, length: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, start, length, ids_crc32, doc_tokens, doc_crc32, sequence_id, offset), one per piece.

    Each id of a document lies in one piece; a sequence's offsets have no gaps and sum to at most ``length`` (the rest is
    padding). Null text: the end id alone. Repeated rows are packed as often as they occur, rows that share an id each by its
    text, rows with a null id like others. Extra columns are dropped. An empty table packs to nothing.
    """
    groups = max(1, -(-docs.count() // GROUP_DOCS))
    return pack(pieces(docs, path, end_id, length, id_col, text_col), groups, length, id_col)

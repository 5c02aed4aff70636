"""Token files: ids at the vocabulary's minimum width, in blocks with an offset table.

A shard file holds consecutive documents of the corpus in ascending id order:
    header   magic, version, bits per id, ids per block, documents, ids, blocks (fixed struct)
    table    per document: its id (int64), whether it is null (uint8), its number of ids (uint64)
    offsets  per block, the byte at which it starts (uint64), and the end
    blocks   ids, ``bits`` each, least significant first, in little-endian 64-bit words
Any run of ids is read from its own blocks alone and unpacked by numpy, 64 ids to ``bits`` words at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded_batches, open_fs, shared_folder, table_batch, tidy, written
from .tokens import word_tokenizer

MAGIC, HEAD = b"CTOK", struct.Struct("<4sHHIQQQ")
BLOCK_IDS, SHARD_IDS = 1 << 16, 1 << 21
MANIFEST = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])
ROWS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    n = -(-len(ids) // 64)
    lanes = np.zeros((n, 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    words = np.zeros((n, bits), np.uint64)
    for j in range(64):
        w, s = divmod(j * bits, 64)
        words[:, w] |= lanes[:, j] << np.uint64(s)
        if s + bits > 64:
            words[:, w + 1] |= lanes[:, j] >> np.uint64(64 - s)
    return words.astype("<u8").tobytes()


def unpack_bits(data: bytes, bits: int, count: int) -> np.ndarray:
    words = np.frombuffer(data, "<u8").reshape(-1, bits).astype(np.uint64)
    out = np.empty((len(words), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        w, s = divmod(j * bits, 64)
        x = words[:, w] >> np.uint64(s)
        if s + bits > 64:
            x = x | words[:, w + 1] << np.uint64(64 - s)
        out[:, j] = x & mask
    return out.reshape(-1)[:count]


def shard_bytes(doc_ids: list, sizes: list[int], ids: np.ndarray, bits: int) -> bytes:
    blocks = [pack_bits(ids[k : k + BLOCK_IDS], bits) for k in range(0, len(ids), BLOCK_IDS)]
    fixed = HEAD.size + 17 * len(doc_ids) + 8 * (len(blocks) + 1)
    offsets = fixed + np.cumsum([0, *map(len, blocks)])
    return b"".join([
        HEAD.pack(MAGIC, 1, bits, BLOCK_IDS, len(doc_ids), len(ids), len(blocks)),
        np.asarray([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.asarray([d is None for d in doc_ids], np.uint8).tobytes(),
        np.asarray(sizes, "<u8").tobytes(),
        offsets.astype("<u8").tobytes(),
        *blocks,
    ])


class Shard:
    """Random access to one file; ``file`` is any seekable binary file."""

    def __init__(self, file):
        self.file = file
        magic, _, self.bits, self.block_ids, self.n_docs, self.n_ids, n_blocks = HEAD.unpack(file.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.doc_ids = np.frombuffer(file.read(8 * self.n_docs), "<i8")
        self.null = np.frombuffer(file.read(self.n_docs), np.uint8)
        self.sizes = np.frombuffer(file.read(8 * self.n_docs), "<u8").astype(np.int64)
        self.offsets = np.frombuffer(file.read(8 * (n_blocks + 1)), "<u8").astype(np.int64)
        self.ends = np.cumsum(self.sizes)

    def ids(self, first: int, count: int) -> np.ndarray:
        """Ids first .. first + count of this file, from the blocks that hold them."""
        if not count:
            return np.zeros(0, np.uint32)
        a, b = first // self.block_ids, (first + count - 1) // self.block_ids + 1
        self.file.seek(int(self.offsets[a]))
        raw = self.file.read(int(self.offsets[b] - self.offsets[a]))
        return unpack_bits(raw, self.bits, min(self.n_ids, b * self.block_ids) - a * self.block_ids)[first - a * self.block_ids :][:count]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.ends[k] - self.sizes[k]), int(self.sizes[k]))


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write shards under ``folder`` in ascending id order; returns their manifest with ``base``, the ids before each shard.

    A shard closes at SHARD_IDS ids, so a task never holds more than one shard and one batch. File names hold the attempt, so
    a repeated task never touches another's file; only files named by the manifest count.
    """
    bounded_batches(docs.sparkSession)
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, shard = TaskContext.get(), 0
        bits = bits_for(word_tokenizer(path).vocabulary)
        store, top = open_fs(folder)
        who, sizes, held, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            name = f"part-{task.partitionId():06d}-{shard:05d}-{task.taskAttemptId()}.tok"
            with store.open_output_stream(f"{top}/{name}") as f:
                f.write(shard_bytes(who, sizes, np.concatenate(held), bits))
            return table_batch(MANIFEST, part=[task.partitionId()], shard=[shard], path=[f"{folder}/{name}"], n_docs=[len(who)], n_ids=[total])

        for batch in batches:
            words = word_tokenizer(path)  # asked for again with each batch, so that it counts as in use when the next task starts
            for d, ids in zip(batch.column(0).to_pylist(), words.encode_batch(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                who.append(d)
                sizes.append(len(ids))
                held.append(ids)
                total += len(ids)
                if total >= SHARD_IDS:
                    yield close()
                    who, sizes, held, total, shard = [], [], [], 0, shard + 1
        if who:
            yield close()

    # rows that share an id are ranged by a hash of their texts, so that they need not meet in one task
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    made = written(ordered.mapInArrow(tidy(run), MANIFEST), f"{folder}/manifest")
    # one long per partition comes to the driver; within a partition a window adds its shards up
    before, bases = 0, {}
    for r in made.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toLocalIterator():
        bases[r["part"]], before = before, before + r["n"]
    base = docs.sparkSession.createDataFrame(sorted(bases.items()), "part int, part_base long")
    so_far = F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return made.join(base, "part").select(*made.columns, (F.col("part_base") + F.coalesce(so_far, F.lit(0))).alias("base"))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the shards in ``manifest``: doc_id, start, n_tokens, ids_crc32, all from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                store, file = open_fs(path)
                with store.open_input_file(file) as f:
                    s = Shard(f)
                    who = [None if x else int(d) for d, x in zip(s.doc_ids, s.null, strict=True)]
                    crc = np.zeros(s.n_docs, np.int64)
                    k = 0  # documents in order, each stretch of blocks read and unpacked once
                    while k < s.n_docs:
                        first = int(s.ends[k] - s.sizes[k])
                        last = max(k + 1, int(np.searchsorted(s.ends, first + SHARD_IDS, side="right")))
                        ids = s.ids(first, int(s.ends[last - 1]) - first).astype("<u4", copy=False)
                        for j in range(k, last):
                            crc[j] = zlib.crc32(ids[s.ends[j] - s.sizes[j] - first : s.ends[j] - first])
                        k = last
                    crc = crc.tolist()
                    yield table_batch(ROWS, doc_id=who, start=(base + s.ends - s.sizes).tolist(), n_tokens=s.sizes.tolist(), ids_crc32=crc)

    # a number given keeps adaptive execution from reading all shards in one task, as their paths are small
    tasks = min(max(1, manifest.count()), 4 * manifest.sparkSession.sparkContext.defaultParallelism)
    return manifest.select("path", "base").repartition(tasks, "path").mapInArrow(tidy(run), ROWS)


def token_file_rows(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the corpus to a fresh folder under spark.checkpoint.dir and read it back.

    Null and empty texts hold the end id alone. Rows of one id stand together, ordered by a hash of their text and then by it; a
    null id comes first. Extra
    columns are not stored. An empty table writes no file and gives no row.
    """
    return read_token_files(write_token_files(docs, path, shared_folder(docs.sparkSession, "tokens"), end_id, id_col, text_col))

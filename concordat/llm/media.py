"""Media columns: payloads cut into content-defined chunks that are stored once.

A rolling gear hash over 32 bytes cuts a payload where its low bits are zero, so equal stretches of different payloads give
equal chunks. Each chunk is stored as a zstandard frame of its own, so its stored bytes depend on the chunk alone. Every map
task writes its own frames to one pack file and lists them; a Spark join on the SHA-256 digests picks one place for each chunk,
a second job moves what is wanted of packs that are mostly copies, and each document keeps an ordered list of digests.

A document's stored form is its chunk list and its chunks' frames, in order; frames that documents share lie on disk once.
Reading takes the frames from the packs by byte range, hashes them as the stored form, decodes them, verifies every digest, and
joins the payload up. Chunk bytes never pass through a shuffle; only digests and places do.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drop, open_fs, shared_folder, table_batch, tidy, written

SAMPLE_BLOCK, FILL = 576, b"\xff"
LEAST, MOST, MASK = 512, 16384, np.uint32((1 << 11) - 1 << 21)
WINDOW, SEED = 32, 8
#: Bytes of a pack that a reader fetches at once, windows and open files that it keeps.
BLOCK, KEPT, LEVEL = 1 << 18, 24, 9
#: The wanted share of a pack's bytes below which it is written anew.
SPARSE = 0.5
GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)
MAGIC = b"CMED"
PLACE = [T.StructField("pack", T.StringType()), T.StructField("at", T.LongType()), T.StructField("held", T.LongType())]
LISTED = T.StructType([T.StructField("home", T.LongType()), T.StructField("row", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("n_chunks", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("size", T.LongType()), *PLACE])
MOVED = T.StructType([T.StructField("digest", T.BinaryType()), *PLACE])
ROWS = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_bytes", "payload_bytes")), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("n_chunks", T.LongType())])


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "replace")
    return raw + FILL * (max(1, -(-len(raw) // SAMPLE_BLOCK)) * SAMPLE_BLOCK - len(raw)), len(raw)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks. They depend on the bytes since the chunk's start only: no cut lies closer than the window."""
    n, marks = len(data), []
    for k in range(0, n, 1 << 20):
        lead = min(k, WINDOW - 1)
        h = GEAR[np.frombuffer(data, np.uint8, min(n, k + (1 << 20)) - k + lead, k - lead)]
        width = 1
        while width < WINDOW:  # the hash of 2w bytes is that of w bytes plus that of the w before, shifted
            h[width:] += h[:-width] << np.uint32(width)
            width *= 2
        marks.append(np.flatnonzero((h[lead:] & MASK) == 0) + (k + 1))
    marks = np.concatenate(marks) if marks else np.zeros(0, np.int64)
    out, at = [], 0
    while at < n:
        i = int(np.searchsorted(marks, at + LEAST))
        end = int(marks[i]) if i < len(marks) else n
        at = min(end, at + MOST, n)
        out.append(at)
    return out


class PackWriter:
    """Frames one after another."""

    def __init__(self, folder: str, name: str):
        self.store, top = open_fs(folder)
        self.path = f"{folder}/{name}"
        self.file = self.store.open_output_stream(f"{top}/{name}", buffer_size=BLOCK)
        self.written = 0

    def add(self, frame: bytes) -> dict:
        """The frame's place."""
        place = {"pack": self.path, "at": self.written, "held": len(frame)}
        self.file.write(frame)
        self.written += len(frame)
        return place

    def close(self) -> None:
        self.file.close()


class PackReader:
    """Frames by place. A few windows of the packs and open files stay at hand."""

    def __init__(self):
        self.windows: OrderedDict = OrderedDict()
        self.files: OrderedDict = OrderedDict()

    def window(self, pack: str, k: int) -> bytes:
        found = self.windows.get((pack, k))
        if found is None:
            if pack not in self.files:
                store, path = open_fs(pack)
                self.files[pack] = store.open_input_file(path)
                if len(self.files) > KEPT:
                    self.files.popitem(last=False)[1].close()
            found = self.windows[pack, k] = self.files[pack].read_at(BLOCK, k * BLOCK)
            if len(self.windows) > KEPT:
                self.windows.popitem(last=False)
        else:
            self.windows.move_to_end((pack, k))
        return found

    def read(self, pack: str, at: int, held: int) -> bytes:
        first, last = at // BLOCK, (at + held - 1) // BLOCK
        whole = self.window(pack, first) if first == last else b"".join([self.window(pack, k) for k in range(first, last + 1)])
        return whole[at - first * BLOCK : at - first * BLOCK + held]


def decoded(unzip, frame: bytes, digest: bytes) -> bytes:
    chunk = unzip.decompress(frame)
    if hashlib.sha256(chunk).digest() != digest:
        raise ValueError("a stored chunk doesn't match its digest")
    return chunk


def list_chunks(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First job: cut every payload; write a task's distinct chunks to a raw pack; list (document, position, digest, place)."""
    bounded_batches(docs.sparkSession)
    store, root = open_fs(folder)
    store.create_dir(f"{root}/raw", recursive=True)
    store.create_dir(f"{root}/packs", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task, zip_ = TaskContext.get(), zstandard.ZstdCompressor(level=LEVEL)
        pack, rows, row = None, [], 0
        known: dict[bytes, dict] = {}
        for batch in batches:
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, n = payload_of(text)
                ends = cuts(data)
                for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                    chunk = data[a:b]
                    digest = hashlib.sha256(chunk).digest()
                    place = known.get(digest)
                    if place is None:
                        pack = pack or PackWriter(f"{folder}/raw", f"{task.partitionId():06d}-{task.taskAttemptId()}.pack")
                        place = known[digest] = pack.add(zip_.compress(chunk))
                        if len(known) > 200_000:  # a digest seen longer ago is stored again here; the join removes it
                            known = {digest: place}
                    rows.append((task.partitionId(), row, d, n, k, len(ends), digest, b - a, place))
                row += 1
            if len(rows) >= 4000:
                yield listed(rows)
                rows = []
        if pack is not None:
            pack.close()
        if rows:
            yield listed(rows)

    def listed(rows: list) -> pa.RecordBatch:
        cols = dict(zip([f.name for f in LISTED.fields[:8]], zip(*(r[:8] for r in rows), strict=True), strict=True))
        return table_batch(LISTED, **cols, **{f.name: [r[8][f.name] for r in rows] for f in PLACE})

    return written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), LISTED), f"{folder}/listed")


def store_chunks(listed: DataFrame, folder: str) -> DataFrame:
    """Second job: one place per digest. Packs of which less than SPARSE is wanted are written anew and go; the others stay as they
    are, so that no second copy of everything ever lies on disk. Returns digest and place."""
    place = F.struct("pack", "at", "held")
    chosen = written(listed.groupBy("digest").agg(F.min(place).alias("p")).select("digest", "p.*"), f"{folder}/chosen")
    whole = listed.groupBy("pack").agg(F.max(F.col("at") + F.col("held")).alias("total"))
    wanted = chosen.groupBy("pack").agg(F.sum("held").alias("wanted"))
    sparse = written(whole.join(wanted, "pack", "left").where(F.coalesce("wanted", F.lit(0)) < SPARSE * F.col("total")).select("pack"), f"{folder}/sparse")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task, reader, unzip, pack, rows = TaskContext.get(), PackReader(), zstandard.ZstdDecompressor(), None, []

        def moved() -> pa.RecordBatch:
            return table_batch(MOVED, digest=[r[0] for r in rows], **{f.name: [r[1][f.name] for r in rows] for f in PLACE})

        for batch in batches:
            for digest, *where in zip(*(batch.column(c).to_pylist() for c in ("digest", "pack", "at", "held")), strict=True):
                frame = reader.read(*where)
                decoded(unzip, frame, digest)
                pack = pack or PackWriter(f"{folder}/packs", f"{task.partitionId():06d}-{task.taskAttemptId()}.pack")
                rows.append((digest, pack.add(frame)))
            if len(rows) >= 4000:
                yield moved()
                rows = []
        if pack is not None:
            pack.close()
        if rows:
            yield moved()

    moving = chosen.join(sparse, "pack", "left_semi").select("digest", "pack", "at", "held").repartition("pack").sortWithinPartitions("pack", "at").mapInArrow(tidy(run), MOVED)
    final = written(chosen.join(sparse, "pack", "left_anti").select(*MOVED.names).unionByName(moving), f"{folder}/stored")
    for row in sparse.toLocalIterator():  # one row per pack, that is per map task, at most
        store, path = open_fs(row["pack"])
        store.delete_file(path)
    drop(f"{folder}/chosen", f"{folder}/sparse")
    return final


def stored_form(n_bytes: int, digests: list[bytes], sizes: list[int], frames: list[bytes]) -> bytes:
    """One document's stored form: magic, payload length, the ordered chunk list (digest, size, stored size), the frames."""
    head = MAGIC + struct.pack("<QI", n_bytes, len(digests))
    return head + b"".join(d + struct.pack("<II", s, len(f)) for d, s, f in zip(digests, sizes, frames, strict=True)) + b"".join(frames)


def parse_form(form: bytes) -> bytes:
    """The payload of a stored form, verified."""
    import zstandard

    n, count = struct.unpack("<QI", form[4:16])
    unzip, at, out = zstandard.ZstdDecompressor(), 16 + 40 * count, []
    for k in range(count):
        digest, (_, held) = form[16 + 40 * k : 48 + 40 * k], struct.unpack("<II", form[48 + 40 * k : 56 + 40 * k])
        out.append(decoded(unzip, form[at : at + held], digest))
        at += held
    payload = b"".join(out)
    if form[:4] != MAGIC or len(payload) != n or at != len(form):
        raise ValueError("no stored form")
    return payload


def features(payload: bytes, n_chunks: int) -> str:
    s = np.frombuffer(payload, np.uint8)
    hist = np.bincount(s, minlength=256)
    total, square = int(hist @ np.arange(256)), int(hist @ (np.arange(256) ** 2))
    n = len(s)
    mean = total * 1000 // n
    power = (square * 1000) // n
    changes = int(((s[1:] ^ s[:-1]) & 0x80 != 0).sum())
    return f"chunks={n_chunks};mean_milli={mean};power_milli={power};peak={int(hist.argmax())};high_bit_changes={changes}"


def read_media(listed: DataFrame, stored: DataFrame) -> DataFrame:
    """Third job: each document's frames, in order, from the final packs; digests and features of what was read.

    A digest that very many documents share makes one large join partition; adaptive execution splits it, since the other side
    has one row per digest and nothing after the join needs its partitioning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        reader, unzip, now, parts, out = PackReader(), zstandard.ZstdDecompressor(), None, [], []
        names = ("home", "row", "doc_id", "n_bytes", "n_chunks", "digest", "pack", "at", "held")

        def done() -> None:
            _, _, d, n, count = now
            digests, frames = [x[0] for x in parts], [x[1] for x in parts]
            if len(parts) != count:
                raise ValueError("a chunk list is incomplete")
            chunks = [decoded(unzip, f, x) for x, f in parts]
            payload = b"".join(chunks)
            form = stored_form(len(payload), digests, [len(c) for c in chunks], frames)
            out.append((d, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(form), hashlib.sha256(form).hexdigest(), features(payload, count), count))

        for batch in batches:
            for home, row, d, n, count, digest, *where in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if now is not None and now[:2] != (home, row):
                    done()
                    parts = []
                now = (home, row, d, n, count)
                parts.append((digest, reader.read(*where)))
            if len(out) >= 500:
                yield table_batch(ROWS, **dict(zip(ROWS.names, zip(*out, strict=True), strict=True)))
                out = []
        if now is not None:
            done()
        if out:
            yield table_batch(ROWS, **dict(zip(ROWS.names, zip(*out, strict=True), strict=True)))

    where = listed.select("home", "row", "doc_id", "n_bytes", "seq", "n_chunks", "digest").join(stored, "digest")
    # documents of one input partition stay near each other, as their chunks do in the packs; blocks of 256 rows spread a large one
    near = where.repartition("home", (F.col("row") / 256).cast("long"))
    return near.sortWithinPartitions("home", "row", "seq").mapInArrow(tidy(run), ROWS)


def media_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the texts of ``docs`` as payloads under spark.checkpoint.dir, read them back: one row per document.

    Null and empty texts give one block of fill bytes. Equal texts share all chunks and give equal values. Repeated rows stay
    apart (they are told apart by input partition and position). Extra columns are not stored. An empty table stores nothing.
    """
    folder = shared_folder(docs.sparkSession, "media")
    listed = list_chunks(docs, folder, id_col, text_col)
    return read_media(listed, store_chunks(listed, folder))

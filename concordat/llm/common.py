"""Helpers shared by the operators: batch bounds, the shared folder, Arrow UDF plumbing, the chunk cache."""

from __future__ import annotations

import ctypes
import gc
import re
import time
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from ..storage import drop, fresh, open_fs, shared_folder, written  # noqa: F401  (the operators take them from here)

#: Rows and bytes that cross to a Python worker at once; long texts make a batch close early.
BATCH_ROWS, BATCH_BYTES = 10_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts (a smaller setting of the caller stays); send the code along."""
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key) or "")
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def map_text(fn: Callable[[list], pa.StructArray], kind: T.StructType, *columns: Column) -> Column:
    """A struct column made from whole batches: fn gets one Python list per column."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        release_idle()
        for arrays in batches:
            yield fn(*(a.to_pylist() for a in arrays))
        give_back()

    def run_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release_idle()
        for a in batches:
            yield fn(a.to_pylist())
        give_back()

    return F.arrow_udf(run if len(columns) > 1 else run_one, kind)(*columns)


def structs(kind: T.StructType, **arrays) -> pa.StructArray:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in kind.fields]
    return pa.StructArray.from_arrays([pa.array(arrays[f.name], type=k) for f, k in zip(kind.fields, kinds, strict=True)], names=kind.names)


def table_batch(kind: T.StructType, **arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_struct_array(structs(kind, **arrays))


_STATES: dict[tuple, list] = {}
#: Seconds after which a worker's large state may go when another operator needs its memory.
IDLE = 2.0


def release_idle() -> None:
    """Drop what other operators keep in this worker, once they have not used it for a while; give the memory back."""
    now = time.monotonic()
    idle = [k for k, (_, used) in _STATES.items() if now - used > IDLE]
    for k in idle:
        del _STATES[k]
    if idle:
        gc.collect()
    give_back()


def give_back() -> None:
    """Freed memory goes back to the system, for the other workers of this executor."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def tidy(run: Callable) -> Callable:
    """run(batches), with idle state dropped before and freed memory given back after."""

    def tidied(batches):
        release_idle()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def kept_state(make: Callable, *key):
    """make(*key), kept in this worker for the tasks to come."""
    found = _STATES.get((make, *key))
    if found is None:
        release_idle()
        found = _STATES[(make, *key)] = [make(*key), 0.0]
    found[1] = time.monotonic()
    return found[0]


class ChunkCache:
    """Results of a pure function of short strings, kept by worker processes across tasks.

    compute(strings) gives (values, sizes): all values one after another, and how many belong to each string. When ``limit``
    strings are held, the half that was asked for least goes, of equals the older; that costs time only.
    """

    def __init__(self, compute: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 600_000, dtype=np.uint32):
        self.compute, self.limit = compute, limit
        self.slot: dict[str, int] = {}
        self.flat, self.held = np.zeros(1024, dtype), 0  # arrays with room to grow; held: values in use
        self.first, self.size = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.asked = np.zeros(1024, np.uint16)  # calls that asked for a string, halved whenever strings go

    def _append(self, flat: np.ndarray, size: np.ndarray, at: int) -> None:
        while self.held + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(size) > len(self.size):
            self.first, self.size, self.asked = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.asked))
        self.flat[self.held : self.held + len(flat)] = flat
        self.size[at : at + len(size)] = size
        self.first[at : at + len(size)] = self.held + np.cumsum(size) - size
        self.held += len(flat)

    def lookup(self, chunks: list[str]) -> np.ndarray:
        """A slot for each chunk; it holds until the next call."""
        if len(self.slot) > self.limit:
            names, n = list(self.slot), len(self.slot)  # in the order of their slots
            keep = np.sort(np.argsort(self.asked[:n], kind="stable")[n // 2 :])
            names = [names[i] for i in keep.tolist()]
            flat, size, asked = ragged(self.flat, self.first[keep], self.size[keep]), self.size[keep], self.asked[keep] >> 1
            self.held = 0
            self._append(flat, size, 0)
            self.asked[:] = 0
            self.asked[: len(keep)] = asked
            self.slot = dict(zip(names, range(len(names)), strict=True))
        got = np.fromiter(map(self.slot.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(got < 0).tolist()
        if missing:
            new, at = list({chunks[i] for i in missing}), len(self.slot)
            self._append(*self.compute(new), at)
            self.slot.update(zip(new, range(at, at + len(new)), strict=True))
            got[missing] = [self.slot[chunks[i]] for i in missing]
        self.asked[got] = np.minimum(self.asked[got], 60_000) + 1
        return got

    def column(self, chunks: pa.StringArray) -> np.ndarray:
        """lookup() of an Arrow column, each distinct chunk once."""
        coded = chunks.dictionary_encode()
        return self.lookup(coded.dictionary.to_pylist())[coded.indices.to_numpy()]

    def split(self, texts: list[str]) -> list[np.ndarray]:
        """The values of each text of cut(), one array per text."""
        chunks, ends = cut(texts)
        slots = self.column(chunks)
        size = self.size[slots]
        found = ragged(self.flat, self.first[slots], size)
        return np.split(found, np.cumsum(size)[ends][:-1])

    def values(self, chunks: list[str]) -> np.ndarray:
        s = self.lookup(chunks)
        return ragged(self.flat, self.first[s], self.size[s])


def listed(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Values and sizes of a list of lists."""
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter(chain.from_iterable(rows), np.int64, int(size.sum())), size


def ragged(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices flat[first:first + size], one after another."""
    total = int(size.sum())
    if not total:
        return flat[:0]
    end = np.cumsum(size)
    return flat[np.arange(total) + np.repeat(first - (end - size), size)]


#: Stands after each text in cut(); texts that hold it, or white space other than tab to carriage return and space, can't be cut.
END = "\0"


def cut(texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
    """Chunks of all texts in turn, and the place of each text's end mark among them.

    Chunks are what `` ?\\S+|\\s+(?!\\S)|\\s+`` finds: runs without white space with the space before them, and white space.
    """
    data = (END.join(texts) + END).encode()
    byte = np.frombuffer(data, np.uint8)
    space, end = (byte == 32) | ((byte - np.uint8(9)) < 5), byte == 0
    after_space = np.concatenate([[False], space[:-1]])
    before_word = np.concatenate([~(space | end)[1:], [False]])
    start = end | (space & (~after_space | before_word))
    start[1:] |= end[:-1] | (after_space[1:] & ~space[1:] & (byte[:-1] != 32))
    start[0] = True
    at = np.flatnonzero(start)
    offsets = np.append(at, len(byte)).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)), np.flatnonzero(end[at])


def in_blocks(pattern, text: str, most: int = 1 << 20) -> Iterator[list[str]]:
    """findall() in lists of bounded length, so that a very long text needs no list of all its parts."""
    if len(text) <= most:
        yield pattern.findall(text)
        return
    part: list[str] = []
    for m in pattern.finditer(text):
        part.append(m[0])
        if len(part) >= most // 8:
            yield part
            part = []
    yield part

"""Near duplicates: an exact Jaccard join on word shingles, as a grouped prefix join.

A document's set holds 64-bit hashes of its distinct 5-word shingles. Shingles are ordered with the frequent ones last; two sets
that reach the threshold share a shingle within their prefixes. Documents whose prefix and size are identical make one group,
and only groups meet:

1. ``shingle_table``   text -> set size, set id, group id, prefix, parity sketch; identical sets count once from here on
2. first pairs         groups that stand near each other in the list of a prefix shingle (a few per group and shingle; of the
                       rare shingles, the first FIRST of each group that others share)
3. verify              the pairs' representatives, on their whole texts; connected components of what links
4. remaining pairs     groups that share a prefix shingle but lie in different components, filtered by size and by sketch
                       where they meet
5. expand and verify   all their members, and the members of one group among themselves; components again

Pairs within a component need no check, since only components are asked for: a group of thousands of near copies costs a few
pairs per copy, not all pairs, and no link between different components is missed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded_batches, drop, fresh, map_text, shared_folder, table_batch, tidy, written

WORDS, SEED = 5, 3
#: Frequent shingles that are put last in the order (8 bytes each in every task), how often a task must meet one to report it.
FREQUENT, REPORTED = 200_000, 2
SKETCH_BITS = 2048
#: Ids of documents whose texts are needed that are broadcast at most (8 bytes each).
BROADCAST_IDS = 500_000
SET = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set_id", T.BinaryType()), T.StructField("gid", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("rare", T.IntegerType()), T.StructField("sketch", T.BinaryType())])

U = np.uint64
MIX, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9)
GAP = np.zeros(256, bool)
GAP[[32, 9, 10, 11, 12, 13]] = True
GAPS, WORD = re.compile(rb"[\x20\x09-\x0D]"), re.compile(r"[^\x20\x09-\x0D]+")
#: Keeps the low k bytes of a 64-bit value.
LOW = np.asarray([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of text hashed at once; words longer than LONG are hashed one by one.
SLICE, LONG = 1 << 18, 256


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX2
    x = (x ^ (x >> U(27))) * MIX
    return x ^ (x >> U(31))


#: Odd weights of a shingle's words.
WEIGHT = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | U(1)


def slices(data: bytes) -> Iterator[bytes]:
    """A text in parts that end between words."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):
            gap = GAPS.search(data, end)
            end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def word_hashes(data: bytes) -> np.ndarray:
    """Two keyed 64-bit hashes per word of a text, A-Z lowered: shape (2, words).

    A word's eight-byte lanes go one after another through a mixing step that isn't linear, with all words at once.
    """
    out = []
    for part in slices(data.lower()):
        gap = GAP[np.frombuffer(part, np.uint8)]
        edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
        start, size = edge[0::2], edge[1::2] - edge[0::2]
        lanes = np.ndarray(len(part) + 1, "<u8", part + bytes(8), strides=(1,))
        h = mix(size.astype(np.uint64) * MIX + U(SEED))
        g = h * MIX2
        live, at, left = np.flatnonzero(size <= LONG), start, size
        at, left = start[live], size[live]
        while len(live):
            x = lanes[at] & LOW[np.minimum(left, 8)]
            h[live] = mix(h[live] ^ x)
            y = (g[live] + x) * MIX
            g[live] = y ^ (y >> U(29))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        for k in np.flatnonzero(size > LONG).tolist():
            both = hashlib.blake2b(part[start[k] : start[k] + size[k]], digest_size=16, key=SEED.to_bytes(8, "little")).digest()
            h[k], g[k] = np.frombuffer(both, np.uint64)
        out.append(np.stack([h, g]))
    return np.concatenate(out, 1) if out else np.zeros((2, 0), np.uint64)


def shingle_hashes(w: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a row of word hashes; with fewer words than WORDS, the whole sequence is one shingle."""
    if not len(w):
        return w
    k = min(WORDS, len(w))
    h = w[: len(w) - k + 1] * WEIGHT[0]
    for j in range(1, k):
        h += w[j : len(w) - k + 1 + j] * WEIGHT[j]
    h = np.sort(mix(h + U(k)))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def shingles(text: str | None) -> np.ndarray:
    return shingle_hashes(word_hashes((text or "").encode("utf-8", "replace"))[0])


def coded(texts: list[list[str]]) -> list[np.ndarray]:
    """Each word list's distinct shingles as numbers that are equal just where the words themselves are."""
    code: dict[str, int] = {}
    rows = [np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words)) for words in texts]
    sizes = [max(0, len(r) - min(WORDS, len(r)) + 1) if len(r) else 0 for r in rows]
    k = [min(WORDS, len(r)) for r in rows]
    out = []
    if len(code) < 1 << 12:  # five words fit one number; shorter sequences are negative
        for r, n, m in zip(rows, sizes, k, strict=True):
            h = r[:n].copy()
            for j in range(1, m):
                h = h << 12 | r[j : j + n]
            out.append(np.unique(h) if m == WORDS else -1 - (h * 8 + m))
        return out
    flat = [np.stack([r[j : j + n] for j in range(m)] + [np.full(n, -1)] * (WORDS - m), 1) for r, n, m in zip(rows, sizes, k, strict=True) if n]
    every = np.concatenate(flat) if flat else np.zeros((0, WORDS), np.int64)
    h = every[:, 0]
    for j in range(1, WORDS):  # pairs of numbers become numbers again
        h = np.unique((h << 31) + every[:, j] + 1, return_inverse=True)[1]
    at = 0
    for n in sizes:
        out.append(np.unique(h[at : at + n]))
        at += n
    return out


def words_link(a: list[str], b: list[str]) -> bool:
    """100 * intersection >= 75 * union of the shingle sets, on the words themselves."""
    x, y = coded([a, b])
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= 75 * (len(x) + len(y) - both)


def prefix_size(n: int) -> int:
    """Least shared shingles with any set that links: 3/4 of n, rounded up; one of the others must be in the prefix."""
    return n - -(-3 * n // 4) + 1


def frequent_shingles(docs: DataFrame, text_col: str, folder: str) -> np.ndarray:
    """The most frequent shingles, rarest first. They shape the order only: any order finds all links.

    Each task counts the shingles of all its texts and reports those met REPORTED times; Spark adds the reports up.
    """
    kind = T.StructType([T.StructField("h", T.LongType()), T.StructField("c", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[np.ndarray] = []
        size = 0

        def report() -> pa.RecordBatch:
            u, c = np.unique(np.concatenate(pending), return_counts=True)
            many = c >= REPORTED
            return table_batch(kind, h=u[many].view(np.int64).tolist(), c=c[many].tolist())

        for batch in batches:
            for text in batch.column(0).to_pylist():
                pending.append(shingles(text))
                size += len(pending[-1])
                if size > 2_000_000:
                    yield report()
                    pending, size = [], 0
        if pending:
            yield report()

    counts = written(docs.select(F.col(text_col)).mapInArrow(tidy(run), kind).groupBy("h").agg(F.sum("c").alias("c")), folder)
    # the least count that at most FREQUENT shingles reach, from a table of how many have each count
    w = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    least = counts.groupBy("c").agg(F.count("*").alias("n")).withColumn("n", F.sum("n").over(w)).where(F.col("n") <= FREQUENT).agg(F.min("c")).first()[0]
    top = counts.where(F.col("c") >= least).toArrow() if least is not None else None  # at most FREQUENT rows
    drop(folder)
    if top is None:
        return np.zeros(0, np.uint64)
    h, c = top.column("h").to_numpy(), top.column("c").to_numpy()
    return h[np.lexsort((h, c))].view(np.uint64)


def shingle_table(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, set_id (digest of the set), gid (hash of prefix and size), prefix and how many of it are not frequent, sketch;
    all from the whole text.

    A task gives the prefix of a group and the sketch of a set once only; further rows have null there. The sketch holds
    the parity of the shingles in each of its bins, so two sketches differ in no more bins than the sets differ in shingles.
    A set's digest is taken over two independent 64-bit hashes of its shingles.
    """
    frequent = frequent_shingles(docs, text_col, folder)
    order = np.argsort(frequent)
    known, rank = frequent[order], order.astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        drawn: set[bytes] = set()
        for batch in batches:
            cols: list[list] = [[] for _ in SET.names]
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = word_hashes((text or "").encode("utf-8", "replace"))
                s = shingle_hashes(w[0])
                n = len(s)
                row = [d, n, None, None, None, None, None]
                if n:
                    late = np.zeros(n, bool)
                    if len(known):
                        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                        late = known[at] == s
                    keep = prefix_size(n)
                    first = s[~late][:keep]
                    rare = len(first)
                    if len(first) < keep:
                        own = at[late]
                        first = np.concatenate([first, known[own[np.argsort(rank[own])]][: keep - len(first)]])
                    gid = int.from_bytes(hashlib.blake2b(n.to_bytes(8, "little") + np.sort(first).tobytes(), digest_size=8).digest(), "little", signed=True)
                    own_set = hashlib.blake2b(s.tobytes() + shingle_hashes(w[1]).tobytes(), digest_size=16).digest()
                    row[2:4] = own_set, gid
                    if gid not in given:
                        given.add(gid)
                        row[4:6] = first.view(np.int64), rare
                    if own_set not in drawn:
                        drawn.add(own_set)
                        bins = np.bincount((s >> U(20)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
                        row[6] = np.packbits(bins.astype(np.uint8)).tobytes()
                    if len(drawn) > 500_000:  # what was given longer ago is given again
                        given.clear()
                        drawn.clear()
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            yield table_batch(SET, **dict(zip(SET.names, cols, strict=True)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(tidy(run), SET)


NEAR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
LISTED = T.StructType([T.StructField("k", T.LongType()), T.StructField("m", T.LongType()), T.StructField("p", T.LongType())])
#: Rows that a task gathers from small batches before numpy works on them.
GATHER = 200_000
#: Rare shared shingles of a prefix, the first ones, whose lists give first pairs: groups that share one mostly share many, and
#: would be handed on at each. What meets only later is a remaining pair.
FIRST = 6


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Long columns (k, m, ...) as arrays of about GATHER rows; rows that repeat (k, m) (they come sorted) once."""
    parts, size, last = [], 0, None

    def flush() -> np.ndarray:
        nonlocal last
        x = np.concatenate(parts)
        new = np.concatenate([[last is None or (last != x[0, :2]).any()], (x[1:, :2] != x[:-1, :2]).any(1)])
        last = x[-1, :2]
        return x[new]

    for batch in batches:
        if batch.num_rows:
            parts.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
            size += batch.num_rows
            if size >= GATHER:
                yield flush()
                parts, size = [], 0
    if size:
        yield flush()


def shared_keys(rows: DataFrame) -> DataFrame:
    """The rows (k, m, p) whose key has at least two members, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)  # the last row, of which it isn't known yet whether another member follows
        given = False

        def batch_of(x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, c])) for c in range(3)], names=LISTED.names)

        for x in gathered(batches):
            x = np.concatenate([held, x])
            same = x[1:, 0] == x[:-1, 0]
            keep = np.concatenate([[given and len(held) > 0], same]) | np.concatenate([same, [False]])
            given, held = bool(keep[-1]), x[-1:]
            keep[-1] = False
            if keep.any():
                yield batch_of(x[keep])
        if given:
            yield batch_of(held)

    return rows.select("k", "m", "p").repartition("k").sortWithinPartitions("k", "m").mapInArrow(tidy(run), LISTED)


def first_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of members that stand 1, 2 or 4 places apart in a key's sorted list: a few per row, however long the list.

    rows: k, m, hot. A hot key's list is dealt to 64 sublists by the members' hash, so that no task holds it whole; the
    smallest members of the sublists are listed again by key. The same members are neighbours under every key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_k = tail_m = np.zeros(0, np.int64)
        for x in gathered(batches):
            k, m = np.ascontiguousarray(x.T)
            old = len(tail_k)
            k, m = np.concatenate([tail_k, k]), np.concatenate([tail_m, m])
            a, b = [], []
            for step in (1, 2, 4):
                if len(k) > step:
                    new = np.flatnonzero((k[step:] == k[:-step]) & (m[step:] != m[:-step]))
                    new = new[new + step >= old]
                    a.append(m[new])
                    b.append(m[new + step])
            tail_k, tail_m = k[-4:], m[-4:]
            if a:
                pairs = np.unique(np.sort(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], names=NEAR.names)

    salted = rows.select("k", "m", F.when(F.col("hot"), F.shiftright(F.xxhash64("m"), 58)).otherwise(F.lit(0).cast("long")).alias("s"), "hot")
    inner = salted.select("k", "s", "m").repartition("k", "s").sortWithinPartitions("k", "s", "m")
    # one key column for both parts: a key and its sublist hash to one long, whose rows stay together after the sort above
    inner = inner.select(F.xxhash64("k", "s").alias("k"), "m").mapInArrow(tidy(run), NEAR)
    heads = salted.where("hot").groupBy("k", "s").agg(F.min("m").alias("m"))
    outer = heads.select("k", "m").repartition("k").sortWithinPartitions("k", "m").mapInArrow(tidy(run), NEAR)
    return inner.unionByName(outer).distinct()


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node that links reach.

    Large-star and small-star rounds: each is two grouped minima over the edges. Every round is written to the shared folder;
    the rounds end when a round changes nothing.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/e0")
    k, before = 0, None
    while True:
        k += 1
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_low.select("a", F.col("m").alias("b")))
        e = written(small.where("a <> b").distinct(), f"{folder}/e{k}")
        drop(f"{folder}/e{k - 1}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now


def squeezed(text: Column) -> Column:
    """Texts as zstandard frames, since they are shuffled twice more."""
    import zstandard

    def run(texts: list):
        zip_ = zstandard.ZstdCompressor(level=6)
        return pa.array([zip_.compress((t or "").encode("utf-8", "replace")) for t in texts], pa.binary())

    return map_text(run, T.BinaryType(), text)


def linked(a: Column, b: Column) -> Column:
    """Do two squeezed texts link? The words are compared, not their hashes."""
    import zstandard

    def run(left: list, right: list):
        unzip = zstandard.ZstdDecompressor()
        of = lambda z: WORD.findall(unzip.decompress(z).lower().decode())
        out, last, one = [], None, None
        for x, y in zip(left, right, strict=True):
            if x != last:
                last, one = x, of(x)
            out.append(words_link(one, of(y)))
        return pa.array(out, pa.bool_())

    return map_text(run, T.BooleanType(), a, b)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of document ids of which a text links. texts: (id, t) of at least these documents, one or several an id."""
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    return two.where(linked(F.col("ta"), F.col("tb"))).select("a", "b").distinct()


def apart(x: Column, y: Column) -> Column:
    """Bins in which two sketches differ."""

    def run(left: list, right: list):
        a = np.frombuffer(b"".join(left), np.uint8).reshape(len(left), -1)
        b = np.frombuffer(b"".join(right), np.uint8).reshape(len(right), -1)
        return pa.array(np.unpackbits(a ^ b, axis=1).sum(1).astype(np.int64) if len(left) else [], pa.int64())

    return map_text(run, T.LongType(), x, y)


#: Members of one shingle's list that meet in one task at most twice over; 64-bit words of a folded sketch; first shingles of
#: its prefix that a row carries, so that most pairs are handed on at one shared shingle only.
LIST, FOLDED, EARLY = 2048, 8, 4
CROSS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("na", T.LongType()), T.StructField("nb", T.LongType())])


def folded(sketch: Column) -> Column:
    """A sketch in fewer bins: parities of bins that fall together add up."""

    def run(rows: list):
        x = np.frombuffer(b"".join(rows), np.uint64).reshape(len(rows), -1, FOLDED)
        return pa.array([r.tobytes() for r in np.bitwise_xor.reduce(x, axis=1)] if rows else [], pa.binary())

    return map_text(run, T.BinaryType(), sketch)


def cross_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) of groups in different components that share a shingle and that size and folded sketch let pass.

    rows: token, gid, root, tag, n, place (of the token in the prefix), e0.. (its first shingles), several (1 if the group holds
    several sets, of which s tells nothing), s, blocks. The pairs are compared where they meet and only those that pass are handed on.
    A long list is cut into blocks; each two blocks meet in a task of their own.
    """
    names = ("token", "bi", "bj", "block", "gid", "root", "tag", "n", "place", *(f"e{i}" for i in range(EARLY)), "several")

    def passing(g: np.ndarray, s: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """g: columns of names, in rows. Which of the pairs (i, j) pass?"""
        ni, nj = g[i, 7], g[j, 7]
        ok = ((g[i, 5] != g[j, 5]) | (g[i, 6] != g[j, 6])) & (4 * ni >= 3 * nj) & (4 * nj >= 3 * ni)
        # if this is the first shingle they share, they share no more than what stands from here on in either
        need = -(-3 * (ni + nj) // 7)
        k = np.flatnonzero(ok & (g[i, 8] <= ni - need) & (g[j, 8] <= nj - need))
        near = 7 * np.bitwise_count(s[i[k]] ^ s[j[k]]).sum(1, dtype=np.int64) <= ni[k] + nj[k]
        k = k[near | (g[i[k], -1] | g[j[k], -1]).astype(bool)]
        met = np.zeros(len(k), bool)  # at an earlier shingle
        for a in range(EARLY):
            for b in range(EARLY):
                met |= (g[i[k], 9 + a] == g[j[k], 9 + b]) & (a < g[i[k], 8]) & (b < g[j[k], 8])
        return k[~met]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_g, held_s, size = [], [], 0

        def work(last: bool):
            nonlocal held_g, held_s, size
            g, s = np.concatenate(held_g), np.concatenate(held_s)
            ends = np.append(np.flatnonzero((g[1:, :3] != g[:-1, :3]).any(1)) + 1, len(g))
            if not last:  # the last list may go on
                ends = ends[:-1]
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            out = []
            two = starts[ends - starts == 2]
            two = two[(g[two, 1] == g[two, 2]) | (g[two, 3] != g[two + 1, 3])]
            k = passing(g, s, two, two + 1)
            out.append(np.stack([two[k], two[k] + 1], 1))
            size_of = ends - starts
            for m in np.unique(size_of[(size_of > 2) & (size_of <= 64)]).tolist():  # lists of one length at once
                first = starts[size_of == m]
                u, v = np.triu_indices(m, 1)
                for k0 in range(0, len(first), max(1, 400_000 // len(u))):
                    f = first[k0 : k0 + max(1, 400_000 // len(u)), None]
                    i, j = (f + u).ravel(), (f + v).ravel()
                    k = np.flatnonzero((g[i, 1] == g[i, 2]) | (g[i, 3] != g[j, 3]))
                    i, j = i[k], j[k]
                    k = passing(g, s, i, j)
                    out.append(np.stack([i[k], j[k]], 1))
            for a, b in zip(starts[size_of > 64].tolist(), ends[size_of > 64].tolist(), strict=True):
                if (g[a:b, 5:7] == g[a, 5:7]).all():
                    continue
                same = g[a, 1] == g[a, 2]
                for i in range(a, b):
                    if same:
                        j = np.arange(i + 1, b)
                    elif g[i, 3] == g[i, 1]:
                        j = a + np.flatnonzero(g[a:b, 3] == g[i, 2])
                    else:
                        continue
                    k = passing(g, s, np.full(len(j), i), j)
                    if len(k):
                        out.append(np.stack([np.full(len(k), i), j[k]], 1))
            pairs = np.concatenate(out)
            x, y = g[pairs[:, 0]], g[pairs[:, 1]]
            turn = (x[:, 4] > y[:, 4])[:, None]
            x, y = np.where(turn, y, x), np.where(turn, x, y)
            done = np.unique(np.stack([x[:, 4], y[:, 4], x[:, 7], y[:, 7]], 1), axis=0)
            at = int(ends[-1]) if len(ends) else 0
            held_g, held_s, size = [g[at:]], [s[at:]], len(g) - at
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(done[:, c])) for c in range(4)], names=CROSS.names)

        for batch in batches:
            if batch.num_rows:
                held_g.append(np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1))
                held_s.append(np.frombuffer(b"".join(batch.column("s").to_pylist()), np.uint64).reshape(-1, FOLDED))
                size += batch.num_rows
                if size >= 4 * GATHER // 10 + 4 * LIST:
                    yield work(False)
        if size:
            yield work(True)

    block = F.pmod(F.xxhash64("gid"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = rows.withColumn("block", block).withColumn("_o", other)
    dealt = dealt.select("token", F.least("block", "_o").alias("bi"), F.greatest("block", "_o").alias("bj"), *names[3:], "s")
    return dealt.repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj").mapInArrow(tidy(run), CROSS).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, n_shingles, component_id (the smallest id that links reach).

    Null texts, empty texts and texts without words have no shingles and link with nothing; their component is their own id.
    Equal sets always link. An id is one document: repeated rows stay, each with the n_shingles of its own text, and rows that
    share an id share its component, to which every text of the id adds its links. Rows with a null id are left out. Extra
    columns are ignored, an empty table gives an empty one. Texts are whole, however long.
    """
    return joined(docs, shared_folder(docs.sparkSession, "near"), id_col, text_col)


def joined(docs: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """near_duplicates() with its tables in a folder; each goes when no later step reads it."""
    bounded_batches(docs.sparkSession)
    docs = docs.where(F.col(id_col).isNotNull())
    sets = written(shingle_table(docs, f"{folder}/counts", id_col, text_col), f"{folder}/sets")
    # one row per distinct set, one per group
    classes = sets.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("gid").alias("gid"), F.min("n").alias("n"))
    classes = written(classes, f"{folder}/classes")
    groups = written(classes.groupBy("gid").agg(F.min("rep").alias("head"), (F.count("*") > 1).alias("several"), F.min("n").alias("n")), f"{folder}/groups")
    tokens = sets.where("prefix is not null").select("gid", "rare", F.posexplode("prefix").alias("place", "token")).select(F.col("token").alias("k"), F.col("gid").alias("m"), F.col("place").cast("long").alias("p"), (F.col("place") >= F.col("rare")).alias("hot"))
    live = shared_keys(tokens.where("not hot")).withColumn("hot", F.lit(False)).unionByName(tokens.where("hot").select("k", "m", "p", "hot").distinct())
    live = written(live, f"{folder}/live")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))

    def text_of(pairs: DataFrame, name: str) -> DataFrame:
        """(id, t): every text of the ids in the pairs."""
        wanted = written(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), f"{folder}/{name}_wanted")
        if wanted.count() <= BROADCAST_IDS:  # else both sides are shuffled
            wanted = F.broadcast(wanted)
        return written(texts.join(wanted, "id", "left_semi").select("id", squeezed(F.col("t")).alias("t")).distinct(), f"{folder}/{name}")

    many = groups.where("several").select("gid")
    fits = "4 * na >= 3 * nb and 4 * nb >= 3 * na"
    size = lambda c: groups.select(F.col("gid").alias(c), F.col("n").alias(f"n{c}"))
    # sketches of the groups that share a token; of a group of several sets (of which it tells nothing) any one
    first = sets.where("prefix is not null").groupBy("gid").agg(F.min(F.slice("prefix", 1, EARLY)).alias("e"))
    drawn = sets.where("sketch is not null").groupBy("gid").agg(F.min("sketch").alias("s")).join(live.select(F.col("m").alias("gid")).distinct(), "gid", "left_semi")
    early = (F.coalesce(F.try_element_at("e", F.lit(i + 1)), F.xxhash64("gid", F.lit(i))).alias(f"e{i}") for i in range(EARLY))
    sketch = written(drawn.join(first, "gid").select("gid", "s", *early), f"{folder}/sketches")

    def near_sketches(df: DataFrame, drawn: DataFrame, key: str) -> DataFrame:
        """The pairs (a, b, na, nb) whose sketches are near enough for sets that link."""
        both = df.join(drawn.select(F.col(key).alias("a"), F.col("s").alias("sa")), "a").join(drawn.select(F.col(key).alias("b"), F.col("s").alias("sb")), "b")
        return both.where(7 * apart(F.col("sa"), F.col("sb")) <= F.col("na") + F.col("nb")).select("a", "b").distinct()

    def close(df: DataFrame) -> DataFrame:
        """Of group pairs (a, b, na, nb), those that may link. Groups of several sets pass; their members are tested one by one."""
        left = df.join(many.select(F.col("gid").alias("a")), "a", "left_semi").select("a", "b")
        right = df.join(many.select(F.col("gid").alias("b")), "b", "left_semi").select("a", "b")
        return near_sketches(df, sketch, "gid").unionByName(left).unionByName(right).distinct()

    # first pairs, of the groups' heads and of the members of a group
    rare = live.where("not hot").withColumn("_k", F.row_number().over(Window.partitionBy("m").orderBy("p"))).where(F.col("_k") <= FIRST).drop("_k")
    near = written(first_pairs(rare.unionByName(live.where("hot"))).join(size("a"), "a").join(size("b"), "b").where(fits), f"{folder}/near")
    head = lambda c: groups.select(F.col("gid").alias(c), F.col("head").alias(f"h{c}"))
    heads = close(near).join(head("a"), "a").join(head("b"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    crowded = classes.join(many, "gid", "left_semi").select(F.col("gid").alias("k"), F.col("rep").alias("m"), F.lit(True).alias("hot"))
    inside = first_pairs(crowded)
    pairs = heads.unionByName(inside).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = written(pairs, f"{folder}/first")
    drop(f"{folder}/near")
    links = written(verified(pairs, text_of(pairs, "first_texts")), f"{folder}/first_links")
    drop(f"{folder}/first_texts", f"{folder}/first_texts_wanted")
    # rows that share an id share its node, with every set they hold
    twofold = sets.where("n > 0").groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x <> y").select("doc_id")
    same_id = sets.where("n > 0").join(twofold, "doc_id", "left_semi").join(classes, "set_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links.unionByName(same_id), f"{folder}/first_roots")
    # (rep, gid) is one row per distinct set, unless one id is the smallest of several
    root_of = written(classes.select("rep", "gid", "n").join(roots, classes.rep == roots.node, "left").select("rep", "gid", "n", F.coalesce("root", "rep").alias("root")), f"{folder}/root_of")
    drop(f"{folder}/first_roots", f"{folder}/first_links")

    # remaining pairs: groups of different components that share a prefix shingle
    # (tag tells a group whose members lie in several components from any other)
    spread = root_of.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("n"), F.count("*").alias("c"), (F.count("*") > 1).cast("long").alias("several"))
    placed = live.select(F.col("k").alias("token"), F.col("m").alias("gid"), F.col("p").alias("place")).join(spread.drop("c"), "gid").select("token", "gid", "place", F.col("lo").alias("root"), F.when(F.col("lo") == F.col("hi"), F.lit(0).cast("long")).otherwise(F.col("gid")).alias("tag"), "n", "several")
    open_tokens = placed.groupBy("token").agg(F.min(F.struct("root", "tag")).alias("x"), F.max(F.struct("root", "tag")).alias("y"), F.count("*").alias("c")).where("x <> y")
    placed = written(placed.join(open_tokens.select("token", F.ceil(F.col("c") / LIST).alias("blocks")), "token"), f"{folder}/placed")
    drop(f"{folder}/live")
    cross = written(cross_pairs(placed.join(sketch.select("gid", *(f"e{i}" for i in range(EARLY)), folded(F.col("s")).alias("s")), "gid")), f"{folder}/cross")
    drop(f"{folder}/placed")
    met = written(close(cross), f"{folder}/met")
    drop(f"{folder}/cross", f"{folder}/sketches")
    # members of the group pairs, and of one group among themselves, each by the sketch of its own set
    member = lambda c: root_of.select(F.col("gid").alias(c), F.col("rep").alias(f"r{c}"), F.col("root").alias(f"t{c}"), F.col("n").alias(f"n{c}"))
    expanded = met.join(member("a"), "a").join(member("b"), "b").where("ta <> tb").select(F.col("ra").alias("a"), F.col("rb").alias("b"), "na", "nb")
    torn = spread.where("lo < hi").select("gid", "c")
    set_sketch = sets.where("sketch is not null").groupBy("set_id").agg(F.min("sketch").alias("s")).join(classes, "set_id").select("rep", "gid", "s")
    own = root_of.join(torn, "gid").join(set_sketch.join(torn, "gid", "left_semi").select("rep", "gid", "s"), ["rep", "gid"])
    own = own.select(F.col("gid").alias("token"), F.col("rep").alias("gid"), F.lit(0).cast("long").alias("place"), "root", F.lit(0).cast("long").alias("tag"), "n", *(F.xxhash64("rep", "gid", F.lit(i)).alias(f"e{i}") for i in range(EARLY)), F.lit(0).cast("long").alias("several"), folded(F.col("s")).alias("s"), F.ceil(F.col("c") / LIST).alias("blocks"))
    within = cross_pairs(own).select("a", "b", "na", "nb")
    rest = expanded.unionByName(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "na", "nb").distinct()
    rest = written(rest.join(pairs, ["a", "b"], "left_anti"), f"{folder}/rest")
    unlike = written(near_sketches(rest, set_sketch, "rep"), f"{folder}/unlike")
    more = written(verified(unlike, text_of(unlike, "rest_texts")), f"{folder}/more")
    drop(*(f"{folder}/{x}" for x in ("rest", "unlike", "rest_texts", "rest_texts_wanted", "met", "first")))
    ties = root_of.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    final = components(ties.unionByName(more).unionByName(same_id), f"{folder}/roots")

    whole = classes.select("set_id", "rep").join(final, classes.rep == final.node, "left").select("set_id", F.coalesce("root", "rep").alias("component_id"))
    done = written(sets.select("doc_id", "n", "set_id").join(whole, "set_id", "left").drop("set_id"), f"{folder}/done")
    drop(*(f"{folder}/{x}" for x in ("sets", "classes", "groups", "root_of", "more", "roots")))
    return done.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id. Columns stay, whatever their names.

    An id whose rows are repeated keeps one of equal rows; rows of one id that differ in text are one document with several
    texts and all stay. Rows with a null id belong to no component and stay, as do documents without words. An empty table
    gives an empty one.
    """
    folder = shared_folder(docs.sparkSession, "near")
    found = joined(docs, folder, id_col, text_col)
    kept_id = fresh("keep", docs)
    heads = found.groupBy(id_col).agg(F.min("component_id").alias("c"), F.count("*").alias("rows")).where(F.col(id_col) == F.col("c")).select(F.col(id_col).alias(kept_id), "rows")
    heads = written(heads, f"{folder}/heads")
    few = heads.count() <= BROADCAST_IDS  # else both sides are shuffled

    def chosen(ids: DataFrame) -> DataFrame:
        ids = ids.select(kept_id)
        return docs.join(F.broadcast(ids) if few else ids, F.col(id_col) == F.col(kept_id), "left_semi")

    once, more = chosen(heads.where("rows = 1")), chosen(heads.where("rows > 1")).dropDuplicates([id_col, text_col])
    return once.unionByName(more).unionByName(docs.where(F.col(id_col).isNull()))

"""Approximate nearest neighbours by largest inner product, with an inverted multi-index.

The two halves of a vector are quantised apart, by k-means on a bounded sample; a vector's cell is the pair of its halves'
centroids. A query walks the cells with a heap by the sum of its halves' distances to the two centroids, until the cells it
has passed hold enough vectors. Every vector is indexed. Cells lie in blocks in their order; a query is sent once to each block that
holds a cell of its walk, and to no other. Within a cell the queries meet all its vectors in a matrix product in
double precision on the original components, cell by cell and block by block, and each block hands on its best few.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import bounded_batches, map_text, shared_folder, table_batch, written

#: Rows that train the centroids, k-means rounds; queries that calibrate the walk, the share of their true neighbours it must
#: reach; vectors of a block, which meet queries together; pairs a task holds before it keeps the best only.
SAMPLE, ROUNDS, TRIALS, REACH, BLOCK, PENDING, SEED = 20_000, 15, 100, 0.97, 4096, 1 << 20, 6
#: Centroids per half: as many as give cells of PER_CELL vectors, between these two. The most bounds the driver's list of cells.
LEAST, MOST, PER_CELL = 16, 256, 50


def centroids_for(total: int) -> int:
    return int(min(MOST, max(LEAST, round((total / PER_CELL) ** 0.5))))


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ starts, then Lloyd's rounds; empty clusters keep their centre."""
    centers = [x[rng.integers(len(x))]]
    d = ((x - centers[0]) ** 2).sum(1)
    for _ in range(min(k, len(x)) - 1):
        if not d.sum():
            break
        centers.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, ((x - centers[-1]) ** 2).sum(1))
    c = np.stack(centers)
    for _ in range(ROUNDS):
        own = nearest_center(x, c)
        n = np.bincount(own, minlength=len(c))
        for j in range(x.shape[1]):
            s = np.bincount(own, x[:, j], len(c))
            c[n > 0, j] = s[n > 0] / n[n > 0]
    return c


def nearest_center(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)


def cells_in_order(q: np.ndarray, halves: tuple[np.ndarray, np.ndarray], held: dict[int, int], need: int) -> list[int]:
    """Cells by ascending summed distance until those passed hold ``need`` vectors (or all cells that hold any are passed)."""
    cut = len(q) // 2
    order, dist = [], []
    for part, c in zip((q[:cut], q[cut:]), halves, strict=True):
        d = -(c @ part)  # the larger the inner product the nearer
        o = np.argsort(d, kind="stable")
        order.append(o)
        dist.append(d[o])
    width, out, got, left = len(halves[1]), [], 0, len(held)
    heap, seen = [(dist[0][0] + dist[1][0], 0, 0)], {(0, 0)}
    while heap and got < need and left:
        _, i, j = heapq.heappop(heap)
        cell = int(order[0][i]) * width + int(order[1][j])
        if n := held.get(cell):
            out.append(cell)
            got, left = got + n, left - 1
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(order[0]) and b < width and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (dist[0][a] + dist[1][b], a, b))
    return out


def top(rows: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among (query, id, score): largest score, then smallest id."""
    q, ids, s = rows
    o = np.lexsort((ids, -s, q))
    q, ids, s = q[o], ids[o], s[o]
    start = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    keep = place < k
    return q[keep], ids[keep], s[keep]


class Best:
    """The k best candidates of each query that a task has met."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, ids: np.ndarray, m: np.ndarray, qids: np.ndarray, qs: np.ndarray) -> None:
        """ids ascending, so a stable sort breaks ties by id."""
        for a in range(0, len(qids), 128):
            own = qids[a : a + 128]
            s = qs[a : a + 128] @ m.T
            s[own[:, None] == ids[None, :]] = -np.inf
            o = np.argsort(-s, axis=1, kind="stable")[:, : self.k]
            best = np.take_along_axis(s, o, 1)
            ok = best > -np.inf
            self.parts.append((np.repeat(own, o.shape[1])[ok.ravel()], ids[o][ok], best[ok]))
            self.size += len(self.parts[-1][0])
            if self.size > PENDING:
                self.parts = [self.rows()]
                self.size = min(len(self.parts[0][0]), PENDING // 2)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return top(tuple(np.concatenate([p[i] for p in self.parts]) for i in range(3)), self.k) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


PAIR = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def best_of(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(base: DataFrame, qids: np.ndarray, qs: np.ndarray, k: int) -> DataFrame:
    """The true neighbours of a bounded set of queries, by brute force over all rows of (vec_id, v)."""
    dims = qs.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            if batch.num_rows:
                ids, first = np.unique(np.asarray(batch.column(0).to_pylist()), return_index=True)
                best.add(ids, matrix(batch.column(1), dims)[first], qids, qs)
        q, i, s = best.rows()
        yield table_batch(PAIR, query_id=q.tolist(), vec_id=i.tolist(), score=s.tolist())

    return best_of(base.select("vec_id", "v").mapInArrow(run, PAIR).dropDuplicates(["query_id", "vec_id"]), k)


def blocks_of(sizes: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """(first block, number of blocks) of each cell. Cells lie in order, so those of one centroid are neighbours: small ones fill
    a block together, one of more than BLOCK vectors has blocks of its own. Vectors of other widths (negative cells) share none."""
    first, parts, block, held = {}, {}, 0, 0
    for cell in sorted(sizes):
        n = sizes[cell]
        if held and (held + n > BLOCK or cell < 0 or n > BLOCK):
            block, held = block + 1, 0
        first[cell], parts[cell] = block, -(-n // BLOCK)
        if n > BLOCK or cell < 0:
            block, held = block + parts[cell], 0
        else:
            held += n
    return first, parts


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, reach: float = REACH, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``, its k nearest among all other rows.

    How many vectors a walk must pass is measured, not guessed: for TRIALS queries the true neighbours are found by brute
    force, and the walk is made just long enough to pass the share ``reach`` of them. On data without structure that is most
    of the index; on clustered data it is little.

    Rows with a null id, or a vector that is null, empty, zero, or has a null or non-finite component, take no part. An inner
    product needs equal widths: vectors of the most frequent width (of two, the larger) are indexed, those of any other width
    meet all vectors of their own width, each width as one cell. A row is its id: of repeated rows with one id, none is its own
    neighbour, and others meet the largest of its vectors, which also asks. Fewer than k candidates: all of them. Ties go to
    the smaller id. Extra columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    base = base.groupBy("vec_id").agg(F.max("v").alias("v"))
    widths = {r["d"]: r["n"] for r in base.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    none = "query_id long, rank int, vec_id long, score double"
    if not widths:
        return spark.createDataFrame([], none)
    dims = max(widths, key=lambda d: (widths[d], d))
    total = widths[dims]
    wide = base.where(F.size("v") == dims)
    # bounded samples, chosen by a hash of the id, so alike at every run
    chance = F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 30))
    few = lambda rows, n: rows.where(chance < min(1 << 30, int(2 * n / total * (1 << 30)) + 64)).orderBy(chance, "vec_id").limit(n).collect()
    x = np.asarray([r["v"] for r in few(wide, SAMPLE)] or [wide.first()["v"]], np.float64)
    rng, cut = np.random.default_rng(SEED), dims // 2
    halves = tuple(kmeans(h, centroids_for(total), rng) if h.shape[1] else np.zeros((1, 0)) for h in (x[:, :cut], x[:, cut:]))
    width = len(halves[1])

    def cells(a: np.ndarray) -> np.ndarray:
        return nearest_center(a[:, :cut], halves[0]) * width + nearest_center(a[:, cut:], halves[1])

    def cell_of(rows: list):
        out = np.asarray([-len(r) for r in rows], np.int64)
        own = np.flatnonzero(out == -dims)
        if len(own):
            out[own] = cells(np.asarray([rows[i] for i in own.tolist()], np.float64))
        return pa.array(out, pa.int32())

    indexed = written(base.withColumn("cell", map_text(cell_of, T.IntegerType(), F.col("v"))), shared_folder(spark, "index"))
    counts = indexed.groupBy("cell").agg(F.count("*").alias("n"))
    held = {r["cell"]: r["n"] for r in counts.where("cell >= 0").collect()}  # at most MOST^2 rows

    queries = indexed.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    trials = {r["vec_id"]: r["v"] for r in queries.where(F.size("v") == dims).orderBy(chance, "vec_id").limit(TRIALS).collect()}  # all, if there are fewer
    passed, reached = {}, []
    if trials:
        true = exact(indexed.where("cell >= 0"), np.asarray(sorted(trials)), np.asarray([trials[q] for q in sorted(trials)], np.float64), k)
        near = true.join(indexed.select("vec_id", "cell"), "vec_id").select("query_id", "cell").collect()  # TRIALS * k rows
        for q, v in trials.items():
            order = cells_in_order(np.asarray(v, np.float64), halves, held, total + 1)
            passed[q] = dict(zip(order, np.cumsum([held[c] for c in order]).tolist(), strict=True))
        reached = sorted(passed[r["query_id"]][r["cell"]] for r in near)
    need = reached[min(len(reached) - 1, int(reach * len(reached)))] if reached else 1

    first, parts = blocks_of(held | {-d: n for d, n in widths.items() if d != dims})

    def blocks_asked(rows: list):
        """Per query the blocks that hold a cell of its walk, each with those cells."""
        out = []
        for r in rows:
            by_block: dict[int, list[int]] = {}
            for c in cells_in_order(np.asarray(r, np.float64), halves, held, need) if len(r) == dims else [-len(r)]:
                for b in range(first[c], first[c] + parts[c]):
                    by_block.setdefault(b, []).append(c)
            out.append([{"block": b, "cells": c} for b, c in by_block.items()])
        return pa.array(out, pa.list_(pa.struct([("block", pa.int32()), ("cells", pa.list_(pa.int32()))])))

    def block_of(cells: list, part: list):
        return pa.array([first[c] + p % parts[c] for c, p in zip(cells, part, strict=True)], pa.int32())

    asked_kind = T.ArrayType(T.StructType([T.StructField("block", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))]))
    asked = queries.select("vec_id", "v", F.explode(map_text(blocks_asked, asked_kind, F.col("v"))).alias("b")).select("vec_id", "v", "b.cells", "b.block", F.lit(True).alias("asks"))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)).cast("int")
    found = indexed.select("vec_id", "v", F.array("cell").alias("cells"), map_text(block_of, T.IntegerType(), F.col("cell"), part).alias("block"), F.lit(False).alias("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        now, held_rows, by_cell = None, [], None
        for batch in batches:  # sorted by block, vectors before queries
            if not batch.num_rows:
                continue
            block, asks, who = (np.asarray(batch.column(c).to_pylist()) for c in ("block", "asks", "vec_id"))
            v, walk = batch.column("v"), batch.column("cells")
            size = v.value_lengths().to_numpy()  # a block's vectors have one width
            ends = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(asks.astype(int)) != 0)) + 1).tolist(), len(block)]
            for a, b in zip(ends, ends[1:], strict=False):
                key = int(block[a])
                own = matrix(v.slice(a, b - a), int(size[a]))
                lists = walk.slice(a, b - a)
                cells = lists.flatten().to_numpy()
                if key != now:
                    now, held_rows, by_cell = key, [], None
                if not asks[a]:
                    held_rows.append((who[a:b], own, cells))
                elif held_rows:
                    if by_cell is None:
                        by_cell = grouped(*(np.concatenate(x) for x in zip(*held_rows, strict=True)))
                    asker = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
                    order = np.argsort(cells, kind="stable")
                    each, first = np.unique(cells[order], return_index=True)
                    for c, rows in zip(each.tolist(), np.split(asker[order], first[1:]), strict=True):
                        if c in by_cell:
                            best.add(*by_cell[c], who[a:b][rows], own[rows])
        q, i, s = best.rows()
        for a in range(0, len(q), 50_000):
            yield table_batch(PAIR, query_id=q[a : a + 50_000].tolist(), vec_id=i[a : a + 50_000].tolist(), score=s[a : a + 50_000].tolist())

    met = found.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks").mapInArrow(run, PAIR)
    return best_of(met, k)


def grouped(ids: np.ndarray, m: np.ndarray, cells: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """cell -> (ids in order, their vectors)."""
    order = np.lexsort((ids, cells))
    ids, m, cells = ids[order], m[order], cells[order]
    each, first = np.unique(cells, return_index=True)
    ends = np.append(first[1:], len(cells))
    return {c: (ids[a:b], m[a:b]) for c, a, b in zip(each.tolist(), first.tolist(), ends.tolist(), strict=True)}

"""Time-ordered target encoding: what share of a key's earlier rows of other folds was positive, shrunk towards the key's parent.

Rows are dealt to shards by time: a shard holds the rows of a stretch of time, and a moment that alone fills a stretch is split
further by a hash of its rows, which need nothing of each other. Three passes follow:

1. Within each shard, positive and all rows are counted per column, key and fold.
2. The counts of each key are summed over its shards in order of time: the balance of a key and of its folds at a shard's opening.
3. A shard's rows meet its opening balances in one task. There, running counts of each key, and of each key and fold, within the
   shard are tables at time + gap; DuckDB's ASOF join finds for every row the last entry strictly before it. The history of a
   row is the opening balance and the key's entry, less the fold's.

Nothing is sorted or summed over the whole table: shards are cut at approximate quantiles of time, of which there is a bounded
number, and a key has one row a shard in pass 2, however many rows it has in the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, give_back, shared_folder, written

#: Rows of a shard; least and most stretches of time (stretches grow beyond); rows that one task takes up at once.
SHARD_ROWS, LEAST_STRETCHES, MOST_STRETCHES, CHUNK_ROWS = 250_000, 64, 10_000, 150_000
#: Stands for null and unknown values of a parent; no id has it.
NO_VALUE = -(1 << 62)
#: Moments beyond (in the years 1684 and 2255) share the first or the last stretch: doubles tell them apart no more.
FAR = 9 * 10**15
#: Parts that one moment is split into at most.
PARTS = 1 << 20
ROOT = "_all"


@dataclass(frozen=True)
class Encoding:
    """Columns to encode, each with its parent column; all parents have the root as theirs. Fixed values of the shrinkage."""

    parents: dict[str, str]
    folds: int = 5
    gap: int = 0  # microseconds
    prior: int = 500_000  # of the root, in millionths
    strength: int = 50
    columns: list[str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "columns", [ROOT, *dict.fromkeys(self.parents.values()), *self.parents])


def stretches(rows: DataFrame, shard_rows: int) -> list[tuple[int, int]]:
    """[(first moment, parts)] of the stretches of time in order, the first from the beginning. A moment that several quantiles
    share is a stretch of its own, in as many parts."""
    n = rows.count()
    if not n:
        return [(0, 1)]
    k = min(MOST_STRETCHES, max(2, LEAST_STRETCHES, -(-n // shard_rows)))
    cuts = rows.agg(F.percentile_approx("at", [i / k for i in range(1, k)], 20 * k).alias("q")).first()["q"]
    out: dict[int, int] = {}
    for q in cuts:
        q = max(-FAR, min(FAR, q))
        out[q] = 1 if abs(q) == FAR else out.get(q, 0) + 1
    for q, times in list(out.items()):
        if times > 1:
            out.setdefault(q + 1, 1)
    return [(-FAR - 1, 1), *sorted((q, min(times, PARTS)) for q, times in out.items())]


def sharded(rows: DataFrame, cuts: list[tuple[int, int]], by: list[str]) -> DataFrame:
    """Rows with ``shard``: the number of the stretch times PARTS, and the part that a hash of the row tells."""
    from pyspark.ml.feature import Bucketizer

    near = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col("at"))).cast("double")
    cut = Bucketizer(splits=[float("-inf"), *(float(q) for q, _ in cuts[1:]), float("inf")], inputCol="_at", outputCol="_stretch")
    parts = F.lit(1)
    several = {i: n for i, (_, n) in enumerate(cuts) if n > 1}
    if several:
        known = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
        parts = F.coalesce(F.try_element_at(known, F.col("_stretch").cast("int")), F.lit(1))
    out = rows if len(cuts) == 1 else cut.transform(rows.withColumn("_at", near)).drop("_at")
    stretch = F.lit(0) if len(cuts) == 1 else F.col("_stretch")
    return out.withColumn("shard", stretch.cast("long") * PARTS + F.pmod(F.xxhash64(*by), parts)).drop("_stretch")


def whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches that are sorted by shard, as tables of whole shards."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        shard = b.column("shard").to_numpy()
        start = 0
        if size >= CHUNK_ROWS and len(cuts := np.flatnonzero(np.diff(shard, prepend=held[-1].column("shard")[-1].as_py()))):
            start = int(cuts[0])
            yield pa.Table.from_batches([*held, b.slice(0, start)] if start else held)
            held, size = [], 0
        held.append(b.slice(start))
        size += b.num_rows - start
    if held:
        yield pa.Table.from_batches(held)


def coded(values: pa.Array, known: pa.Array | None = None) -> tuple[np.ndarray, pa.Array]:
    """A dense code for each value, and the values by code."""
    if known is None:
        d = values.dictionary_encode()
        d = d.combine_chunks() if isinstance(d, pa.ChunkedArray) else d
        return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary
    found = pc.index_in(values, value_set=known)
    return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64), known


def counted(chunk: pa.Table, e: Encoding) -> pa.Table:
    """Pass 1: (c, k, shard, folds, n0.., s0..) of each column, key and shard; folds has a bit for each fold that the shard's rows have."""
    shard, shards = coded(chunk["shard"])
    fold, tells = chunk["fold"].to_numpy(), chunk["tells"].to_numpy()
    n, s = chunk["n"].to_numpy() * tells, chunk["s"].to_numpy() * tells
    bits, parts = 1 << np.arange(e.folds), []
    for c, name in enumerate(e.columns):
        code, keys = coded(chunk[name]) if name != ROOT else (np.zeros(len(fold), np.int64), pa.array([0], pa.int64()))
        own, at = np.unique(code * len(shards) + shard, return_inverse=True)
        per_fold = lambda w: np.bincount(at * e.folds + fold, w, len(own) * e.folds).astype(np.int64).reshape(-1, e.folds)  # noqa: B023, E731
        parts.append(pa.table({
            "c": pa.array(np.full(len(own), c, np.int32)), "k": keys.take(pa.array(own // len(shards))), "shard": shards.take(pa.array(own % len(shards))), "folds": pa.array((per_fold(None) > 0) @ bits),
            **{f"{x}{f}": pa.array(np.ascontiguousarray(sums[:, f])) for x, sums in (("n", per_fold(n)), ("s", per_fold(s))) for f in range(e.folds)},
        }))
    return pa.concat_tables(parts)


def openings(counts: DataFrame, e: Encoding) -> DataFrame:
    """Pass 2: (shard, c, k, fold, n, s): how many rows, and positive ones, other folds of a key had before a shard's stretch of time,
    for the folds of its rows. The shards of one stretch have the same balance."""
    earlier = Window.partitionBy("c", "k").orderBy("stretch").rangeBetween(Window.unboundedPreceding, -1)
    before = {f"{x}{f}": F.coalesce(F.sum(f"{x}{f}").over(earlier), F.lit(0)) for x in "ns" for f in range(e.folds)}
    rows = counts.withColumn("stretch", F.floor(F.col("shard") / PARTS)).select("shard", "c", "k", "folds", *(x.alias(n) for n, x in before.items()))
    others = lambda x, f: sum((F.col(f"{x}{g}") for g in range(e.folds) if g != f), F.lit(0))
    each = F.array(*(F.when(F.col("folds").bitwiseAND(1 << f) > 0, F.struct(F.lit(f).alias("fold"), others("n", f).alias("n"), others("s", f).alias("s"))) for f in range(e.folds)))
    return rows.select("shard", "c", "k", F.explode(each).alias("o")).where("o is not null").select("shard", "c", "k", "o.*")


class Shards:
    """Pass 3, in a task: histories of whole shards."""

    def __init__(self, e: Encoding):
        import duckdb

        self.e = e
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})

    def before(self, own: np.ndarray, kind: np.ndarray, key: np.ndarray, at: np.ndarray, n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry (kind: key and fold; at: time), sorted by key, fold and time: counts of its key's entries before it, less
        those of its own fold. Entries of keys with a single time have none."""
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
        several = np.repeat(np.minimum.reduceat(at, first) < np.maximum.reduceat(at, first), np.diff(np.append(first, len(key)))) if len(key) else first.astype(bool)
        found = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        if several.any():
            i = np.flatnonzero(several)
            entries = pa.table({"i": i, "key": key[i], "kind": kind[i], "at": at[i]})  # noqa: F841  (read by name, as are the two tables)
            by_key, by_fold = self.running(key[i], at[i], n[i], s[i]), self.running(kind[i], at[i], n[i], s[i])  # noqa: F841
            got = self.con.sql("""
                SELECT e.i, coalesce(k.n, 0) - coalesce(f.n, 0) AS n, coalesce(k.s, 0) - coalesce(f.s, 0) AS s
                FROM entries e ASOF LEFT JOIN by_key k ON e.key = k.owner AND e.at > k.at ASOF LEFT JOIN by_fold f ON e.kind = f.owner AND e.at > f.at
            """).to_arrow_table()
            for out, name in zip(found, "ns", strict=True):
                out[got["i"].to_numpy()] = got[name].to_numpy()
        return found

    @staticmethod
    def running(owner: np.ndarray, at: np.ndarray, n: np.ndarray, s: np.ndarray) -> pa.Table:
        """(owner, at, n, s): what an owner has had up to a time, itself included."""
        order = np.lexsort((at, owner))
        owner, at = owner[order], at[order]
        last = np.append((owner[1:] != owner[:-1]) | (at[1:] != at[:-1]), True)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size = np.diff(np.append(first, len(owner)))
        up = {}
        for name, x in (("n", n), ("s", s)):
            total = np.cumsum(x[order])
            up[name] = (total - np.repeat(total[first] - x[order][first], size))[last]
        return pa.table({"owner": owner[last], "at": at[last], **up})

    def run(self, chunk: pa.Table) -> pa.Table:
        e = self.e
        facts, opened = chunk.filter(pc.less(chunk["c"], 0)).combine_chunks(), chunk.filter(pc.greater_equal(chunk["c"], 0))
        shard, shards = coded(facts["shard"])
        fold, tells = facts["fold"].to_numpy().astype(np.int64), facts["tells"].to_numpy()
        at, moments = np.unique(facts["at"].to_numpy(), return_inverse=True)
        n, s = facts["n"].to_numpy(), facts["s"].to_numpy()
        rates: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for c, name in enumerate(e.columns):
            code, keys = coded(facts[name]) if name != ROOT else (np.zeros(len(fold), np.int64), pa.array([0], pa.int64()))
            key = code * len(shards) + shard
            kinds = key * e.folds + fold
            entry, place = np.unique(kinds * len(at) + moments, return_inverse=True)
            kind, time = entry // len(at), at[entry % len(at)]
            sums = [np.bincount(place, w * tells, len(entry)).astype(np.int64) for w in (n, s)]
            found = self.before(entry, kind, kind // e.folds, time, *sums)
            own = opened.filter(pc.equal(opened["c"], c))
            opens = (coded(own["at"], keys)[0] * len(shards) + coded(own["shard"], shards)[0]) * e.folds + own["fold"].to_numpy()
            order = np.argsort(opens)
            met = order[np.searchsorted(opens[order], kind)]
            hn, hs = (x + own[y].to_numpy()[met] for x, y in zip(found, "ns", strict=True))
            rates[name] = hn[place], hs[place]
        asks = np.flatnonzero(facts["asks"].to_numpy())
        out = {x: facts[x] for x in facts.column_names if x not in ("c", "shard", "fold", "tells", "asks", "at", *e.columns)}
        level = {ROOT: self.rate(*rates[ROOT], np.int64(e.prior))}
        for parent in dict.fromkeys(e.parents.values()):
            level[parent] = self.rate(*rates[parent], level[ROOT])
        for name, parent in e.parents.items():
            out[name] = facts[name]
            out[f"{name}_n"] = pa.array(rates[name][0])
            out[f"{name}_rate"] = pa.array(self.rate(*rates[name], level[parent]))
        return pa.table(out).take(pa.array(asks))

    def rate(self, n: np.ndarray, s: np.ndarray, prior) -> np.ndarray:
        k = self.e.strength
        return np.where(n < 1, prior, (1_000_000 * s + k * prior) // (n + k))


def encode(rows: DataFrame, e: Encoding, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows with <column>_n and <column>_rate for each encoded column.

    rows: ``moment`` (long, microseconds), ``fold`` (0 to folds - 1), ``n`` and ``s`` (rows it stands for, and positive ones), a long
    for each column and each parent, and others, which are kept (moment and fold aren't). n and rate are of the history: the rows
    of other folds more than ``gap`` earlier. Rates are in millionths, rounded down; without history a rate is its parent's.
    Repeated rows count each. Read twice, so pass a written table.
    """
    bounded_batches(rows.sparkSession)
    names = [c for c in e.columns if c != ROOT]
    kept = [c for c in rows.columns if c not in (*names, "moment", "fold", "n", "s")]
    flag = lambda asks, tells: {"at": F.col("moment") + (e.gap if not asks else 0), "asks": F.lit(asks), "tells": F.lit(tells)}
    both = rows.withColumns(flag(1, 1)) if not e.gap else rows.withColumns(flag(1, 0)).unionByName(rows.withColumns(flag(0, 1)))
    facts = both.select(F.lit(-1).alias("c"), F.col("fold").cast("int").alias("fold"), "at", "asks", "tells", *(F.col(c).cast("long").alias(c) for c in ("n", "s", *names)), *kept)
    facts = sharded(facts, stretches(facts, shard_rows), ["n", "s", *names, *kept])
    lean = facts.select("shard", "fold", "tells", "n", "s", *names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_shards(batches):
            yield from counted(chunk, e).to_batches(20_000)
        give_back()

    sums = ", ".join(f"{x}{f} long" for x in "ns" for f in range(e.folds))
    counts = lean.repartition("shard").sortWithinPartitions("shard").mapInArrow(count, f"c int, k long, shard long, folds long, {sums}")
    opened = openings(counts, e).select("c", "fold", F.col("k").alias("at"), "n", "s", "shard")
    met = facts.unionByName(opened, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(e)
        for chunk in whole_shards(batches):
            yield from shards.run(chunk).select(order).to_batches(20_000)
        give_back()

    kind = facts.select(*kept, "n", "s", *e.parents).schema
    order = [*kept, "n", "s", *e.parents, *(f"{c}_{x}" for c in e.parents for x in ("n", "rate"))]
    for c in e.parents:
        kind = kind.add(f"{c}_n", "long").add(f"{c}_rate", "long")
    return met.mapInArrow(judge, kind)


def micros(rows: DataFrame, name: str) -> Column:
    """A time as microseconds since 1970; times without a zone are taken as they stand."""
    if dict(rows.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")
    return F.unix_micros(F.col(name))


def parent_key(value: Column, text: bool = False) -> Column:
    return F.when(value.isNull(), F.lit(NO_VALUE)).otherwise(F.xxhash64(value) if text else value.cast("long"))


def sale_facts(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame, folds: int = 5) -> DataFrame:
    """(sale_id, item_id, vendor_id, client_id, kind, nation_id, segment, moment, fold, n, s): lines of a sale that have the item and
    the vendor in common, counted; s of them were returned.

    Lines without a sale, or whose sale has no time, are left out. Null ids of items, vendors and clients become -1. Of several
    sales of one id the earliest counts (of equals the least client); of several rows of an item, vendor or client the least value.
    Kinds and segments go on as 64-bit hashes.
    """
    none = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1))
    own = lines.select(F.col("sale_id").cast("long").alias("sale_id"), none("item_id").alias("item_id"), none("vendor_id").alias("vendor_id"), (F.col("flag") == "returned").alias("returned"))
    counts = own.where("sale_id is not null").groupBy("sale_id", "item_id", "vendor_id").agg(F.count("*").alias("n"), F.count_if("returned").alias("s"))

    def values(df: DataFrame, key: str, value: str, text: bool) -> DataFrame:
        one = df.select(F.col(key).cast("long").alias(key), F.col(value).alias("_v")).where(F.col(key).isNotNull()).groupBy(key).agg(F.min("_v").alias("_v"))
        # written, since adaptive execution splits a hot key only if no aggregate stands between the shuffle and the join
        return written(one.select(key, parent_key(F.col("_v"), text).alias(value)), shared_folder(df.sparkSession, value))

    def with_parent(df: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
        return df.join(other, key, "left").withColumn(value, F.coalesce(value, F.lit(NO_VALUE)))

    dated = sales.select(F.col("sale_id").cast("long").alias("sale_id"), none("client_id").alias("client_id"), micros(sales, "sold_at").alias("moment")).where("sale_id is not null and moment is not null")
    first = dated.groupBy("sale_id").agg(F.min(F.struct("moment", "client_id")).alias("f")).select("sale_id", "f.*")
    first = with_parent(first, values(clients, "client_id", "segment", True), "client_id", "segment")
    out = with_parent(counts, values(items, "item_id", "kind", True), "item_id", "kind")
    out = with_parent(out, values(vendors, "vendor_id", "nation_id", False), "vendor_id", "nation_id")
    return out.join(first, "sale_id").withColumn("fold", (F.crc32(F.col("sale_id").cast("string").cast("binary")) % folds).cast("int"))


def encode_sales(lines: DataFrame, sales: DataFrame, items: DataFrame, vendors: DataFrame, clients: DataFrame) -> DataFrame:
    """Per sale_id, item_id, vendor_id: n_lines, n_returned, and item_n, item_rate, vendor_n, vendor_rate, client_n, client_rate of
    the history: lines of other folds of sales sold earlier.

    The facts are written once to the shared folder and read by the passes. See sale_facts() for nulls and repeated rows; other
    columns are dropped, and an empty table of lines or sales gives an empty result.
    """
    spark = lines.sparkSession
    rows = written(sale_facts(lines, sales, items, vendors, clients), shared_folder(spark, "sale_facts"))
    e = Encoding({"item_id": "kind", "vendor_id": "nation_id", "client_id": "segment"})
    found = encode(rows, e)
    names = {"n": "n_lines", "s": "n_returned"} | {f"{c}_id_{x}": f"{c}_{x}" for c in ("item", "vendor", "client") for x in ("n", "rate")}
    return found.select("sale_id", "item_id", "vendor_id", *(F.col(a).alias(b) for a, b in names.items()))

"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone.

Every document of a source expects the same number of copies, its source's target over its source's size. The expected copies
are prefix-summed along the source, one random offset per source is added, and a document is emitted once for each integer
boundary that its stretch of the sum crosses. Along the source documents lie by size, so what is taken differs from the target by
little more than the largest document.

The place of a document in its source is found without sorting a source anywhere: documents fall into bins of near-equal sizes
and bins into slots by a hash of the id. Counts of slots and bins are prefix-summed (both bounded in number whatever the input is),
and rows are only numbered within a slot. Rows alike in id, source and size are counted together before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import fresh

#: Words are runs of other characters than these.
WORD = r"[^\x20\x09-\x0D]+"
#: Sizes keep this many leading binary digits in their bin; a bin has 16 ** SLOT_DIGITS slots.
BIN_BITS, SLOT_DIGITS = 10, 3
#: Copies are counted in units of 2 ** -32; numbered runs of one document are cut after so many rows.
UNIT, RUN = 1 << 32, 1 << 16
#: Stands for a null source; others have a mark before them.
NO_SOURCE = ""


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(key, source_size, target) of (key, source_size): sources by code point, null last, have the weights in turn and share the sum
    of all sizes; a target stops at ``cap`` times its source's size, and the excess goes to the others by weight until none is above.
    Sources of no size have the target 0. One row per source, so one task orders them.

    In the order of cap over weight, a source stops if its cap is no more than its share of what those before it leave; the first
    that doesn't stop tells what a unit of weight is worth to all after it.
    """
    s = sizes.withColumn("cap", F.col("source_size") * cap).withColumn("place", F.row_number().over(Window.orderBy(F.col("key") == NO_SOURCE, "key")) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), F.col("place") % len(weights) + 1))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("shares", F.sum("weight").over(rest)).withColumn("stops", F.col("cap") * F.col("shares") <= F.col("left") * F.col("weight"))
    first = F.first(F.when(~F.col("stops"), F.struct("left", "shares")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = (F.col("first.left") * F.col("weight")).cast("double") / F.col("first.shares")
    return s.withColumn("first", first).select("key", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(F.least(share, F.col("cap").cast("double"))).alias("target"))


def slot(id_: Column) -> Column:
    return F.coalesce(F.substring(F.md5(id_.cast("string").cast("binary")), 1, SLOT_DIGITS), F.lit(""))


def size_bin(size: Column) -> Column:
    """A size with all but its leading binary digits set to nought."""
    less = F.greatest(F.length(F.bin(size)) - BIN_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", size, less), less)


def draws(docs: DataFrame, weights: tuple[int, ...], cap: int, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """(id, key, size, m, source_size, target, base, extra): m rows alike in id, source and size have base copies each, and
    ``extra`` of them one more."""
    source = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), source), F.lit(NO_SOURCE)).alias("key"), words(F.col(text_col)).alias("size"))
    alike = rows.groupBy("id", "key", "size").agg(F.count("*").alias("m")).withColumns({"bin": size_bin(F.col("size")), "slot": slot(F.col("id"))})
    slots = alike.groupBy("key", "bin", "slot").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("size")).alias("words"))
    bins = slots.groupBy("key", "bin").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    sources = targets(bins.groupBy("key").agg(F.sum("words").alias("source_size")), weights, cap)

    def before(n: str, *by: str) -> Column:
        return F.coalesce(F.sum(n).over(Window.partitionBy(*by[:2]).orderBy(*by[2:]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    by_bin = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = slots.select("key", "bin", "slot", before("n", "key", "bin", "slot").alias("slot_before"))
    starts = starts.join(bins.select("key", "bin", F.coalesce(F.sum("n").over(by_bin), F.lit(0)).alias("bin_before")), ["key", "bin"])
    rate = F.coalesce(F.floor(F.try_divide("target", "source_size") * UNIT), F.lit(0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "key").cast("binary")), 1, 8), 16, 10)
    rated = sources.select("key", "source_size", "target", rate.cast("decimal(19,0)").alias("rate"), offset.cast("decimal(19,0)").alias("offset"))
    within = Window.partitionBy("key", "bin", "slot").orderBy("size", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("row_before", F.coalesce(F.sum("m").over(within), F.lit(0))).join(starts, ["key", "bin", "slot"]).join(rated, "key")
    placed = placed.withColumn("k", (F.col("bin_before") + F.col("slot_before") + F.col("row_before")).cast("decimal(18,0)"))
    crossed = F.expr(f"((offset + rate * (k + cast(m as decimal(17,0)))) div {UNIT}) - ((offset + rate * k) div {UNIT})")
    base = F.expr(f"rate div {UNIT}")
    return placed.select("id", "key", "size", "m", "source_size", "target", base.alias("base"), (crossed - base * F.col("m")).alias("extra"))


def copies(drawn: DataFrame) -> DataFrame:
    """draws() with one row for each of the m rows, and its copies; the ``extra`` ones come first."""
    runs = drawn.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / RUN))))
    place = F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("m")) - 1))
    return runs.withColumn("place", place).withColumn("copies", F.col("base") + F.when(F.col("place") < F.col("extra"), 1).otherwise(0)).drop("m", "run", "extra", "base")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per document: its id, size, source_size, target, taken (words that the mix takes, repeats counted), copies.

    Null and empty texts have size 0 and take nothing, however often they are emitted. A null id is an id like others; repeated rows
    are documents of their own, drawn next to each other. A null source is a source, the last. Other columns are dropped, an empty
    table gives an empty one. The same rows give the same draw whatever their order and partitions.
    """
    found = copies(draws(docs, weights, cap, seed, id_col, source_col, text_col))
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: each document as often as it was drawn, with its columns and the number of the copy. Of rows alike in id, source
    and size, those of the least text hashes come first."""
    id_, key, size, place, n, base, extra, copy = (fresh(c, docs) for c in ("_id", "_key", "_size", "_place", "_copies", "_base", "_extra", "copy"))
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(NO_SOURCE))
    own = docs.withColumns({id_: F.col(id_col), key: source, size: words(F.col(text_col))})
    own = own.withColumn(place, F.row_number().over(Window.partitionBy(id_, key, size).orderBy(F.xxhash64(text_col), F.col(text_col))) - 1)
    drawn = draws(docs, weights, cap, seed, id_col, source_col, text_col).select(F.col("id").alias("_i"), F.col("key").alias("_k"), F.col("size").alias("_s"), F.col("base").alias(base), F.col("extra").alias(extra)).alias("_d")
    met = own.join(drawn, F.col(id_).eqNullSafe(F.col("_d._i")) & (F.col(key) == F.col("_d._k")) & (F.col(size) == F.col("_d._s")))
    took = F.col(base) + F.when(F.col(place) < F.col(extra), 1).otherwise(0)
    quoted = [F.col(f"`{c}`") for c in docs.columns]
    return met.select(*quoted, took.alias(n)).where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop(n)

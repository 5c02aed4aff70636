"""A threshold swept with the clusters that it would make: at each cut the accepted pairs are linked, components are refined as the run
refines them, and what comes out is held against the truth, over all classes and for each.

All cuts are clustered in one go: a node is a row at a cut, an edge holds at every cut up to its confidence, so one run of connected
components and one of refinement serve them all. Rows that no accepted pair touches are alone at every cut and are only counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import SCHEMA, UNCLASSIFIED, MaterialClass
from ..storage import shared_folder, written
from .graph import connected_components
from .refining import refine_items

# The cuts, what precision must keep, rows that make a class's own sweep worth following.
CUTS, LEAST_PRECISION, CLASS_ITEMS = tuple(round(0.40 + 0.02 * k, 2) for k in range(28)), 0.94, 40


def clusters_at_cuts(items: DataFrame, scored: DataFrame, cuts: tuple[float, ...] = CUTS, schema: dict[str, MaterialClass] = SCHEMA) -> DataFrame:
    """(cut, id, component, part) of the rows that a pair of at least the lowest cut touches.

    items: id, class_code, attrs; scored: a, b, confidence, verdict, of which duplicates and reviews can become links. A member's place
    in its component follows its links at that cut.
    """
    edges = scored.where(F.col("verdict").isin("duplicate", "review") & (F.col("a") != F.col("b"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "confidence")
    edges = edges.groupBy("a", "b").agg(F.max("confidence").alias("confidence"))
    holds = F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("confidence"))
    edges = written(edges.select("a", "b", F.explode(holds).alias("cut")), shared_folder(scored.sparkSession, "cut_edges"))
    node = lambda c: F.struct("cut", F.col(c).alias("id"))
    ends = edges.select("cut", F.explode(F.array("a", "b")).alias("id")).groupBy("cut", "id").agg(F.count("*").alias("degree"))
    found = connected_components(ends.select(F.struct("cut", "id").alias("id")), edges.select(node("a").alias("a"), node("b").alias("b")))
    members = found.select(F.col("id.cut").alias("cut"), F.col("id.id").alias("id"), F.col("component.id").alias("component"))
    placed = members.join(ends, ["cut", "id"]).select(F.concat_ws("|", "cut", "component").alias("component"), "id", "degree")
    parts = refine_items(placed, items, None, schema).withColumnRenamed("component", "place")
    return parts.select(F.substring_index("place", "|", 1).cast("double").alias("cut"), "id", F.substring("place", F.locate("|", "place") + 1, F.length("place")).alias("component"), "part")


def pairs_of(n: str | Column) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return F.floor(n * (n - 1) / 2)


def sweep(items: DataFrame, scored: DataFrame, truth: DataFrame, cuts: tuple[float, ...] = CUTS, schema: dict[str, MaterialClass] = SCHEMA) -> DataFrame:
    """(class_code, cut, rows, clusters, tp, fp, fn, precision, recall, f1): one row per cut for all classes (class_code null) and for
    each class of ``truth`` (id, group), whose pairs count if both rows are of the class. Clusters hold at least one row of truth."""
    known = truth.select("id", "group").join(items.select("id", F.coalesce("class_code", F.lit(UNCLASSIFIED)).alias("class_code")), "id")
    known = known.withColumn("class_code", F.explode(F.array("class_code", F.lit(None).cast("string"))))
    known = written(known, shared_folder(items.sparkSession, "truth"))
    met = written(clusters_at_cuts(items, scored, cuts, schema).join(known, "id"), shared_folder(items.sparkSession, "met"))

    def counts(*keys: str) -> DataFrame:
        n = met.groupBy("class_code", "cut", *keys).agg(F.count("*").alias("n"))
        return n.groupBy("class_code", "cut").agg(F.sum(pairs_of("n")).alias("pairs"), F.count("*").alias("groups"), F.sum("n").alias("members"))

    both, own = counts("component", "part", "group").select("class_code", "cut", F.col("pairs").alias("tp")), counts("component", "part")
    true = known.groupBy("class_code", "group").agg(F.count("*").alias("n")).groupBy("class_code").agg(F.sum(pairs_of("n")).alias("true"), F.sum("n").alias("rows"))
    every = true.withColumn("cut", F.explode(F.array(*map(F.lit, cuts)))).alias("t")
    same = lambda o: F.col("t.class_code").eqNullSafe(F.col(f"{o}.class_code")) & (F.col("t.cut") == F.col(f"{o}.cut"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = every.join(both.alias("b"), same("b"), "left").join(own.alias("o"), same("o"), "left")
    tp, found = none(F.col("b.tp")), none(F.col("o.pairs"))
    out = out.select("t.class_code", "t.cut", "t.rows", (F.col("t.rows") - none(F.col("o.members")) + none(F.col("o.groups"))).alias("clusters"), tp.alias("tp"), (found - tp).alias("fp"), (F.col("t.true") - tp).cast("long").alias("fn"))
    # nothing found is nothing wrong, nothing to find is nothing missed
    share = lambda x, y: F.coalesce(F.try_divide(F.col(x), F.col(x) + F.col(y)), F.lit(1.0))
    out = out.withColumn("precision", share("tp", "fp")).withColumn("recall", share("tp", "fn"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def recommended(swept: DataFrame, least_precision: float = LEAST_PRECISION, class_items: int = CLASS_ITEMS) -> DataFrame:
    """(class_code, cut, f1, recall, precision, rows, enough, f1_gain, recall_gain): the best cut of all and of each class, of those whose
    precision suffices, or of all if none does: the highest F1, then recall, then the lowest cut. Gains are over the common cut; a class
    of fewer than ``class_items`` rows has a row, but not ``enough``."""
    ok = (F.col("precision") >= least_precision).alias("ok")
    best = swept.groupBy("class_code").agg(F.max(F.struct(ok, "f1", "recall", (-F.col("cut")).alias("low"), "precision", "rows")).alias("s"))
    best = best.select("class_code", (-F.col("s.low")).alias("cut"), "s.f1", "s.recall", "s.precision", "s.rows")
    common = best.where("class_code is null").select(F.col("cut").alias("c"))
    at = swept.join(F.broadcast(common), F.col("cut") == F.col("c")).select(F.col("class_code").alias("k"), F.col("f1").alias("f"), F.col("recall").alias("r"))  # one cut
    out = best.join(at, F.col("class_code").eqNullSafe(F.col("k")), "left")
    return out.select("class_code", "cut", "f1", "recall", "precision", "rows", (F.col("rows") >= class_items).alias("enough"), (F.col("f1") - F.col("f")).alias("f1_gain"), (F.col("recall") - F.col("r")).alias("recall_gain"))

"""Components, their refinement, and changes to clusters, over pair frames."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import drop, shared_folder, written


def least_neighbours(edges: DataFrame) -> DataFrame:
    """(a, m): each node's least neighbour or itself."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that edges (a, b) reach; nodes without edges are their own.

    Only edges are rewritten. A round hangs every larger neighbour of a node on its least one, then every smaller one; the
    rounds end when the edges stay as they are, however many that takes (their number grows with the logarithm of the longest
    path). Each round is written to the shared folder and the one before it removed. Nothing is broadcast: rounds are small in a file, not
    as a task holds them.
    """
    folder = shared_folder(nodes.sparkSession, "components")
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/0")
    k, before = 0, None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hung = both.join(least_neighbours(both).hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = hung.groupBy("a").agg(F.min("b").alias("m"))
        small = hung.join(low.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        k += 1
        e = written(small.where("a <> b").distinct(), f"{folder}/{k}")
        drop(f"{folder}/{k - 1}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return nodes.join(e.select(F.col("a").alias("id"), F.col("b").alias("_root")).hint("merge"), "id", "left").select("id", F.coalesce("_root", "id").alias("component"))


def refine(members: DataFrame, refusals: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(component, id, part): a component split until no part holds a refused pair, of refusals that are given as pairs (such as
    reviewers' decisions); refining.refine_items works out what the matcher refuses.

    Members are placed in the order of their accepted links (a, b), most first, then of ids; each joins the first part that has
    nobody it refuses. Components of fewer than three stay whole. members: component, id; refusals: component, a, b. Placing is
    sequential, so a component with refusals is one task's work; components without any never leave the JVM.
    """
    members = members.select(*(F.col(c).alias(c) for c in ("component", "id")))
    no = refusals.select(*(F.col(c).alias(c) for c in ("component", "a", "b"))).where("a <> b")
    if links is None:
        ranked = members.withColumn("degree", F.lit(0).cast("long"))
    else:
        degree = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
        ranked = members.join(degree, "id", "left").select("component", "id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    sizes = members.groupBy("component").agg(F.count("*").alias("n"))
    torn = no.select("component").distinct().join(sizes.where("n >= 3"), "component", "left_semi")

    def place(rows: pd.DataFrame, no: pd.DataFrame) -> pd.DataFrame:
        against: dict = {}
        for a, b in zip(no["a"], no["b"], strict=True):
            against.setdefault(a, set()).add(b)
            against.setdefault(b, set()).add(a)
        parts: list[set] = []
        where = []
        for c, i in rows.sort_values(["degree", "id"], ascending=[False, True])[["component", "id"]].itertuples(index=False):
            k = next((k for k, p in enumerate(parts) if p.isdisjoint(against.get(i, ()))), len(parts))
            if k == len(parts):
                parts.append(set())
            parts[k].add(i)
            where.append((c, i, k))
        return pd.DataFrame(where, columns=["component", "id", "part"])

    kind = f"component {dict(members.dtypes)['component']}, id {dict(members.dtypes)['id']}, part int"
    split = ranked.join(torn, "component", "left_semi").groupBy("component").cogroup(no.join(torn, "component", "left_semi").groupBy("component")).applyInPandas(place, kind)
    return members.join(torn, "component", "left_anti").select("component", "id", F.lit(0).alias("part")).unionByName(split)


def clusters_of(parts: DataFrame) -> DataFrame:
    """(id, cluster): a part's cluster is its least member."""
    heads = parts.groupBy("component", "part").agg(F.min("id").alias("cluster"))
    return parts.join(heads.hint("merge"), ["component", "part"]).select("id", "cluster")


def regroup(clusters: DataFrame, fresh: DataFrame, frozen: DataFrame) -> DataFrame:
    """New clusters (id, cluster) in which the frozen ones (cluster), such as those with an issued code, keep their members."""
    kept = clusters.join(frozen.select("cluster"), "cluster", "left_semi").select("id", "cluster")
    return kept.unionByName(fresh.select("id", "cluster").join(kept.select("id"), "id", "left_anti"))


def merge(clusters: DataFrame, merges: DataFrame, frozen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(clusters, journal): each (source, target) moves the source's members to the target; sources that are frozen stay. Chains
    of merges are followed. The journal (id, before, after) undoes it."""
    moves = merges.where("source <> target")
    if frozen is not None:
        moves = moves.join(frozen.select(F.col("cluster").alias("source")), "source", "left_anti")
    ends = connected_components(clusters.select(F.col("cluster").alias("id")).distinct(), moves.select(F.col("source").alias("a"), F.col("target").alias("b")))
    # the cluster that a chain ends in is one that is a target and no source
    last = ends.join(moves.select(F.col("source").alias("id")).distinct(), "id", "left_anti").groupBy("component").agg(F.min("id").alias("after"))
    goal = ends.join(last, "component", "left").select(F.col("id").alias("cluster"), F.coalesce("after", "component").alias("after"))
    return moved(clusters, clusters.join(goal, "cluster").where("cluster <> after").select("id", F.col("cluster").alias("before"), "after"))


def split(clusters: DataFrame, leavers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clusters, journal): the members (id) leave; those of one cluster make a new one together, named by the least of them or,
    where that is the old name, the others are renamed by their own least."""
    out = clusters.join(leavers.select("id").distinct(), "id", "left_semi")
    heads = out.groupBy("cluster").agg(F.min("id").alias("after"))
    gone = out.join(heads, "cluster").select("id", F.col("cluster").alias("before"), "after")
    stay = clusters.join(gone.select("id"), "id", "left_anti").join(heads.where("cluster = after").select("cluster"), "cluster", "left_semi")
    renamed = stay.join(stay.groupBy("cluster").agg(F.min("id").alias("after")), "cluster").select("id", F.col("cluster").alias("before"), "after")
    return moved(clusters, gone.unionByName(renamed).where("before <> after"))


def moved(clusters: DataFrame, journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    out = clusters.join(journal.select("id", "after"), "id", "left").select("id", F.coalesce("after", "cluster").alias("cluster"))
    return out, journal


def undo(clusters: DataFrame, journal: DataFrame) -> DataFrame:
    """Members that are still where the journal put them go back."""
    back = journal.select("id", "before", F.col("after").alias("cluster"))
    return clusters.join(back, ["id", "cluster"], "left").select("id", F.coalesce("before", "cluster").alias("cluster"))

"""The whole run over a catalogue: normalise, read, block, score, cluster, refine, fuse, relate. Stages are a list that callers may
change; each takes the run and returns a table, which is written before the next reads it.

An incremental run has the tables of an earlier one: new and changed rows are normalised and read alone, their keys meet the stored key
index, and only pairs that touch one of them are scored; earlier pairs of a changed row, and those whose only keys have outgrown their
caps, go. Without earlier tables the run is a full one.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.classes import SCHEMA, MaterialClass
from ..functions.normalise import normalise_rows
from ..operators import blocking, embedding, equivalence, extraction, graph, linkage, matching, refining, standardise
from ..storage import drop, exists, once, shared_folder, written


@dataclass
class Run:
    spark: SparkSession
    raw: DataFrame  # id, company, description, uom, last_purchase
    folder: str
    schema: dict[str, MaterialClass] = field(default_factory=lambda: SCHEMA)
    house: DataFrame | None = None
    rules: list = field(default_factory=list)
    crossrefs: DataFrame | None = None
    frozen: DataFrame | None = None
    decided: DataFrame | None = None  # (a, b) of reviewers' decisions, which no queue asks for again
    caps: dict | None = field(default_factory=lambda: blocking.CAPS)
    vectors: bool = False
    link: bool = False
    earlier: dict[str, DataFrame] = field(default_factory=dict)
    index: list[str] = field(default_factory=list)  # folders of the key index, oldest first
    tables: dict[str, DataFrame] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)

    @property
    def incremental(self) -> bool:
        return "items" in self.earlier and "scored" in self.earlier


def items(run: Run) -> DataFrame:
    new = run.raw
    if run.incremental:  # rows that are new, or say something else than before
        seen = run.earlier["items"].select("id", row_hash(run).alias("_h"))
        new = run.raw.withColumn("_h", row_hash(run)).join(seen, ["id", "_h"], "left_anti").drop("_h")
    own = ["description", "uom", *(["company"] if run.house is not None else [])]  # what a text's reading depends on
    read = once(new, own, lambda texts: extraction.extract_rows(normalise_rows(texts, house=run.house), schema=run.schema).withColumn("mpn_norm", codes.part_number("mpn"))).withColumn("fresh", F.lit(True))
    if not run.incremental:
        return read
    read = written(read, f"{run.folder}/fresh_items")
    return run.earlier["items"].join(read.select("id"), "id", "left_anti").withColumn("fresh", F.lit(False)).unionByName(read)


def row_hash(run: Run) -> Column:
    return F.xxhash64(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in run.raw.columns if c != "id"))


def with_vectors(run: Run) -> DataFrame:
    """Items, with the vectors of an embedding fitted on all texts if the run asks for them."""
    rows = run.tables["items"]
    model = embedding.fit(rows.select("id", F.col("norm_text").alias("text"))) if run.vectors else None
    return rows if model is None else rows.join(model.transform(rows.select("id", F.col("norm_text").alias("text"))), "id", "left")


def pairs(run: Run) -> DataFrame:
    rows = run.tables["vectors"]
    fresh = written(blocking.key_rows(rows.where("fresh")), f"{run.folder}/fresh_keys")
    replaced = rows.where("fresh").select("id")
    index = blocking.KeyIndex(run.spark, run.index)
    now = index.add(fresh, replaced, f"{run.folder}/key_index")
    run.spark.createDataFrame(list(enumerate(now.folders)), "generation int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{run.folder}/key_folders")
    if not run.incremental:
        found = blocking.candidate_pairs(fresh, run.caps)
    else:
        found, gone = blocking.pairs_of_increment(now.before(), fresh, run.caps)
        run.tables["lapsed"] = written(gone, f"{run.folder}/lapsed")
    if "vector" in rows.columns:
        near = embedding.nearest_in_class(rows.where("vector is not null").select("id", "class_code", "vector")).select("a", "b")
        found = found.unionByName(near.join(found, ["a", "b"], "left_anti").withColumn("pass", F.lit("ann")))
    if run.incremental:
        new = rows.where("fresh").select("id")
        left, right = new.select(F.col("id").alias("a")), new.select(F.col("id").alias("b"))
        found = found.join(left, "a", "left_semi").unionByName(found.join(right, "b", "left_semi")).distinct()
    return found


def kept_pairs(run: Run) -> DataFrame:
    """Scored pairs of the earlier run that still stand."""
    new = run.tables["items"].where("fresh").select("id")
    old = run.earlier["scored"].join(run.tables["lapsed"], ["a", "b"], "left_anti")
    return old.join(new.select(F.col("id").alias("a")), "a", "left_anti").join(new.select(F.col("id").alias("b")), "b", "left_anti")


def scored(run: Run) -> DataFrame:
    rows, found = run.tables["vectors"], run.tables["pairs"]
    linked = None
    if run.link and not run.incremental and rows.limit(50).count() == 50:
        linked = linkage.predict(linkage.fit(rows), found.select("a", "b"), rows)
    every = written(matching.score_pairs(found, rows, run.schema, linked), f"{run.folder}/scored_all")
    run.tables["tally"] = written(every.groupBy("route", "verdict").agg(F.count("*").alias("pairs"), F.count_if(F.size("vetoed_by") > 0).alias("vetoed")), f"{run.folder}/tally")
    kept = matching.trimmed(every if not run.incremental else kept_pairs(run).unionByName(every))
    out = written(kept, f"{run.folder}/scored_kept")
    drop(f"{run.folder}/scored_all")  # most pairs are refused and tell nothing; the tally counts them
    return out


def clusters(run: Run) -> DataFrame:
    rows, judged = run.tables["items"], run.tables["scored"]
    links = judged.where("verdict = 'duplicate'").select("a", "b")
    found = graph.connected_components(rows.select("id"), links)
    parts = graph.clusters_of(refining.refine_items(found, rows, links, run.schema))
    return parts if run.frozen is None else graph.regroup(run.earlier["clusters"], parts, run.frozen)


def golden(run: Run) -> DataFrame:
    return standardise.golden_records(run.tables["items"].join(run.tables["clusters"], "id"), run.schema)


def related(run: Run) -> DataFrame:
    close = run.tables["scored"].where("verdict <> 'duplicate'").select("a", "b")
    return equivalence.relations(close, run.tables["items"], run.rules, run.crossrefs, run.tables["clusters"], run.schema)


def queue(run: Run) -> DataFrame:
    """(a, b, kind, assignee): grey pairs and conflicts, all sure duplicates, and the 500 surest of the vetoed pairs (a sample); none
    that has been decided."""
    judged = matching.undecided(run.tables["scored"], run.decided)
    kind = F.when(F.col("verdict") == "conflict", "conflict").when(F.col("verdict") == "review", "grey").when(F.col("band") == "high", "high")
    open_tasks = judged.withColumn("kind", kind).where("kind is not null").select("a", "b", "kind")
    low = judged.where("size(vetoed_by) > 0 and verdict = 'distinct'").orderBy(F.desc("score"), "a", "b").limit(500).select("a", "b", F.lit("low sample").alias("kind"))
    return open_tasks.unionByName(low).withColumn("assignee", F.when(F.col("kind") == "conflict", "approver").otherwise("reviewer"))


STAGES: list[tuple[str, Callable[[Run], DataFrame]]] = [("items", items), ("vectors", with_vectors), ("pairs", pairs), ("scored", scored), ("clusters", clusters), ("golden", golden), ("relations", related), ("queue", queue)]


def execute(run: Run, stages: list[tuple[str, Callable[[Run], DataFrame]]] | None = None) -> Run:
    for name, stage in stages or STAGES:
        start = time.time()
        run.tables[name] = written(stage(run), f"{run.folder}/{name}")
        run.seconds[name] = round(time.time() - start, 3)
    return run


def start(spark: SparkSession, raw: DataFrame, folder: str | None = None, earlier: str | None = None, **options) -> Run:
    """A run over (id, company, description, uom, last_purchase). earlier: the folder of a run to go on from; if it isn't whole, the
    run is a full one."""
    base: dict[str, DataFrame] = {}
    if earlier is not None:
        for name in ("items", "scored", "clusters"):
            if exists(spark, f"{earlier}/{name}/_SUCCESS"):
                base[name] = spark.read.parquet(f"{earlier}/{name}")
    whole = len(base) == 3 and exists(spark, f"{earlier}/key_folders/_SUCCESS")
    if not whole:
        return execute(Run(spark, raw, folder or shared_folder(spark, "run"), **options))
    base["items"] = base["items"].drop("fresh")
    index = [r["folder"] for r in spark.read.parquet(f"{earlier}/key_folders").orderBy("generation").collect()]  # one per run
    return execute(Run(spark, raw, folder or shared_folder(spark, "run"), earlier=base, index=index, **options))


def accounting(run: Run) -> DataFrame:
    """(figure, value): what the run did and what was new."""
    t = run.tables
    parts = [(n, t[n].count()) for n in ("items", "pairs", "scored", "clusters", "golden", "relations", "queue")]
    parts += [("fresh items", t["items"].where("fresh").count()), ("duplicates", t["scored"].where("verdict = 'duplicate'").count()), ("materials", t["clusters"].select("cluster").distinct().count())]
    return run.spark.createDataFrame([(k, int(v)) for k, v in parts], "figure string, value long")

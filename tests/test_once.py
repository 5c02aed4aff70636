"""Texts are read once each, and nothing that grows with the rows is broadcast, however small its file is."""

from pyspark.sql import functions as F

from concordat.functions.normalise import normalise_rows
from concordat.operators import graph
from concordat.plans import catalog
from concordat.storage import once


def planned(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_are_read_once(spark):
    rows = spark.createDataFrame([(k, t, u) for k, (t, u) in enumerate([("hex blt", "EA"), ("hex blt", "EA"), ("hex blt", None), (None, "EA"), (None, "EA")] * 20)], "id long, description string, uom string")
    seen = []

    def read(texts):
        seen.append(texts.count())
        return normalise_rows(texts)

    got = {r["id"]: (r["norm_text"], r["uom_base"]) for r in once(rows, ["description", "uom"], read).collect()}
    assert seen == [3]
    assert got == {r["id"]: (r["norm_text"], r["uom_base"]) for r in normalise_rows(rows).collect()} and len(got) == 100


def test_components_are_not_broadcast(spark):
    nodes = spark.range(50)
    found = graph.connected_components(nodes, nodes.where("id > 0").select((F.col("id") - 1).alias("a"), F.col("id").alias("b")))
    parts = graph.clusters_of(found.withColumn("part", F.lit(0)))
    assert "BroadcastHashJoin" not in planned(parts)
    assert {r["cluster"] for r in parts.collect()} == {0}


def test_planted_traps_broadcasts_nothing(spark, small):
    assert "BroadcastHashJoin" not in planned(catalog.queries()["planted_traps"](spark, small))

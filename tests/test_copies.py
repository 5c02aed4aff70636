"""Rows that are alike stand for one another in pairs, and no pair of unlike rows is lost, whatever the size of a key."""

import pytest
from pyspark.sql import functions as F

from concordat.operators import blocking, graph, linkage
from concordat.plans import frames, materials

KIND = "id long, class_code string, attrs map<string,string>, norm_text string, norm_hash string, mpn_norm string, gtin string"


def valves(spark, n: int):
    """Two ratings of one valve, n rows of each, and one of another size."""
    row = lambda k, nb, rating: (k, "valve.gate", {"size_nb_mm": nb, "pressure_class": rating, "body_material": "WCB", "end_connection": "FLANGED"}, f"GATE VALVE {nb}NB CLASS {rating}", f"{nb}/{rating}", None, None)
    rows = [row(2 * k, "50", "150") for k in range(n)] + [row(2 * k + 1, "50", "300") for k in range(n)] + [row(9999, "80", "300")]
    return spark.createDataFrame(rows, KIND)


def test_folded_rows_lose_no_pair(spark):
    copies = blocking.Copies(valves(spark, 5), materials.COMPARED)
    heads = {r["id"]: r for r in copies.heads.collect()}
    assert {k: (r["last"], r["copies"]) for k, r in heads.items()} == {0: (8, 5), 1: (9, 5), 9999: (None, 1)}
    assert heads[0]["attrs"]["size_nb_mm"] == "50"
    assert {(r["head"], r["id"]) for r in copies.members.collect()} == {(0, 2), (0, 4), (0, 6), (0, 8), (1, 3), (1, 5), (1, 7), (1, 9)}
    met = copies.pairs(spark.createDataFrame([(0, 1)], "a long, b long"), spark.createDataFrame([(0,), (1,), (9999,)], "id long"))
    got = {(r["a"], r["b"]): r["copy"] for r in copies.unfolded(met).collect()}
    assert got == {(0, 1): False} | {(0, k): True for k in (2, 4, 6, 8)} | {(1, k): True for k in (3, 5, 7, 9)}


def test_no_key_is_too_large_to_score(spark):
    copies, _, scored = materials.folded_scores(valves(spark, 300))  # more than the caps of both passes
    got = {(r["a"], r["b"]): (r["copy"], r["verdict"]) for r in copies.unfolded(scored).collect()}
    assert len(got) == 1 + 2 * 299 and got[(0, 1)] == (False, "distinct") and sum(copy for copy, _ in got.values()) == 598


def test_rows_without_a_band_meet_their_class(spark):
    """A number, a text, or a class of rows that no band tells apart is enough for two rows to be scored."""
    row = lambda k, code, attrs, text, mpn=None, gtin=None: (k, code, attrs, text, text, mpn, gtin)
    valve = lambda nb: {"size_nb_mm": nb, "pressure_class": "150", "body_material": "WCB", "end_connection": "FLANGED"}
    rows = [
        row(1, "ppe.helmet", {"helmet_class": "A"}, "SAFETY HELMET CLASS A"), row(2, "ppe.helmet", {"helmet_class": "A"}, "HELMET CLASS A IS2925"), row(3, "ppe.helmet", {"helmet_class": "A"}, "SAFETY HELMET CLASS A"),
        row(4, "valve.gate", valve("50"), "GATE VALVE 50NB"), row(5, "valve.gate", valve("80"), "GATE VALVE 80NB"), row(6, "valve.gate", {"body_material": "WCB"}, "VALVE WCB"),
        row(7, "pipe.seamless", {"nps_mm": "25"}, "PIPE 25NB", "P1"), row(8, "pipe.seamless", {"nps_mm": "50"}, "PIPE 50NB", "P1"), row(9, "unclassified", {}, "ITEM", None, "G1"), row(10, "unclassified", {}, "THING", None, "G1"), row(11, "unclassified", {}, "OTHER"),
    ]
    copies, _, scored = materials.folded_scores(spark.createDataFrame(rows, KIND))
    got = {(r["a"], r["b"]): r["verdict"] for r in copies.unfolded(scored).collect()}
    assert set(got) == {(1, 2), (1, 3), (4, 6), (5, 6), (7, 8), (9, 10)} and got[1, 3] == "review" and got[9, 10] == "duplicate"


def test_model_counts_every_pair_of_copies(spark):
    rows = valves(spark, 40)
    pairs = linkage.rule_pairs(rows)
    want = {tuple(r[c] for c in linkage.COMPARED): r["n"] for r in linkage.levels(pairs, rows).groupBy(*linkage.COMPARED).agg(F.count("*").alias("n")).collect()}
    copies = linkage.folded(rows)
    every = copies.heads.select(F.col("id").alias("a"), F.col("copies").alias("na")).crossJoin(copies.heads.select(F.col("id").alias("b"), F.col("copies").alias("nb")))
    folded = every.where("a <= b and (a = b or (a < 2 and b < 2))").selectExpr("a", "b", "CASE WHEN a = b THEN na * (na - 1) div 2 ELSE na * nb END AS n")
    combos, n = linkage.counted(linkage.weighed(folded, copies.heads))
    assert {tuple(c): int(k) for c, k in zip(combos.tolist(), n, strict=True) if k} == want
    model = linkage.fit(rows)
    assert model.prior > 0 and sum(model.m["text"]) == pytest.approx(1)


def test_links_of_sizes_are_as_many_as_parts(spark, tmp_path):
    rows = [(k, "bolt", f"Brand#{k // 8 % 2}", "STEEL", 1 + k % 8 if k % 8 < 5 else 20 + k % 8, 9.5) for k in range(400)] + [(400, "bolt", None, "STEEL", 1, 9.5)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    assert frames.size_links(spark, str(tmp_path)).count() < len(rows)
    want = {}
    for k, _, brand, _, size, _ in rows:
        near = [j for j, _, b, _, s, _ in rows if b is not None and b == brand and (s < 10) == (size < 10)]
        want[k] = min(near, default=k)
    near = {r["item"]: r["component"] for r in frames.connected_components(spark, str(tmp_path)).collect()}
    assert near == want
    assert near[400] == 400 and len(near) == 401


def test_prices_split_as_refused_pairs_do(spark):
    price = [10.0, 25.0, 18.0, None, 50.0, 22.0, 11.0, 100.0, 40.0, 20.0] * 6
    members = spark.createDataFrame([(k % 2, k) for k in range(60)], "component long, id long")
    prices = spark.createDataFrame(list(enumerate(price)), "id long, price double")
    no = [(a % 2, a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and price[a] and price[b] and abs(price[a] - price[b]) > 0.5 * max(price[a], price[b])]
    want = {r["id"]: r["part"] for r in graph.refine(members, spark.createDataFrame(no, "component long, a long, b long")).collect()}
    assert {r["id"]: r["part"] for r in frames.split_by_price(members, prices).collect()} == want and max(want.values()) > 0


def test_every_pair_of_parts_is_scored(spark, small, tmp_path):
    """Copies too, each pair of parts with a row of its own, and nothing of a pair is written on the way."""
    from concordat.plans import pairs

    part = spark.read.parquet(f"{small}/part.parquet").where("p_partkey < 600")
    part.unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 600)).unionByName(part.withColumn("p_partkey", F.col("p_partkey") + 1200)).write.parquet(str(tmp_path / "part.parquet"))
    part.write.parquet(str(tmp_path / "one" / "part.parquet"))
    one = {(r["item_a"], r["item_b"]): (r["verdict"], r["band"]) for r in pairs.score_pairs(spark, str(tmp_path / "one")).collect()}
    want = {(min(x, y), max(x, y)): v for (a, b), v in one.items() for x in range(a, 1800, 600) for y in range(b, 1800, 600)}
    want |= {(x, y): ("duplicate", "high") for k in range(600) for x in range(k, 1800, 600) for y in range(x + 600, 1800, 600)}
    got = [(r["item_a"], r["item_b"], r["verdict"], r["band"]) for r in pairs.score_pairs(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and {(a, b): (v, band) for a, b, v, band in got} == want and one
    assert pairs.evidence_score(spark, str(tmp_path)).count() == len(want)

"""Complete linkage on what the matcher refuses, against all pairs of members."""

import random

import pytest
from pyspark.sql import functions as F

from concordat.functions.classes import SCHEMA
from concordat.operators import graph, matching, refining
from concordat.plans import pipeline

ITEMS = "id {id}, class_code string, attrs map<string,string>"


def brute(spark, members, items, links):
    """Members placed one by one; a pair is refused by its makers or by the matcher's own comparison."""
    known = {i: (c, a or {}) for i, c, a in items}
    ids = sorted({i for _, i in members})
    pairs = spark.createDataFrame([(x, y) for k, x in enumerate(ids) for y in ids[k + 1 :]] or [(ids[0], ids[0])], f"a {kind(ids)}, b {kind(ids)}")
    rows = matching.compare_pairs(pairs, spark.createDataFrame(items, ITEMS.format(id=kind(ids)))).where("verdict = 'veto'").select("a", "b").collect()
    no = {frozenset(r) for r in rows}
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            bx, by = known[x][1].get("brand"), known[y][1].get("brand")
            if bx and by and bx != by:
                no.add(frozenset((x, y)))
    degree = {i: len({frozenset(p) for p in links if i in p and p[0] != p[1]}) for i in ids}
    out = {}
    for c in {c for c, _ in members}:
        own, parts = [i for d, i in set(members) if d == c], []
        for i in sorted(own, key=lambda i: (-degree[i], i)) if len(own) > 2 else ():
            k = next((k for k, p in enumerate(parts) if not any(frozenset((i, j)) in no for j in p)), len(parts))
            parts += [[]] * (k == len(parts))
            parts[k] = [*parts[k], i]
            out[c, i] = k
        if len(own) < 3:
            out |= {(c, i): 0 for i in own}
    return out


def kind(ids):
    return "string" if isinstance(ids[0], str) else "long"


def found(spark, members, items, links):
    ids = [i for _, i in members]
    df = refining.refine_items(spark.createDataFrame(members, f"component long, id {kind(ids)}"), spark.createDataFrame(items, ITEMS.format(id=kind(ids))), spark.createDataFrame(links, f"a {kind(ids)}, b {kind(ids)}"))
    return {(r["component"], r["id"]): r["part"] for r in df.collect()}


def some_items(r, n):
    """Rows of three classes with near, far, ranged, fitted and unreadable values."""
    number = lambda *x: r.choice([None, *map(str, x)])
    out = []
    for i in range(n):
        code = r.choice(["valve.gate", "valve.gate", "bearing.ball.deep_groove", "gasket.spiral_wound", "unclassified", None])
        attrs = {
            "size_nb_mm": number(50, "50.0", 80, "40 to 60", "H7", "x"), "pressure_class": number(150, 300), "body_material": r.choice([None, "WCB", " wcb ", "CS"]),
            "pressure_bar": number(100, 103, 96, 108, "90 to 120"), "temp_max_c": number(200, 215, 231, -5), "bore_mm": number(25, 30), "thickness_mm": number("4.5", "4.5 to 5"), "brand": r.choice([None, None, "", "KITZ", "AUDCO"]),
        }
        out.append((i, code, {k: v for k, v in attrs.items() if v is not None and r.random() < 0.7}))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_random_components(spark, seed):
    r = random.Random(seed)
    items = some_items(r, 330)
    sizes, members, at = [1, 2, 3, 4, 40, 80, 200], [], 0
    for c, n in enumerate(sizes):
        members += [(c, i) for i in range(at, at + n)]
        at += n
    links = [(r.randrange(330), r.randrange(330)) for _ in range(500)]
    got = found(spark, members, items, links)
    assert got == brute(spark, members, items, links)
    assert len(set(got.values())) > 3


def test_string_ids_and_members_without_item(spark):
    items = [(f"m{i}", c, a) for i, c, a in some_items(random.Random(8), 40)]
    members = [(1, f"m{i}") for i in range(40)] + [(1, "m3")]
    links = [(f"m{i}", f"m{i * 7 % 40}") for i in range(60)]
    assert found(spark, members, items, [(a, b) for a, b in links if a < "m9"]) == brute(spark, members, items, [(a, b) for a, b in links if a < "m9"])
    assert found(spark, [(1, "x"), (1, "y"), (1, "z")], items, links) == {(1, "x"): 0, (1, "y"): 0, (1, "z"): 0}


def test_one_component_of_100_000_rows(spark):
    """2,000 profiles; members of one profile share a part, and parts hold one size and class each."""
    size = (F.col("id") % 400).cast("string")
    items = spark.range(100_000).select("id", F.lit("valve.gate").alias("class_code"), F.create_map(F.lit("size_nb_mm"), size, F.lit("pressure_class"), F.element_at(F.array(*map(F.lit, ("150", "300", "600", "900", "150"))), (F.col("id") % 5 + 1).cast("int"))).alias("attrs"))
    out = refining.refine_items(items.select(F.lit(0).alias("component"), "id"), items, spark.range(1, 100_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")))
    held = out.join(items, "id").groupBy("part").agg(F.count_distinct("attrs").alias("kinds"), F.count("*").alias("n"))
    r = held.agg(F.count("*").alias("parts"), F.max("kinds").alias("most"), F.sum("n").alias("n")).first()
    assert (r["parts"], r["most"], r["n"]) == (len({(i % 400, ("150", "300", "600", "900", "150")[i % 5]) for i in range(2000)}), 1, 100_000)


RAW = "id long, company string, description string, uom string, last_purchase date"


def catalogue(spark, rows):
    sizes = (15, 20, 25, 32, 40, 65, 100, 125, 150, 200)
    others = [(1000 + i, "west", f"GATE VALVE {sizes[i % 10]} NB CLASS {(150, 300, 600, 900)[i % 4]} {('WCB', 'SS316', 'CI')[i % 3]} FLANGED", "EA", None) for i in range(120)]
    return spark.createDataFrame([*rows, *others], RAW)


def test_chained_valves_split(spark):
    """Row 2 shares row 1's part number and row 3's GTIN; rows 1 and 3 refuse each other, though no pass met them."""
    rows = [
        (1, "a", "GATE VALVE 50NB CLASS 150 WCB FLANGED P/N ZX-4471-B", "EA", None),
        (2, "b", "GATE VALVE P/N ZX-4471-B GTIN 4006381333931", "EA", None),
        (3, "c", "GATE VALVE 80NB CLASS 300 WCB FLANGED GTIN 4006381333931", "EA", None),
    ]
    run = pipeline.start(spark, catalogue(spark, rows))
    links = {(r["a"], r["b"]) for r in run.tables["scored"].where("verdict = 'duplicate'").collect()}
    assert {(1, 2), (2, 3)} <= links
    got = {r["id"]: r["cluster"] for r in run.tables["clusters"].where("id < 10").collect()}
    assert got[1] != got[3] and got[2] in (got[1], got[3])


def test_low_scores_do_not_split(spark):
    """Three rows linked in a row; the ends were scored low, which refuses nobody."""
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "component long, id long")
    items = spark.createDataFrame([(i, "valve.gate", {"size_nb_mm": "50"}) for i in (1, 2, 3)], ITEMS.format(id="long"))
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r["cluster"] for r in graph.clusters_of(refining.refine_items(members, items, links)).collect()} == {1}


def test_schema_is_a_parameter(spark):
    """An attribute that a caller calls cosmetic refuses nobody."""
    from dataclasses import replace

    valve = SCHEMA["valve.gate"]
    mild = {"valve.gate": replace(valve, attributes={k: replace(a, role="cosmetic") for k, a in valve.attributes.items()})}
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "component long, id long")
    items = spark.createDataFrame([(i, "valve.gate", {"size_nb_mm": str(i)}) for i in (1, 2, 3)], ITEMS.format(id="long"))
    links = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r["part"] for r in refining.refine_items(members, items, links, mild).collect()} == {0}
    assert {r["part"] for r in refining.refine_items(members, items, links).collect()} == {0, 1, 2}

"""A sweep over all cuts at once against a run for each cut."""

import random
from itertools import combinations

import pytest

from concordat.operators import graph, refining, tuning

from test_refining import ITEMS, some_items


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(12)
    items = some_items(r, 90)
    scored = [(a, b, round(r.uniform(0.3, 1.0), 3), r.choice(["duplicate", "review", "review", "distinct"])) for a, b in combinations(range(80), 2) if r.random() < 0.03]
    scored += [(5, 4, 0.9, "duplicate"), (4, 5, 0.5, "review"), (7, 7, 0.9, "duplicate")]
    truth = [(i, f"g{i // 3 if i % 4 else i // 5}") for i in range(85)]
    return spark.createDataFrame(items, ITEMS.format(id="long")), spark.createDataFrame(scored, "a long, b long, confidence double, verdict string"), spark.createDataFrame(truth, "id long, `group` string"), items, scored, dict(truth)


def alone(spark, case, cut):
    """Clusters of one cut, by the run's own operators."""
    items, _, _, rows, scored, _ = case
    links = spark.createDataFrame([(a, b) for a, b, c, v in scored if v != "distinct" and c >= cut] or [(0, 0)], "a long, b long")
    found = graph.connected_components(spark.createDataFrame([(i,) for i, *_ in rows], "id long"), links)
    return {r["id"]: r["cluster"] for r in graph.clusters_of(refining.refine_items(found, items, links)).collect()}


def test_sweep_equals_separate_runs(spark, case):
    items, scored, truth, rows, _, group = case
    cuts = (0.4, 0.62, 0.9)
    got = {(r["class_code"], r["cut"]): r for r in tuning.sweep(items, scored, truth, cuts).collect()}
    code = {i: c or "unclassified" for i, c, _ in rows}
    assert {k[0] for k in got} == {None, *(code[i] for i in group)} and len(got) == 3 * len({k[0] for k in got})
    for cut in cuts:
        cluster = alone(spark, case, cut)
        for name in {k[0] for k in got}:
            own = [i for i in group if name in (None, code[i])]
            pairs = [(cluster[a] == cluster[b], group[a] == group[b]) for a, b in combinations(own, 2)]
            r = got[name, cut]
            assert (r["tp"], r["fp"], r["fn"]) == (pairs.count((True, True)), pairs.count((True, False)), pairs.count((False, True)))
            assert (r["rows"], r["clusters"]) == (len(own), len({cluster[i] for i in own}))


def test_recommended(spark):
    swept = spark.createDataFrame([(None, 0.4, 90, 0.9, 0.9, 0.9), (None, 0.5, 90, 0.95, 0.8, 0.87), (None, 0.6, 90, 0.96, 0.8, 0.87), ("x", 0.4, 50, 0.5, 1.0, 0.67), ("x", 0.5, 50, 0.6, 0.5, 0.55), ("x", 0.6, 50, 0.7, 0.5, 0.58), ("y", 0.4, 9, 0.99, 0.9, 0.94), ("y", 0.5, 9, 0.99, 0.5, 0.66), ("y", 0.6, 9, 1.0, 0.1, 0.18)], "class_code string, cut double, rows long, precision double, recall double, f1 double")
    got = {r["class_code"]: r for r in tuning.recommended(swept).collect()}
    assert {k: r["cut"] for k, r in got.items()} == {None: 0.5, "x": 0.4, "y": 0.4}
    assert [got[k]["enough"] for k in (None, "x", "y")] == [True, True, False]
    assert got["x"]["f1_gain"] == pytest.approx(0.12) and got["y"]["recall_gain"] == pytest.approx(0.4)

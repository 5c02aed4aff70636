"""Pairs of rows that share keys: each once, without a shuffle of pairs or a broadcast, copies folded."""

import io
from contextlib import redirect_stdout
from itertools import combinations

import duckdb
import pytest

from concordat.operators import blocking
from concordat.plans import catalog, pairs


def plan_of(df):
    with io.StringIO() as out, redirect_stdout(out):
        df.explain("formatted")
        return out.getvalue()


def test_pairs_meet_once_under_their_first_pass(spark, monkeypatch):
    monkeypatch.setattr(blocking, "BLOCK", 5)
    monkeypatch.setattr(blocking, "FOLD", 3)
    keys = {i: [("text", f"t{i % 2}"), ("token", f"w{i % 3}"), ("token", f"w{i % 5}"), ("identity", f"s{i % 4}")] for i in range(40)}
    rows = spark.createDataFrame([(p, k, i) for i, own in keys.items() for p, k in own], "pass string, key string, id long")
    order = list(blocking.CAPS)
    want = {}
    for a, b in combinations(keys, 2):
        if shared := set(keys[a]) & set(keys[b]):
            want[a, b] = min((p for p, _ in shared), key=order.index)
    got = [(r["a"], r["b"], r["pass"]) for r in blocking.candidate_pairs(rows, None).collect()]
    assert len(got) == len(want) and {(a, b): p for a, b, p in got} == want


def test_no_shuffle_or_broadcast_of_pairs(spark):
    rows = spark.range(300).selectExpr("'text' as pass", "cast(id % 3 as string) as key", "id")
    plan = plan_of(blocking.candidate_pairs(rows, None)).split("Physical Plan")[1]
    assert "Broadcast" not in plan
    tree = plan.split("(1)")[0]
    first = next(line for line in tree.splitlines() if "Exchange" in line or "Join" in line)
    assert "Join" in first  # what follows the meeting of groups stays in its task
    assert "Generate" in tree[: tree.index("Join")]


def test_gains_equal_pairs(spark):
    data = [(i, f"c{i % 2}", f"b{i % 3}" if i % 7 else None, f"n{i % 4}", i % 5) for i in range(60)]
    rows = spark.createDataFrame(data, "item long, class string, brand string, name string, size_mm int")
    passes = [("class", "brand", "name"), ("class", "size_mm"), ("brand", "size_mm")]
    names = rows.columns
    want = {}
    for x, y in combinations(data, 2):
        for k, columns in enumerate(passes):
            if all(x[names.index(c)] == y[names.index(c)] is not None for c in columns):
                want[k + 1] = want.get(k + 1, 0) + 1
                break
    assert {r["pass"]: r["gained"] for r in blocking.gains(rows, passes).collect()} == want


@pytest.mark.parametrize("name", sorted(set(pairs.queries()) - {"blocking_pass_gain", "funnel_ratios"}))  # these join counts
def test_queries_on_pairs_stay_in_their_tasks(spark, small, name):
    """What is shuffled is rows and counts: below the meeting of groups by blocks of keys nothing is exchanged but what an aggregate has counted."""
    tree = plan_of(pairs.queries()[name](spark, small)).split("Physical Plan")[1].split("\n\n\n")[0]
    above = tree[: tree.index("SortMergeJoin")]
    for k, line in enumerate(lines := above.splitlines()):
        if "Exchange" in line and "Broadcast" not in line:
            assert "HashAggregate" in lines[k + 1] or "ObjectHashAggregate" in lines[k + 1]
    assert "BroadcastHashJoin" not in tree


def test_copies_of_parts_and_missing_makers(spark, tmp_path):
    rows = [(i, f"n{i % 2}", None if i % 5 == 0 else f"b{i % 3}", "t", i % 4, float(i % 4)) for i in range(30)]
    df = spark.createDataFrame([*rows, *((i + 30, *r) for i, *r in rows)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    df.coalesce(1).write.parquet(str(tmp_path / "part"))
    file = next((tmp_path / "part").glob("*.parquet"))
    file.rename(tmp_path / "part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    for name in ("auto_issue_gate", "queue_facets", "blocking_pass_gain", "blocking_recall", "adjudicate_pairs", "trap_accuracy"):
        found = catalog.queries()[name](spark, str(tmp_path))
        cur = con.execute(catalog.oracle_sql()[name])
        order = [found.columns.index(c[0]) for c in cur.description]
        assert sorted((repr(tuple(r[k] for k in order)) for r in found.collect())) == sorted(map(repr, cur.fetchall())), name


def odd_parts(spark, folder):
    """One class and name of parts in all ways to differ, with copies; others without a name, a class or a partner."""
    sizes, prices = (None, -4, -2, -1, 0, 1, 2, 3, 5, 6, 8), (None, 0.0, -0.0, 9.0, 9.4, 9.5, 10.0, 10.5, 200.0)
    rows = [("n", f"b{k}" if k else None, "t", size, price) for k in range(3) for size in sizes for price in prices]
    rows = [*rows, *rows[::4], *rows[::9], *[("n", "b1", "t", 3, 9.0)] * 7, (None, "b1", "t", 3, 9.0), (None, "b1", "t", 3, 9.0), ("n", "b1", None, 3, 9.0), ("lone", "b1", "t", 3, 9.0), ("two", "b1", "t", 3, 9.0), ("two", "b1", "t", 3, 9.0)]
    df = spark.createDataFrame([(3 * i % 1009, *r) for i, r in enumerate(rows)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    df.coalesce(1).write.parquet(str(folder / "part"))
    next((folder / "part").glob("*.parquet")).rename(folder / "part.parquet")
    return len(rows)


@pytest.mark.parametrize("block", [1024, 4])
def test_scores_of_odd_parts(spark, tmp_path, monkeypatch, block):
    """Every pair with its verdict and band, and none is lost where keys are cut into blocks."""
    monkeypatch.setattr(blocking, "BLOCK", block)
    odd_parts(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    found = pairs.score_pairs(spark, str(tmp_path))
    cur = con.execute(catalog.oracle_sql()["score_pairs"])
    assert [c[0] for c in cur.description] == found.columns
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(cur.fetchall()) and {r[2] for r in got} == {"duplicate", "review", "conflict", "distinct"} and {r[3] for r in got} == {"high", "grey", "low"}


def test_evidence_of_odd_parts(spark, tmp_path):
    """Against the scores of all pairs, one by one."""
    from concordat.plans import frames

    odd_parts(spark, tmp_path)
    every = pairs.pairs(pairs.judged(pairs.groups(spark, str(tmp_path))), "text_a", "text_b", "matched", "compared", "vetoes", "brand_a <> brand_b AS other_maker", "price_a = price_b AS anchor")
    want = sorted(map(repr, frames.scored(every).collect()))
    got = pairs.evidence_score(spark, str(tmp_path)).select("item_a", "item_b", "fuzzy", "agreement", "score", "verdict").collect()
    assert sorted(map(repr, got)) == want and len(want) == pairs.score_pairs(spark, str(tmp_path)).count()


def test_ratios_of_blocks_equal_those_of_pairs(monkeypatch):
    """All texts of a block at once, a few rows at a time, give what two texts alone give, to the last bit."""
    from random import Random

    from concordat.functions import kernels

    r = Random(1)
    words = ["a", "bb", "Brand#1", "Brand#22", "SIZE", "1", "12", "é\U0001f600x", "zz" * 40, "qz" * 35, "large", "ring", *(f"w{k}" for k in range(90))]
    texts = [None, "", "  ", *("  ".join(r.choice(words[: r.choice((12, 102))]) for _ in range(r.randint(1, 8))) for _ in range(60))]
    want = [[kernels.token_set_ratio(a, b) for b in texts] for a in texts]
    for at_once in (1, 500, 1 << 17):
        monkeypatch.setattr(kernels, "AT_ONCE", at_once)
        assert [row.tolist() for few in kernels.token_set_ratios(texts, texts) for row in few] == want
        lo = 0
        for few in kernels.token_set_ratios(texts, texts, half=True):
            assert few.tolist() == [row[lo:] for row in want[lo : lo + len(few)]]
            lo += len(few)


@pytest.mark.parametrize("block", [1024, 3])
def test_similarity_is_computed_once_for_a_block(spark, small, tmp_path, monkeypatch, block):
    """No text is handed to a task pair by pair, and every pair is there once."""
    from concordat.functions import kernels
    from concordat.plans import frames

    monkeypatch.setattr(blocking, "BLOCK", block)
    odd_parts(spark, tmp_path)
    found = pairs.token_set_similarity(spark, str(tmp_path))
    assert "ArrowEvalPython" not in plan_of(found)
    rows = [r for r in frames.items(spark, str(tmp_path)).collect() if r["class"] is not None and r["name"] is not None]
    want = {(min(a["item"], b["item"]), max(a["item"], b["item"])): kernels.token_set_ratio(a["description"], b["description"]) for a, b in combinations(rows, 2) if (a["class"], a["name"]) == (b["class"], b["name"])}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want


@pytest.mark.parametrize("block", [1024, 3])
def test_jaccard_of_blocks(spark, tmp_path, monkeypatch, block):
    """The words of two parts are not compared pair by pair, and every pair of a class and maker is there once."""
    from concordat.plans import frames

    monkeypatch.setattr(blocking, "BLOCK", block)
    odd_parts(spark, tmp_path)
    found = pairs.token_jaccard(spark, str(tmp_path))
    assert "array_intersect" not in plan_of(found)
    rows = [(r["item"], (r["class"], r["brand"]), set(r["description"].split(" "))) for r in frames.items(spark, str(tmp_path)).collect() if r["class"] is not None and r["brand"] is not None]
    want = {(min(a, b), max(a, b)): len(x & y) / len(x | y) for (a, k, x), (b, m, y) in combinations(rows, 2) if k == m}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want


@pytest.mark.parametrize("n", [1_024, 16_384, 102_400])
def test_rows_sent_grow_with_the_root(spark, n):
    """Of one key: the blocks that a row is sent to."""
    assert blocking.sizes(spark.range(n).selectExpr("1 as k", "id"), ["k"], "id").first()["blocks"] == round((n / 1024) ** 0.5)


def test_vetoes_are_counted_without_pairs(spark, tmp_path):
    odd_parts(spark, tmp_path)
    found = pairs.veto_attribute_counts(spark, str(tmp_path))
    assert "ids_a" not in plan_of(found)
    want = duckdb.connect().execute(catalog.oracle_sql()["veto_attribute_counts"].replace("FROM part", f"FROM '{tmp_path}/part.parquet'")).fetchall()
    assert sorted(tuple(r) for r in found.select("attr", "pairs").collect()) == sorted(want) and len(want) == 2


@pytest.mark.parametrize("block", [1024, 3])
def test_private_catalogues_meet_whole(spark, tmp_path, monkeypatch, block):
    """Parts of other names and classes too, where their filters are alike."""
    from concordat.functions import kernels
    from concordat.plans import frames

    monkeypatch.setattr(blocking, "BLOCK", block)
    monkeypatch.setattr(kernels, "AT_ONCE", 7 if block == 3 else 1 << 17)
    rows = [(k, f"{'large small hot'.split()[k % 3]} {'ring bolt'.split()[k // 3 % 2]}", f"Brand#{k % 5}", f"T{k % 4}", k % 7, 1.0) for k in range(-20, 60)]
    rows += [(k + 100, *r) for k, *r in rows[:30]] + [(500, "lone", None, None, None, None)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    bits = {r["item"]: set(kernels.bloom_positions(r["description"].split(" "), b"shared key")) for r in frames.items(spark, str(tmp_path)).collect()}
    want = {(a, b): 2 * len(bits[a] & bits[b]) / (len(bits[a]) + len(bits[b])) for a in bits if a % 2 == 0 for b in bits if b % 2}
    want = {k: v for k, v in want.items() if v >= 0.75}
    got = [tuple(r) for r in pairs.bloom_dice_overlap(spark, str(tmp_path)).collect()]
    key = {k: r for k, *r in rows}
    assert len(got) == len(want) and {(a, b): d for a, b, d in got} == want
    assert any(key[a][0] != key[b][0] for a, b in want) and any(key[a][2] != key[b][2] for a, b in want)


def test_serials_beyond_six_digits_have_no_code(spark, tmp_path):
    df = spark.createDataFrame([(k,) for k in (0, 7, 999_999, 1_000_000, 1_234_567, -5, None)], "p_partkey long")
    df.coalesce(1).write.parquet(str(tmp_path / "part"))
    next((tmp_path / "part").glob("*.parquet")).rename(tmp_path / "part.parquet")
    want = duckdb.connect().execute(catalog.oracle_sql()["damm_check"].replace("FROM part", f"FROM '{tmp_path}/part.parquet'")).fetchall()
    got = [tuple(r) for r in catalog.queries()["damm_check"](spark, str(tmp_path)).select("p_partkey", "code", "valid").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(valid for _, _, valid in got) == 3


def test_recall_of_groups_equals_recall_of_pairs(spark):
    truth = spark.createDataFrame([(f"g{i % 3}", i) for i in range(30)], "group string, id long")
    rows = spark.createDataFrame([(p, f"{i % n}", i) for i in range(28) for p, n in (("class_band", 5), ("identity", 4))], "pass string, key string, id long")
    pairs_of = truth.withColumnRenamed("id", "a").join(truth.withColumnRenamed("id", "b"), "group").where("a < b")
    want = blocking.recall(pairs_of, blocking.candidate_pairs(rows, None)).first()
    assert blocking.recall_of_groups(truth, rows).first() == want and 0 < want["recall"] < 1

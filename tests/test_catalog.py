"""Every query with SQL against DuckDB, row by row; the rest against small fixtures."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from concordat.functions import kernels
from concordat.operators import graph
from concordat.plans import catalog, frames
from concordat.plans.roles import TABLES
from concordat.sources import catalogue
from concordat.streaming import incremental

ORACLE = catalog.oracle_sql()


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, small, duck, name):
    df = catalog.queries()[name](spark, small)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_refined_parts_hold_no_refusal(spark):
    members = spark.createDataFrame([(1, i) for i in range(1, 7)] + [(9, 9)], "component long, id long")
    no = [(1, 1, 2), (1, 2, 3), (1, 4, 5)]
    got = {r["id"]: (r["component"], r["part"]) for r in graph.refine(members, spark.createDataFrame(no, "component long, a long, b long")).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 9} and all(got[a] != got[b] for _, a, b in no)


def test_kernels():
    assert kernels.token_set_ratio("ball valve steel", "steel valve ball") == 1
    assert kernels.token_set_ratio("a b", "a b c") == 1 and kernels.token_set_ratio("", "a") == 0
    assert kernels.indel_ratio("kitten", "sitting") == pytest.approx(1 - 5 / 13)
    assert 0 < kernels.token_set_ratio("ball valve", "gate valve") < 1
    assert kernels.bloom_positions(["a"], b"k") != kernels.bloom_positions(["a"], b"q")
    assert kernels.transliterate("Ünï ﬁ") == "Uni fi"


def test_similarity_of_pairs_that_come_again(spark):
    texts = ["ball valve steel", "steel valve", "gate valve", "", None]
    rows = [(a, b) for a in texts for b in texts] * 2
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", kernels.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r["s"] for r in got] == [kernels.token_set_ratio(a, b) for a, b in rows]


def test_evidence_score(spark, small):
    rows = [(1, 2, "ball valve steel", "steel valve ball", 3, 4, 0, False, False), (1, 3, "ball valve steel", "zzz", 3, 4, 0, False, False), (1, 4, "bolt", "bolt", 0, 0, 0, False, False), (1, 5, "bolt", "bolt", 4, 4, 1, False, True)]
    df = spark.createDataFrame(rows, "item_a long, item_b long, text_a string, text_b string, matched long, compared long, vetoes long, other_maker boolean, anchor boolean")
    got = {r["item_b"]: r for r in frames.scored(df).collect()}
    assert [got[b]["verdict"] for b in (2, 3, 4, 5)] == ["duplicate", "distinct", "duplicate", "conflict"]
    assert got[2]["score"] == pytest.approx((0.34 + 0.42 * 0.75) / 0.76) and got[4]["score"] == 1
    assert got[3]["score"] == pytest.approx((0.34 * kernels.token_set_ratio("ball valve steel", "zzz") + 0.42 * 0.75) / 0.76)
    found = catalog.queries()["evidence_score"](spark, small)
    assert found.count() == catalog.queries()["score_pairs"](spark, small).count() and found.where("fuzzy < 1").count() > 0


def test_catalogue_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('MATNR,MAKTX,MEINS\n1,"bolt, hex",EA\n1,again,EA\n,none,EA\n2,,EA\n3,nut,EA\n', encoding="utf-8-sig")
    df = catalogue.map_headers(catalogue.read_csv(spark, str(tmp_path / "a.csv")))
    rows = df.coalesce(1).withColumn("row_no", F.monotonically_increasing_id())
    good, bad = catalogue.validate(rows, spark.createDataFrame([("3",)], "code string"))
    assert [r["description"] for r in good.collect()] == ["bolt, hex"]
    assert sorted(r["reason"] for r in bad.collect()) == ["code already present", "duplicate code in file", "missing code", "missing description"]
    lines = spark.createDataFrame([("1", 2, "zinc"), ("1", 1, "m8")], "code string, line_no int, text string")
    assert catalogue.with_long_text(good, lines).first()["description"] == "bolt, hex m8 zinc"


def test_incremental_stream_equals_one_run(spark, small, tmp_path):
    items = spark.read.parquet(f"{small}/part.parquet").select(F.col("p_partkey").alias("item"), "p_name", "p_brand").where("item < 600")
    items.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.run_incremental(stream, str(tmp_path / "known"), str(tmp_path / "pairs"), ["p_name", "p_brand"], str(tmp_path / "ck"))
    q.awaitTermination()
    got = {(r["item_a"], r["item_b"]) for r in spark.read.parquet(str(tmp_path / "pairs")).collect()}
    assert got == {(r["item_a"], r["item_b"]) for r in incremental.touching_pairs(items, items, ["p_name", "p_brand"]).collect()} and got


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())

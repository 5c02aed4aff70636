"""Exact neighbours against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from concordat.operators import embedding, neighbours


def clustered(seed, n, width, spread, centres):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, width))
    x = c[r.integers(0, centres, n)] + spread * r.normal(size=(n, width))
    x[: n // 3] = x[0]  # one vector a third of the time
    x[n // 3 : n // 3 + 9] = -x[0]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(ids, code, x, k):
    best = {}
    for c in set(code):
        own = [i for i in range(len(ids)) if code[i] == c]
        s = x[own] @ x[own].T
        for i, row in zip(own, s, strict=True):
            order = sorted((-round(v, 12), ids[j]) for j, v in zip(own, row, strict=True) if j != i)[:k]
            best[ids[i]] = [v for v, _ in order]
    return best


@pytest.mark.parametrize(("spread", "centres"), [(0.05, 12), (1.0, 3)])
def test_dense(spark, monkeypatch, spread, centres):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "CELL", 25)
    x = clustered(1, 700, 12, spread, centres)
    code = ["big" if i % 7 else "small" if i % 2 else "tiny" for i in range(700)]
    code[3], code[5] = "alone", None
    df = spark.createDataFrame(pd.DataFrame({"id": range(700), "class_code": code, "vector": x.tolist()})).repartition(5)
    got = neighbours.k_nearest(df, 6).toPandas()
    want = brute([i for i in range(700) if code[i]], [c for c in code if c], x[[i for i in range(700) if code[i]]], 6)
    for i, rows in got.groupby("id"):
        s = sorted(-rows["cosine"])
        assert len(rows) == len(want[i]) and np.allclose(s, want[i], atol=1e-9)
        assert all(abs(x[i] @ x[j] - c) < 1e-9 for j, c in zip(rows["near"], rows["cosine"], strict=True)) and i not in set(rows["near"])
    assert set(got["id"]) == {i for i, v in want.items() if v}
    pairs = neighbours.nearest_in_class(df, 6).toPandas()
    assert (pairs["a"] < pairs["b"]).all() and not pairs.duplicated(["a", "b"]).any()
    assert {frozenset(p) for p in zip(got["id"], got["near"], strict=True)} == {frozenset(p) for p in zip(pairs["a"], pairs["b"], strict=True)}


def test_work_follows_closeness(spark, monkeypatch):
    """On clustered data blocks are skipped: four times the rows in four times the clusters cost about four times as much."""
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "CELL", 50)
    met = []
    for n in (1000, 4000):
        r = np.random.default_rng(2)
        c = r.normal(size=(n // 50, 24))
        x = c[np.arange(n) % len(c)] + 0.02 * r.normal(size=(n, 24))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame(pd.DataFrame({"id": range(n), "class_code": "c", "vector": x.tolist()}))
        count = spark.sparkContext.accumulator(0)
        real = neighbours.best_pairs
        monkeypatch.setattr(neighbours, "best_pairs", lambda a, own, b, others, k, real=real, count=count: (count.add(len(a) * len(b)), real(a, own, b, others, k))[1])
        assert neighbours.k_nearest(df, 5).count() == 5 * n
        monkeypatch.setattr(neighbours, "best_pairs", real)
        met.append(count.value)
    assert met[1] < 7 * met[0] and met[1] < 0.3 * 4000**2


def sparse(spark, seed, docs, terms):
    r = np.random.default_rng(seed)
    p = 1 / np.arange(1, terms + 1)  # a few terms in nearly all documents
    rows = [(int(d), f"t{t}", float(r.uniform(0.1, 1) * (0.2 if t < 5 else 1))) for d in range(docs) for t in np.unique(r.choice(terms, 12, p=p / p.sum()))]
    return spark.createDataFrame(rows, "id long, term string, weight double")


@pytest.mark.parametrize(("k", "least"), [(3, 0.0), (3, 0.4), (500, 0.0)])
def test_sparse(spark, k, least):
    docs = sparse(spark, 1, 300, 60)
    q = sparse(spark, 2, 25, 70).withColumnRenamed("id", "query")
    got = {(r["query"], r["rank"]): (r["id"], round(r["score"], 9)) for r in neighbours.top_by_terms(docs, q, k, least).collect()}
    d, qq = docs.toPandas(), q.toPandas()
    s = qq.merge(d, on="term").assign(s=lambda t: t.weight_x * t.weight_y).groupby(["query", "id"])["s"].sum().reset_index()
    s = s[s["s"] > least].assign(s=lambda t: t["s"].round(9)).sort_values(["query", "s", "id"], ascending=[True, False, True])
    s["rank"] = s.groupby("query").cumcount() + 1
    want = {(r.query, r.rank): (r.id, r.s) for r in s[s["rank"] <= k].itertuples()}
    assert {x: y[1] for x, y in got.items()} == {x: y[1] for x, y in want.items()}
    assert sum(got[x] == want[x] for x in want) >= 0.98 * len(want)  # sums of equal documents may differ in the last digit


def test_top_documents(spark):
    docs = spark.createDataFrame([(1, "gate valve 50 nb"), (2, "ball bearing"), (3, "gate valve flanged"), (4, None), (5, "")], "id long, text string").select("id", F.coalesce("text", F.lit("")).alias("text"))
    q = spark.createDataFrame([(7, "gate valve flanged"), (8, "nothing known"), (9, "bearing")], "query long, text string")
    got = [(r["query"], r["rank"], r["id"]) for r in embedding.top_documents(docs, q).orderBy("query", "rank").collect()]
    assert got == [(7, 1, 3), (7, 2, 1), (9, 1, 2)]


@pytest.mark.parametrize("frequent", [5, 100_000])
def test_documents_are_found_by_bounds(spark, monkeypatch, frequent):
    """Whatever number of words every task knows, the nearest documents are those of all words' weights; no row of a document and word is written."""
    monkeypatch.setattr(embedding, "FREQUENT", frequent)
    monkeypatch.setattr(embedding, "PART_DOCS", 20)
    r = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{int(t)}" for t in r.zipf(1.4, n) if t < 3000)
    docs = [(k, text(int(r.integers(0, 60)))) for k in range(300)]
    docs += [(1000 + k, docs[k][1]) for k in range(40)] + [(2000, "")]
    asked = [(k, docs[k][1]) for k in range(0, 300, 30)] + [(900, "w1 w2"), (901, "unknown words")]
    d, q = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "query long, text string")
    made = []
    real = embedding.written
    monkeypatch.setattr(embedding, "written", lambda df, folder: (made.append(real(df, folder)), made[-1])[1])
    got = {(x["query"], x["rank"]): (x["id"], round(x["score"], 9)) for x in embedding.top_documents(d, q).collect()}
    assert frequent < 100 or not any({"id", "term"} <= set(t.columns) and t.select("id").distinct().count() > 150 for t in made)
    rows, vocabulary = embedding.weights(d, embedding.word_grams(F.col("text")))
    counts = q.select(F.col("query").alias("id"), F.explode(embedding.word_grams(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    weighed = embedding.weighted(counts, vocabulary, False).select(F.col("id").alias("query"), F.col("term"), F.col("weight").alias("qw"))
    s = rows.join(weighed, "term").groupBy("query", "id").agg(F.sum(F.col("weight") * F.col("qw")).alias("s")).where("s > 0.02").toPandas()
    want = {}
    for query, part in s.groupby("query"):
        best = sorted((-round(v, 12), i) for i, v in zip(part["id"], part["s"], strict=True))[:4]
        want |= {(query, k + 1): (i, round(-v, 9)) for k, (v, i) in enumerate(best)}
    assert got == want and len(want) > 30


def test_cosines_of_a_class_are_whole(spark, monkeypatch):
    """A class of many blocks gives every pair once, and no task holds a class."""
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    monkeypatch.setattr(neighbours, "FEW", 7)
    r = np.random.default_rng(5)
    x = [v.tolist() for v in r.normal(size=(150, 8))]
    x[4], x[9] = None, [1.0, None, *[0.5] * 6]
    label = ["big" if i % 5 else "small" for i in range(150)]
    label[17] = None
    df = spark.createDataFrame([(i, label[i], x[i]) for i in range(150)], "id long, class_code string, vector array<float>").repartition(3)
    got = {(v["a"], v["b"]): v["cosine"] for v in neighbours.cosines_in_class(df).collect()}
    assert set(got) == {(a, b) for a in range(150) for b in range(a + 1, 150) if label[a] is not None and label[a] == label[b]}
    assert neighbours.cosines_in_class(df).count() == len(got)
    for (a, b), c in got.items():
        if {a, b} & {4, 9}:
            assert c is None
        else:
            p, q = (np.asarray(x[i], np.float32).astype(float) for i in (a, b))
            assert abs(c - p @ q / np.linalg.norm(p) / np.linalg.norm(q)) < 1e-6


def test_vectors_are_sent_to_few_blocks(spark, monkeypatch):
    """The blocks that a row is sent to grow with the root of its class: 1000 rows, that is 100 times BLOCK, have 10 and not 100."""
    monkeypatch.setattr(neighbours, "BLOCK", 10)
    df = spark.range(1000).selectExpr("id", "'c' as class_code", "array(cast(1 as float), cast(id as float)) as vector")
    assert neighbours.cosines_in_class(df).count() == 1000 * 999 // 2
    blocks = spark.range(1000).groupBy().agg(neighbours.blocks_of().alias("blocks")).first()["blocks"]
    assert blocks == 10


def test_only_rows_that_ask_look_for_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "CELL", 25)
    x = clustered(4, 400, 10, 1.0, 3)
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "class_code": "c", "vector": x.tolist()}))
    got = neighbours.k_nearest(df, 5, F.col("id") % 50 == 0).toPandas()
    want = brute(list(range(400)), ["c"] * 400, x, 5)
    assert set(got["id"]) == set(range(0, 400, 50)) and len(got) == 40
    assert all(np.allclose(sorted(-rows["cosine"]), want[i], atol=1e-9) for i, rows in got.groupby("id"))


def test_every_row_has_its_neighbours_in_knn_pairs(spark, tmp_path):
    from concordat.plans import materials

    x = np.random.default_rng(6).normal(size=(70, 8)).astype(np.float32)
    ids = [50 * k + 7 for k in range(70)]  # none is divisible by 50
    spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    c = x / np.linalg.norm(x, axis=1)[:, None]
    s = c @ c.T
    np.fill_diagonal(s, -2)
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(70) for j in np.argsort(-s[i])[:10]}
    assert {(r["a"], r["b"]) for r in materials.knn_pairs(spark, str(tmp_path)).collect()} == want

"""Blocks of cells for the nearest-neighbour search, and columns whose names need quoting."""

import random

import numpy as np

from concordat.llm import ann, language_id, ngram_join, quality


def test_blocks_hold_whole_small_cells(monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 10)
    r = random.Random(1)
    sizes = {c: r.choice([1, 2, 3, 9, 10, 11, 35]) for c in range(200)} | {-7: 4, -9: 25}
    first, parts = ann.blocks_of(sizes)
    load: dict = {}
    for c, n in sizes.items():
        assert parts[c] == -(-n // 10)
        for b in range(first[c], first[c] + parts[c]):
            load.setdefault(b, []).append((c, -(-n // parts[c])))
    assert all(sum(n for _, n in own) <= 10 for own in load.values())
    assert all(len(own) == 1 for own in load.values() if any(c < 0 or sizes[c] > 10 for c, _ in own))
    assert sorted(load) == list(range(max(load) + 1))


def test_search_over_many_blocks(spark, monkeypatch):
    """Every cell walked, in many blocks: the exact neighbours."""
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (900, 6)).astype(float)
    x[300:600] = x[300]  # one vector a third of the time
    x[np.abs(x).sum(1) == 0] = 1.0
    monkeypatch.setattr(ann, "BLOCK", 20)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(5)
    got: dict = {}
    for row in ann.nearest(df, reach=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((row["vec_id"], row["score"]))
    hits = total = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        want = [i for i in np.lexsort((np.arange(900), -s)) if i != q][:20]
        assert all(s[i] == v for i, v in got[q]) and [v for _, v in got[q]] == sorted((v for _, v in got[q]), reverse=True)
        hits += len({i for i, _ in got[q]} & set(want))
        total += 20
    assert hits / total >= 0.9


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"some text number {i} of the corpus", "en", 1, 2) for i in range(30)], "doc_id long, text string, lang string, `a.b` int, `x y` int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    for out in (quality.keep_good(docs, labels), language_id.keep_identified(docs), ngram_join.keep_one(docs)):
        assert out.columns == docs.columns and out.count() >= 0

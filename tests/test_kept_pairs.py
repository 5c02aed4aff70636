"""What a run stores of its pairs, and what its queue asks."""

from concordat.operators import matching
from concordat.plans import pipeline

SCORED = "a long, b long, anchor string, fuzzy double, score double, confidence double, band string, verdict string, route string, direction string, vetoed_by array<string>"


def pair(a, b, band="low", verdict="distinct", route="tiered", fuzzy=0.1, score=0.1, direction=None, vetoed=()):
    return (a, b, None, fuzzy, score, score, band, verdict, route, direction, list(vetoed))


def scored(spark):
    rows = [pair(1, 2, "high", "duplicate"), pair(1, 3, "grey", "review"), pair(1, 4, route="veto", fuzzy=0.9, vetoed=["size"]), pair(1, 5, direction="a_to_b"), pair(1, 6, route="manufacturers")]
    return spark.createDataFrame(rows + [pair(2, 10 + i, score=i / 100) for i in range(20)] + [pair(2, 40, "grey", "conflict", "conflict", vetoed=["size"])], SCORED)


def test_trimmed(spark):
    got = [(r["a"], r["b"]) for r in matching.trimmed(scored(spark), 4).collect()]
    assert sorted(got) == [(1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (2, 26), (2, 27), (2, 28), (2, 29), (2, 40)]
    assert len(got) == len(set(got))
    assert matching.trimmed(scored(spark), 1000).count() == scored(spark).count()
    assert matching.trimmed(scored(spark).limit(0)).count() == 0


def test_queue_asks_once(spark):
    run = pipeline.Run(spark, None, "")
    run.tables["scored"] = scored(spark)
    ask = lambda: sorted((r["a"], r["b"], r["kind"], r["assignee"]) for r in pipeline.queue(run).collect())
    assert ask() == [(1, 2, "high", "reviewer"), (1, 3, "grey", "reviewer"), (1, 4, "low sample", "reviewer"), (2, 40, "conflict", "approver")]
    run.decided = spark.createDataFrame([(3, 1), (1, 2), (9, 9)], "a long, b long")
    assert ask() == [(1, 4, "low sample", "reviewer"), (2, 40, "conflict", "approver")]

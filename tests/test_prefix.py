"""Running totals and neighbours over ranges, against one sorted list."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from concordat.operators import chain, learning, prefix


@pytest.mark.parametrize("rows", [7, 50, 10_000])
def test_running_totals(spark, rows):
    r = random.Random(1)
    data = [(r.choice(["a", "b", None]), i if r.random() > 0.05 else None, r.randrange(9), r.choice([None, 1.5])) for i in range(300)]
    r.shuffle(data)
    df = spark.createDataFrame(data, "g string, o long, n long, x double")
    got = {(t["g"], t["o"], t["n"]): (t["before"], t["xs"]) for t in prefix.running(df, ["g"], ["o", "n"], {"before": "n", "xs": "x"}, rows).collect() if t["o"] is not None}
    for g in ("a", "b", None):
        own = sorted((t for t in data if t[0] == g), key=lambda t: (t[1] is not None, t[1] or 0, t[2]))
        n = x = 0
        for t in own:
            if t[1] is not None:
                assert got[t[:3]] == (n, x)
            n, x = n + t[2], x + (t[3] or 0)
    assert prefix.running(df, [], ["o", "n"], {"before": "n"}, rows).agg(F.max("before")).first()[0] <= sum(t[2] for t in data)


def test_no_range_sees_everything(spark):
    df = spark.range(10_000).withColumn("n", F.lit(1))
    out = prefix.running(df, [], ["id"], {"before": "n"}, 1000)
    assert out.where("before <> id").count() == 0
    cut, part = prefix.ranged(df, ["id"], 1000)
    assert cut.groupBy(part).count().agg(F.max("count"), F.count("*")).first()[0] < 2500


def test_auc_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 11)
    r = random.Random(3)
    data = [(r.randrange(60) / 10, r.randrange(2), r.choice("xy")) for _ in range(400)]
    df = spark.createDataFrame(data, "score double, label int, g string")
    def pairs(rows):
        p, n = [s for s, y, _ in rows if y], [s for s, y, _ in rows if not y]
        return sum((a > b) + (a == b) / 2 for a in p for b in n) / (len(p) * len(n))
    assert learning.auc(df).first()["auc"] == pytest.approx(pairs(data))
    got = {t["g"]: t["auc"] for t in learning.auc(df, ["g"]).collect()}
    assert got == pytest.approx({g: pairs([t for t in data if t[2] == g]) for g in "xy"})


@pytest.fixture(scope="module")
def long_chain(spark):
    out, prev = [], chain.GENESIS
    for i in range(3000):
        payload = f'{{"action":"a{i % 3}"}}'
        made = hashlib.sha256(f"{i}|{prev}|{payload}".encode()).hexdigest()
        out.append(("one", i, prev, made, payload))
        prev = made
    return spark.createDataFrame(out, chain.EVENTS), out


def test_one_long_chain_in_ranges(spark, long_chain, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 200)
    events, rows = long_chain
    told = lambda df: tuple(chain.verify(df).select("valid", "first_break", "reason", "events").first())
    assert told(events) == (True, None, None, 3000)
    assert chain.verify(events).first()["head_hash"] == rows[-1][3]
    assert told(events.withColumn("payload", F.when(F.col("seq") == 1777, "{}").otherwise(F.col("payload")))) == (False, 1777, "payload", 3000)
    assert told(events.where("seq <> 600"))[:3] == (False, 601, "sequence")
    assert told(events.withColumn("hash", F.when(F.col("seq") == 1999, F.lit("0" * 64)).otherwise(F.col("hash"))))[:2] == (False, 1999)
    swapped = events.withColumn("seq", F.when(F.col("seq").isin(1200, 1201), 2401 - F.col("seq")).otherwise(F.col("seq")))
    assert told(swapped)[:2] == (False, 1200)
    anchors = spark.createDataFrame([("one", 2999, rows[-1][3]), ("gone", 4, "x")], "chain string, seq long, hash string")
    cut = lambda df: {r["chain"]: r["cut_off"] for r in chain.anchored(chain.verify(df), anchors).collect()}
    assert cut(events) == {"one": False, "gone": True}
    assert cut(events.where("seq < 2990"))["one"] and told(events.where("seq < 2990"))[0]


def test_appending_goes_on_from_the_head(spark, long_chain):
    events, rows = long_chain
    new = spark.createDataFrame([("one", k, f'{{"n":{k}}}') for k in range(30)] + [("two", 1, "{}")], "chain string, place long, payload string")
    more = chain.append(new, events)
    assert [(r["seq"], r["prev_hash"]) for r in more.where("chain = 'one'").orderBy("seq").limit(1).collect()] == [(3000, rows[-1][3])]
    assert {r["chain"]: r["valid"] for r in chain.verify(events.unionByName(more)).collect()} == {"one": True, "two": True}


def test_pages_of_the_queue(spark):
    r = random.Random(2)
    data = [(i, i + 1000, r.randrange(100) / 100) for i in range(95)]
    df = spark.createDataFrame(data, "a long, b long, confidence double")
    seen, after = [], None
    while True:
        page = learning.uncertain(df, after, size=20).cache()
        own = [(x["a"], x["b"]) for x in page.where("not drawn").collect()]
        if not own:
            break
        drawn = [(x["a"], x["b"]) for x in page.where("drawn").collect()]
        assert len(own) <= 16 and len(drawn) <= 4 and not set(drawn) & set(own) and not set(drawn) & set(seen)
        seen += own
        after = learning.page_end(page)
    want = [(a, b) for a, b, c in sorted(data, key=lambda t: (abs(t[2] - 0.5), t[0], t[1]))]
    assert sorted(seen) == sorted(want) and len(seen) == len(set(seen)) == 95

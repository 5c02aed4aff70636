"""Systematic sampling against plain Python: targets by sharing again and again, copies by walking along each source."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from concordat.llm import mixing

SCHEMA = "doc_id long, text string, source string, `a.b` string, Extra string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shared(sizes, weights=(1, 2, 3), cap=3):
    """Targets of sizes in the order of the sources."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    stopped, total = set(), sum(sizes)
    while True:
        left = total - sum(cap * sizes[i] for i in stopped)
        free = [i for i in range(len(sizes)) if i not in stopped]
        share = {i: left * w[i] / sum(w[j] for j in free) for i in free}
        over = {i for i in free if share[i] >= cap * sizes[i]}
        if not over:
            return [float(cap * s) if i in stopped else share[i] for i, s in enumerate(sizes)]
        stopped |= over


def walked(rows, seed=0):
    """Sorted (doc_id, size, source_size, target, copies), one document after another."""
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(words(r[1]) for r in rows if r[2] == s) for s in names}
    target = dict(zip(names, shared([size[s] for s in names]), strict=True))
    out = []
    for s in names:
        digest = hashlib.md5(f"{seed}:{'' if s is None else '=' + s}".encode()).hexdigest()
        at, rate = int(digest[:8], 16), int(target[s] / size[s] * 2**32) if size[s] else 0

        def place(r):
            n = words(r[1])
            drop = max(n.bit_length() - 10, 0)
            slot = "" if r[0] is None else hashlib.md5(str(r[0]).encode()).hexdigest()[:3]
            return n >> drop << drop, slot, n, r[0] is not None, r[0] or 0

        for r in sorted((r for r in rows if r[2] == s), key=place):
            out.append((r[0], words(r[1]), size[s], target[s], ((at + rate) >> 32) - (at >> 32)))
            at += rate
    return sorted(out, key=repr)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = mixing.mix_documents(docs, **options)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "copies"]
    kept = [tuple(r) for r in got.collect()]
    assert all(r[4] == r[1] * r[5] and r[4] <= 3 * r[1] for r in kept)
    return sorted(((r[0], r[1], r[2], r[3], r[5]) for r in kept), key=repr)


def corpus():
    rows = [(i, "w " * (i * 7919 % 53), f"s{i % 7}") for i in range(400)]
    rows += [(1000 + i, "long " * 4000, "big") for i in range(9)] + [(2000, "one", "tiny"), (2001, "two words", "tiny")]
    rows += [(3000, None, "s1"), (3001, "", "nothing"), (3002, " \t\n", "nothing"), (None, "a b", None), (None, "a b", None), (3003, "a b c", None)]
    return rows + [(5, "again " * 3, "s5")] * 5 + [(i, "same", "copies") for i in range(5000, 5300)]


def test_walk(spark):
    rows = corpus()
    assert found(spark, rows) == walked(rows)


def test_other_order_and_seed(spark):
    rows = corpus()
    assert found(spark, rows[::-1]) == walked(rows)
    assert found(spark, rows, seed=5) == walked(rows, 5) != walked(rows)


def test_taken_is_near_the_target(spark):
    rows = [(i, "w " * (1 + i * i % 97), f"s{i % 5}") for i in range(4000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    per = mixing.mix_documents(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(per) == 5 and all(abs(r["taken"] - r["target"]) <= 3 * 97 for r in per)


def test_runs_of_alike_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 7)
    rows = [(1, "a b", "x")] * 50 + [(2, "c", "y")]
    assert found(spark, rows) == walked(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


@pytest.mark.parametrize("sizes", [[10, 0, 5], [0, 0], [1, 1000, 3, 5, 7, 2], [5], [1, 1, 100]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"={i}", s) for i, s in enumerate(sizes)], "key string, source_size long")
    got = [r["target"] for r in mixing.targets(rows).orderBy("key").collect()]
    assert got == pytest.approx(shared(sizes) if any(sizes) else [0.0] * len(sizes))
    assert sum(got) == pytest.approx(sum(sizes))


def test_the_mix_itself(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = mixing.mixed(docs)
    assert out.columns == [*docs.columns, "copy"]
    per = {(r["doc_id"], r["n"]): r["c"] for r in out.groupBy("doc_id", F.coalesce(F.length("text"), F.lit(-1)).alias("n"), "source").agg(F.count("*").alias("c")).collect()}
    want: dict = {}
    for i, n, _, _, c in walked(rows):
        want[i] = want.get(i, 0) + c
    got: dict = {}
    for (i, _), c in per.items():
        got[i] = got.get(i, 0) + c
    assert {k: v for k, v in want.items() if v} == got

"""Record linkage by Fellegi and Sunter: agreement levels of each pair, their weights by expectation maximisation, probabilities.

Pairs enter as frames (a, b), from blocking rules that are equalities. Levels are counted by Spark; the driver sees one row per
distinct combination of levels, of which there are LEVELS to the power of the comparisons at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import kernels
from ..storage import shared_folder, written
from . import blocking, extraction, matching

#: Exact comparisons and the similarity steps of texts (fixed values), the share of true pairs that the part-number rule finds, the
#: pairs drawn for chance agreement, the probability a prediction needs, rounds of the maximisation, the step that ends it.
EXACT, STEPS = ("mpn_norm", "gtin", "class_code", "brand"), (0.92, 0.85, 0.70)
RULE_RECALL, DRAWN, LEAST, ROUNDS, SETTLED = 0.7, 300_000, 0.01, 25, 1e-4


@dataclass(frozen=True)
class Model:
    prior: float
    m: dict[str, list[float]]  # comparison -> probability of each level for matches, lowest level first
    u: dict[str, list[float]]

    def weight(self, name: str, level: int) -> float:
        return float(np.log2(self.m[name][level] / self.u[name][level]))


def folded(items: DataFrame) -> blocking.Copies:
    """Items alike in all that is compared, and in what the rules block on."""
    return blocking.Copies(items, ["mpn_norm", "gtin", "class_code", "attrs", "norm_text", "norm_hash", *(["brand"] if "brand" in items.columns else [])])


def rule_keys(items: DataFrame) -> DataFrame:
    """(pass, key, id): part number, text, class and blocking value."""
    band = F.concat("class_code", F.lit("|"), extraction.block_value(F.col("class_code"), F.col("attrs")))
    keys = F.array(*(F.struct(F.lit(p).alias("pass"), k.alias("key")) for p, k in (("mpn", F.col("mpn_norm")), ("text", F.col("norm_hash")), ("class_band", band))))
    return items.select("id", F.explode(keys).alias("k")).select("k.pass", "k.key", "id").where("key is not null")


def rule_pairs(items: DataFrame) -> DataFrame:
    """(a, b) that agree on the part number, on the text, or on class and blocking value: each once, keys of any size in blocks."""
    return blocking.candidate_pairs(rule_keys(items), None).select("a", "b")


def levels(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(a, b, one level per comparison): -1 where a side is missing, 0 unlike, 1 equal; texts have a level per step passed."""
    own = items.withColumn("brand", F.try_element_at("attrs", F.lit("brand"))) if "brand" not in items.columns else items
    both = matching.with_items(pairs.select("a", "b"), own, [*EXACT, "norm_text"])
    exact = [F.when(F.col(f"{c}_a").isNull() | F.col(f"{c}_b").isNull(), -1).when(F.col(f"{c}_a") == F.col(f"{c}_b"), 1).otherwise(0).alias(c) for c in EXACT]
    s = both.withColumn("_s", kernels.jaro_winkler_of(F.col("norm_text_a"), F.col("norm_text_b")))
    text = sum(F.when(F.col("_s") >= x, 1).otherwise(0) for x in STEPS)
    missing = F.col("norm_text_a").isNull() | F.col("norm_text_b").isNull()
    return s.select("a", "b", *exact, F.when(missing, -1).when(F.col("norm_text_a") == F.col("norm_text_b"), len(STEPS) + 1).otherwise(text).alias("text"))


def depth(name: str) -> int:
    return len(STEPS) + 2 if name == "text" else 2


COMPARED = (*EXACT, "text")


def counted(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct level combinations and how many pairs have each; a row stands for n pairs."""
    got = rows.groupBy(*COMPARED).agg(F.sum("n").alias("n")).collect()  # at most 3^4 * 6 rows
    return np.asarray([[r[c] for c in COMPARED] for r in got], int).reshape(-1, len(COMPARED)), np.asarray([r["n"] for r in got], float)


def shares(combos: np.ndarray, n: np.ndarray, k: int, size: int) -> np.ndarray:
    known = combos[:, k] >= 0
    out = np.bincount(combos[known, k], n[known], size) + 1e-6
    return out / out.sum()


def weighed(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """levels() of pairs (a, b, n) of heads, beside n."""
    pairs = written(pairs.select("a", "b", "n"), shared_folder(heads.sparkSession, "weighed"))
    return levels(pairs, heads).join(pairs.hint("merge"), ["a", "b"])


def fit(items: DataFrame, copies: blocking.Copies | None = None) -> Model:
    """Chance agreement from random pairs, then maximisation over the pairs of rule_pairs(). Pairs of copies are compared once and
    counted as often as they occur; copies: folded() items, if they are known.

    Random pairs are drawn by hash: each row meets the next ones in the order of a hash, DRAWN pairs in all, or one a row.
    """
    copies = copies or folded(items)
    heads, spark = copies.heads, items.sparkSession
    stands = written(copies.members.unionByName(heads.select(F.col("id").alias("head"), "id")), shared_folder(spark, "stands"))
    total = items.count()
    near = max(1, min(20, round(DRAWN / max(total, 1))))
    drawn = items.select("id", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(max(1, total // 4096))).alias("bin")).withColumn("h", F.xxhash64("id", F.lit(7)))
    w = Window.partitionBy("bin").orderBy("h", "id")
    chance = drawn.select("id", F.array(*(F.lead("id", k).over(w) for k in range(1, near + 1))).alias("next")).select("id", F.explode("next").alias("b")).where("b is not null").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
    for side in ("a", "b"):
        chance = chance.join(stands.select(F.col("id").alias(side), F.col("head").alias(f"_{side}")).hint("merge"), side)
    chance = chance.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.count("*").alias("n"))
    combos, n = counted(weighed(chance, heads))
    u = {c: (shares(combos, n, k, depth(c)) if len(n) else np.full(depth(c), 1 / depth(c))) for k, c in enumerate(COMPARED)}

    times = lambda s: heads.select(F.col("id").alias(s), F.col("copies").alias(f"n{s}")).hint("merge")
    unlike = rule_pairs(heads).join(times("a"), "a").join(times("b"), "b").select("a", "b", F.expr("na * nb").alias("n"))
    met = rule_keys(heads).select("id").distinct().hint("merge")
    alike = heads.where("copies > 1").join(met, "id", "left_semi").select(F.col("id").alias("a"), F.col("id").alias("b"), F.expr("copies * (copies - 1) div 2").alias("n"))
    combos, n = counted(weighed(unlike.unionByName(alike), heads))
    by_number = n[combos[:, 0] == 1].sum() if len(n) else 0.0
    all_pairs = max(total * (total - 1) / 2, 1.0)
    prior = float(min(0.5, max(by_number / RULE_RECALL, 1.0) / all_pairs))
    share = float(min(0.95, max(by_number / RULE_RECALL / max(n.sum(), 1.0), 1e-3)))  # of matches among the blocked pairs
    m = {c: np.concatenate([np.full(depth(c) - 1, 0.1 / (depth(c) - 1)), [0.9]]) for c in COMPARED}
    for _ in range(ROUNDS if len(n) else 0):
        p = responsibilities(combos, m, u, share)
        new = {c: shares(combos, n * p, k, depth(c)) for k, c in enumerate(COMPARED)}
        moved = max(float(np.abs(new[c] - m[c]).max()) for c in COMPARED)
        m, share = new, float((n * p).sum() / n.sum())
        if moved < SETTLED:
            break
    return Model(prior, {c: v.tolist() for c, v in m.items()}, {c: v.tolist() for c, v in u.items()})


def responsibilities(combos: np.ndarray, m: dict, u: dict, share: float) -> np.ndarray:
    a, b = np.full(len(combos), np.log(share)), np.full(len(combos), np.log1p(-share))
    for k, c in enumerate(COMPARED):
        known = combos[:, k] >= 0
        a[known] += np.log(np.asarray(m[c]))[combos[known, k]]
        b[known] += np.log(np.asarray(u[c]))[combos[known, k]]
    return 1 / (1 + np.exp(np.clip(b - a, -700, 700)))


def predict(model: Model, pairs: DataFrame, items: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, weight, probability, waterfall): each pair's summed log2 weights and what each comparison adds; pairs below
    ``least`` are left out."""
    rows = levels(pairs, items)
    def weight(c: str):
        table = F.array(*(F.lit(model.weight(c, k)) for k in range(depth(c))))
        return F.when(F.col(c) >= 0, F.get(table, F.col(c))).otherwise(0.0)

    falls = F.create_map(*(x for c in COMPARED for x in (F.lit(c), weight(c))))
    start = float(np.log2(model.prior / (1 - model.prior)))
    total = F.lit(start) + sum(weight(c) for c in COMPARED)
    p = 1 / (1 + F.pow(F.lit(2.0), -F.greatest(F.least(total, F.lit(500.0)), F.lit(-500.0))))
    return rows.select("a", "b", total.alias("weight"), p.alias("probability"), falls.alias("waterfall")).where(F.col("probability") >= least)

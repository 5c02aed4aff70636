"""Private linkage: two companies compare keyed Bloom filters of their rows, never the rows; scopes; what an automatic issue needs.

Filters are compared block by block as matrix products, the stated rows of one side against all rows of the other; a task hands on the
pairs that reach the threshold and nothing else.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import held
from .learning import with_f1

# Fixed values per mode: bits and hashes of a filter, the Dice of a match, the Dice worth reporting.
MODES = {"attribute": (512, 30, 0.88, 0.75), "ngram": (1024, 10, 0.90, 0.80)}
GRAM, BLOCK = 3, 2048
#: Roles that see every company's rows.
ALL_SEEING = ("registrar", "auditor", "admin")


def attribute_features(class_code: Column, attrs: Column, mpn: Column) -> Column:
    """class=..., attribute=value in order, mpn=...; attributes whose name starts with an underscore are private."""
    public = F.array_sort(F.map_entries(F.map_filter(attrs, lambda k, v: ~k.startswith("_") & v.isNotNull())))
    own = F.transform(public, lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    number = F.when(mpn.isNotNull(), F.array(F.concat(F.lit("mpn="), mpn))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.concat(F.lit("class="), class_code)), own, number)


def gram_features(text: Column, n: int = GRAM) -> Column:
    """Sliding n-grams; a text shorter than n stands between two spaces on either side."""
    t = F.trim(F.coalesce(text, F.lit("")))
    padded = F.when(F.length(t) < n, F.concat(F.lit("  "), t, F.lit("  "))).otherwise(t)
    return F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))


def encode(items: DataFrame, key: bytes, mode: str = "attribute") -> DataFrame:
    """(alias, bits): a pseudonym and the sorted set bits of each row; all that leaves a company. items: id, company, class_code, attrs,
    mpn_norm, norm_text. Nulls add no feature."""
    bits, hashes, _, _ = MODES[mode]
    features = attribute_features(F.coalesce("class_code", F.lit("")), F.coalesce("attrs", F.create_map().cast("map<string,string>")), F.col("mpn_norm")) if mode == "attribute" else gram_features(F.col("norm_text"))
    alias = kernels.pseudonym(F.concat_ws(":", "company", F.col("id").cast("string")), key)
    return held(items, features=features).select(alias.alias("alias"), kernels.bloom(F.col("features"), key, bits, hashes).alias("bits"))


def compare(left: DataFrame, right: DataFrame, mode: str = "attribute", least: float | None = None) -> DataFrame:
    """(left, right, dice, match) of pairs whose Dice is worth reporting."""
    size, _, match, report = MODES[mode]
    least = report if least is None else least
    blocks = lambda df: max(1, -(-df.count() // BLOCK))
    n, m = blocks(left), blocks(right)
    own = lambda df, k: F.pmod(F.xxhash64("alias"), F.lit(k)).cast("int")
    a = left.withColumn("x", own(left, n)).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    b = right.withColumn("y", own(right, m)).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def matrix(rows: pd.Series) -> np.ndarray:
        out = np.zeros((len(rows), size), np.float32)
        for k, bits in enumerate(rows):
            out[k, np.asarray(bits, np.int64)] = 1
        return out

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"left": [], "right": [], "dice": []})
        u, v = matrix(p["bits"]), matrix(q["bits"])
        every = u.sum(1)[:, None] + v.sum(1)[None, :]
        d = np.divide(2 * (u @ v.T), every, out=np.zeros_like(every), where=every > 0).astype(np.float64)
        i, j = np.nonzero(d >= least)
        return pd.DataFrame({"left": p["alias"].to_numpy()[i], "right": q["alias"].to_numpy()[j], "dice": d[i, j]})

    met = a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInPandas(meet, "left string, right string, dice double")
    return met.withColumn("match", F.col("dice") >= match)


def evaluate(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of matches (left, right) against true pairs (left, right)."""
    f, t = found.where("match").select("left", "right", F.lit(1).alias("f")).distinct(), truth.select("left", "right", F.lit(1).alias("t")).distinct()
    n = f.join(t, ["left", "right"], "full").agg(F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    return with_f1(n)


def scope(role: str, company: str | None) -> str | None:
    """The company whose prices a role sees; None for all. A role that sees its own company only must have one."""
    if role in ALL_SEEING:
        return None
    return company or ""


def price_band(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by..., low, high, mean, n) of positive prices: what may be shown of prices that are not."""
    return rows.where("price > 0").groupBy(*by).agg(F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("mean"), F.count("*").alias("n"))


def auto_issue(clusters: DataFrame, scored: DataFrame, class_of: DataFrame, precision: DataFrame, least: dict[str, float] | None = None, default: float = 0.98) -> DataFrame:
    """(cluster, may_issue, reason): clusters that may get a code with nobody looking: two members or more, all their scored pairs anchored,
    in full agreement and neither vetoed nor in conflict, none waiting for review, and a class (cluster, class_code) whose measured
    precision (class_code, precision) suffices. The reason is the first gate that fails."""
    own = lambda s: clusters.select(F.col("id").alias(s), F.col("cluster").alias(f"c{s}"))
    pairs = scored.join(own("a"), "a").join(own("b"), "b").where("ca = cb")
    per = pairs.groupBy(F.col("ca").alias("cluster")).agg(
        F.bool_and(F.col("anchor").isNotNull()).alias("anchored"), F.bool_and(F.coalesce(F.col("agreement") == 1, F.lit(False))).alias("agreed"),
        F.bool_or((F.size("vetoed_by") > 0) | (F.col("verdict") == "conflict")).alias("refused"), F.bool_or(F.col("band") == "grey").alias("pending"),
    )
    wanted = F.lit(default)
    for code, x in (least or {}).items():
        wanted = F.when(F.col("class_code") == code, x).otherwise(wanted)
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    rows = sizes.join(per, "cluster", "left").join(class_of.select("cluster", "class_code"), "cluster", "left").join(precision.select("class_code", "precision"), "class_code", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    reason = F.when(F.col("n") < 2, "one member").when(F.coalesce("refused", F.lit(False)), "veto or conflict").when(F.coalesce("pending", F.lit(False)), "waits for review").when(no("anchored"), "not anchored").when(no("agreed"), "no full agreement").when(~F.coalesce(F.col("precision") >= wanted, F.lit(False)), "class precision")
    return rows.withColumn("reason", reason).select("cluster", F.col("reason").isNull().alias("may_issue"), "reason")


def reason_tally(gates: DataFrame) -> DataFrame:
    return gates.groupBy(F.coalesce("reason", F.lit("issued")).alias("reason")).agg(F.count("*").alias("clusters"))


def differing(candidates: DataFrame) -> DataFrame:
    """(attr, values): attributes on which candidates (id, attrs) don't agree; a missing value is one of its own."""
    n = candidates.count()
    rows = candidates.select("id", F.explode("attrs").alias("attr", "value")).where("value is not null")
    per = rows.groupBy("attr").agg(F.count_distinct("value").alias("values"), F.count("*").alias("have"))
    return per.withColumn("values", F.col("values") + F.when(F.col("have") < n, 1).otherwise(0)).where("values > 1").select("attr", "values")

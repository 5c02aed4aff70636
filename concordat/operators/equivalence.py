"""Directed equivalences between items: published interchanges, equal designations, substitution rules, ratings.

Rules are data. A rule text is compiled to Column expressions; a pair takes the first source that speaks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes
from ..functions.classes import IDENTITY, SCHEMA, MaterialClass
from ..functions.columns import held
from ..functions.numbers import EXACT, parse_number, values_equal
from . import extraction, matching

# How sure each source is.
CONFIDENCE = {"crossref": 0.98, "designation": 0.95, "rule": 0.85, "rating": 0.80}
VERDICT = "struct<rel_type:string,direction:string,basis:string,confidence:double>"


@dataclass(frozen=True)
class Rule:
    class_code: str
    equivalent_if: tuple[tuple[str, str], ...] = ()
    substitutable_if: tuple[tuple[str, str], ...] = ()
    never_if: tuple[tuple[str, str], ...] = ()


def parse_rules(text: str) -> list[Rule]:
    """Rules from a block text: ``class: CODE`` starts one, ``equivalent_if:``, ``substitutable_if:`` and ``never_if:`` head lists of
    ``- attribute operator`` lines (==, !=, >=, <=), also written inline as [a ==, b >=]. Lines that say nothing are passed over."""
    rules, now, part = [], None, None
    condition = re.compile(r"(\w+)\s*(==|!=|>=|<=)")

    def close() -> None:
        if now and now["class"]:
            rules.append(Rule(now["class"], *(tuple(now[p]) for p in ("equivalent_if", "substitutable_if", "never_if"))))

    for line in text.splitlines():
        body = line.strip().removeprefix("- ").strip().strip("\"'")
        name, colon, rest = body.partition(":")
        if colon and name.strip() == "class":
            close()
            now, part = {"class": rest.strip().strip("\"'"), "equivalent_if": [], "substitutable_if": [], "never_if": []}, None
        elif colon and now and name.strip() in now:
            part = name.strip()
            now[part] += condition.findall(rest)
        elif now and part and (found := condition.fullmatch(body)):
            now[part].append(found.groups())
    close()
    return rules


def holds(condition: tuple[str, str], a: Column, b: Column) -> Column:
    """True, false, or null where a value is missing or no number. ``>=`` reads: b meets or exceeds a."""
    name, op = condition
    x, y = F.try_element_at(a, F.lit(name)), F.try_element_at(b, F.lit(name))
    if op in ("==", "!="):
        same = F.when(x.isNotNull() & y.isNotNull(), values_equal(x, y))
        return same if op == "==" else ~same
    left, right = parse_number(x)["value"], parse_number(y)["value"]
    return right >= left - EXACT if op == ">=" else right <= left + EXACT


def all_hold(conditions: tuple, a: Column, b: Column) -> Column:
    """All true; an empty list isn't."""
    out = F.lit(bool(conditions))
    for c in conditions:
        out = out & F.coalesce(holds(c, a, b), F.lit(False))
    return out


def verdict(rel_type, direction, basis: str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(rel_type).alias("rel_type"), lit(direction).alias("direction"), F.lit(basis).alias("basis"), F.lit(CONFIDENCE[basis]).alias("confidence"))


def by_rules(rules: list[Rule], class_code: Column, a: Column, b: Column) -> Column:
    """The first rule set of the class that speaks; a ``never_if`` that holds ends the search for the pair."""
    out = F.lit(None).cast(VERDICT)
    for rule in reversed(rules):
        never = F.lit(False)
        for c in rule.never_if:
            never = never | F.coalesce(holds(c, a, b), F.lit(False))
        base, up, down = all_hold(rule.equivalent_if, a, b), all_hold(rule.substitutable_if, a, b), all_hold(rule.substitutable_if, b, a)
        found = F.when(up & down, verdict("equivalent", "bidirectional", "rule")).when(up, verdict("supersedes", "a_to_b", "rule")).when(down, verdict("supersedes", "b_to_a", "rule"))
        mine = class_code == rule.class_code
        out = F.when(mine & never, F.lit(None).cast(VERDICT)).when(mine & base & (up | down), found).otherwise(out)
    return out


def designated(text: Column, class_code: Column) -> Column:
    """struct<kind, values>: the standard designation a text carries for its class, as a map."""
    t = F.upper(F.coalesce(text, F.lit("")))
    string = lambda x: x.cast("string")
    def made(kind: str, d: Column, names: list[str]) -> Column:
        values = F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), string(d[n])))), lambda _, v: v.isNotNull())
        return F.when(d.isNotNull(), F.struct(F.lit(kind).alias("kind"), values.alias("values")))

    flange = made("flange_class", extraction.flange(t), ["pressure_class"])
    return (
        F.when(class_code == "bearing.ball.deep_groove", made("bearing", extraction.bearing(t), ["bore_mm", "outer_dia_mm", "width_mm", "seal_type"]))
        .when(class_code == "pipe.seamless", made("pipe_schedule", extraction.pipe(t), ["nps_mm", "schedule"]))
        .when(class_code.isin("valve.gate", "gasket.spiral_wound"), flange)
        .when(class_code == "fastener.bolt.hex", F.coalesce(made("metric_thread", extraction.thread(t), ["thread"]), made("fastener_grade", extraction.fastener(t), ["grade"])))
    )


def by_designation(class_code: Column, x: Column, y: Column, a: Column, b: Column, schema: dict[str, MaterialClass]) -> Column:
    """Designations of one kind whose shared identity attributes agree, where all other identity attributes are known and agree."""
    own = F.create_map(*(v for code, c in schema.items() for v in (F.lit(code), F.array(*map(F.lit, c.names(IDENTITY))) if c.names(IDENTITY) else F.array().cast("array<string>"))))
    identity = F.try_element_at(own, class_code)
    both = F.array_intersect(F.map_keys(x["values"]), F.map_keys(y["values"]))
    critical = F.array_intersect(both, identity)
    shared = F.when(F.size(critical) > 0, critical).otherwise(both)
    agree = F.forall(shared, lambda n: values_equal(F.try_element_at(x["values"], n), F.try_element_at(y["values"], n)))
    rest = F.forall(F.array_except(identity, shared), lambda n: F.coalesce((F.try_element_at(a, n).isNotNull()) & (F.try_element_at(b, n).isNotNull()) & values_equal(F.try_element_at(a, n), F.try_element_at(b, n)), F.lit(False)))
    ok = (x["kind"] == y["kind"]) & (F.size(shared) > 0) & agree & rest
    return F.when(ok, verdict("equivalent", "bidirectional", "designation"))


def crossref_table(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(x, y) in both directions from a published list (mpn_a, mpn_b): part numbers normalised, self-pairs, unreadable ones and
    those already ``known`` out."""
    clean = rows.select(codes.part_number("mpn_a").alias("x"), codes.part_number("mpn_b").alias("y")).where("x is not null and y is not null and x <> y")
    both = clean.unionByName(clean.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    return both if known is None else both.join(known.select("x", "y"), ["x", "y"], "left_anti")


def relations(pairs: DataFrame, items: DataFrame, rules: list[Rule] = (), crossrefs: DataFrame | None = None, clusters: DataFrame | None = None, schema: dict[str, MaterialClass] = SCHEMA) -> DataFrame:
    """(a, b, rel_type, direction, basis, confidence) with a < b, one row per pair, for pairs of one class.

    Order: interchange list, designation (both unless identity attributes differ; ratings direct them), rules (which may span a
    difference of identity, but then don't make equivalents), ratings. Pairs within one cluster (id, cluster) are left out.
    """
    ordered = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rows = matching.with_items(ordered, items, ["class_code", "attrs", "mpn_norm", "norm_text"]).where("class_code_a = class_code_b")
    if clusters is not None:
        own = lambda s: clusters.select(F.col("id").alias(s), F.col("cluster").alias(f"cluster_{s}"))
        rows = rows.join(own("a"), "a", "left").join(own("b"), "b", "left").where("cluster_a is null or cluster_b is null or cluster_a <> cluster_b").drop("cluster_a", "cluster_b")
    if crossrefs is None:
        rows = rows.withColumn("listed", F.lit(False))
    else:
        flag = crossrefs.select(F.col("x").alias("mpn_norm_a"), F.col("y").alias("mpn_norm_b"), F.lit(True).alias("listed")).distinct()
        rows = rows.join(flag, ["mpn_norm_a", "mpn_norm_b"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    code, a, b = F.col("class_code_a"), F.col("attrs_a"), F.col("attrs_b")
    rows = held(rows, compared=matching.comparison(code, a, b, schema), da=designated(F.col("norm_text_a"), code), db=designated(F.col("norm_text_b"), code))
    rows = matching.judged(rows).withColumn("blocked", F.exists("compared", lambda c: c["veto"] & (c["role"] == IDENTITY)))
    symmetric = F.coalesce(F.when(F.col("listed"), verdict("equivalent", "bidirectional", "crossref")), by_designation(code, F.col("da"), F.col("db"), a, b, schema))
    rows = held(rows, s=F.when(~F.col("blocked"), symmetric), r=by_rules(list(rules), code, a, b))
    directed = F.when(F.col("direction").isNotNull(), F.struct(F.lit("supersedes").alias("rel_type"), F.col("direction"), F.col("s.basis").alias("basis"), F.col("s.confidence").alias("confidence"))).otherwise(F.col("s"))
    identity = F.filter("compared", lambda c: c["role"] == IDENTITY)
    rated = F.when(F.col("direction").isNotNull() & F.forall(identity, lambda c: c["result"] != "unknown"), verdict("supersedes", F.col("direction"), "rating"))
    found = F.when(F.col("s").isNotNull(), directed).when(F.col("r").isNotNull(), F.when(~(F.col("blocked") & (F.col("r.rel_type") == "equivalent")), F.col("r"))).when(~F.col("blocked"), rated)
    return rows.withColumn("v", found).where("v is not null").select("a", "b", "v.*")


def listing(relations: DataFrame, approvals: DataFrame | None = None, fitted: DataFrame | None = None) -> DataFrame:
    """Relations with the latest decision on each and whether one side is fitted to equipment; fitted ones first, then the surest.

    approvals: a, b, decided_at, status; fitted: id.
    """
    out = relations.withColumn("status", F.lit("open"))
    if approvals is not None:
        latest = approvals.groupBy("a", "b").agg(F.max_by("status", F.struct("decided_at", "status")).alias("decided"))
        out = out.join(latest, ["a", "b"], "left").withColumn("status", F.coalesce("decided", "status")).drop("decided")
    if fitted is not None:
        on = lambda s: fitted.select(F.col("id").alias(s), F.lit(True).alias(f"f{s}")).distinct()
        out = out.join(on("a"), "a", "left").join(on("b"), "b", "left").withColumn("fitted", F.coalesce("fa", F.lit(False)) | F.coalesce("fb", F.lit(False))).drop("fa", "fb")
    else:
        out = out.withColumn("fitted", F.lit(False))
    return out.orderBy(F.desc("fitted"), F.desc("confidence"), "a", "b")

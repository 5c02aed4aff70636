"""Pairs of rows compared attribute by attribute, scored and judged.

Items: id, class_code, norm_text, norm_hash, mpn_norm, gtin, attrs (map attribute -> text), and a vector if there are
embeddings. A pair's comparison is one pass over the attribute list of its class within a row: nothing is exploded, and no
shuffle follows the join of the pair with its two items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.classes import IDENTITY, PERFORMANCE, SCHEMA, UNCLASSIFIED, MaterialClass
from ..functions.columns import held, let, lookup
from ..functions.numbers import EXACT, overlaps, parse_number

# Weights of the score, bands, what an anchor is worth, when evidence is thin.
FUZZY, SEMANTIC, AGREEMENT = 0.34, 0.24, 0.42
HIGH, LOW, ANCHORED, THIN_CAP, LEAST_COVERAGE = 0.86, 0.45, 0.74, 0.85, 0.6
ANCHORS = {"mpn": 1.0, "gtin": 1.0, "norm_text": 0.95}


def specs(schema: dict[str, MaterialClass]) -> Column:
    """map<class, array<struct<name, numeric, role, percent, higher>>>, a constant."""
    def one(a) -> Column:
        return F.struct(F.lit(a.name).alias("name"), F.lit(a.kind == "numeric").alias("numeric"), F.lit(a.role).alias("role"), F.lit(float(a.percent or 0)).alias("percent"), F.lit(a.higher_ok).alias("higher"))

    return F.create_map(*(x for code, c in schema.items() for x in (F.lit(code), F.array(*map(one, c.attributes.values())))))


def outcome(a: Column, b: Column, x: Column, y: Column, spec: Column) -> Column:
    """unknown, match, in_band, mismatch or out_of_band of two values; x and y are their parse_number()."""
    refused = F.when(spec["role"] == IDENTITY, "mismatch").otherwise("out_of_band")
    apart = F.abs(x["value"] - y["value"])
    allowed = spec["percent"] / 100 * F.greatest(F.abs(x["value"]), F.abs(y["value"]))
    numbers = (
        F.when(x.isNull() | y.isNull() | (x["fit_class"].isNull() != y["fit_class"].isNull()), "unknown")
        .when(x["fit_class"].isNotNull(), F.when(x["fit_class"] == y["fit_class"], "match").otherwise(refused))
        .when(x["is_range"] | y["is_range"], F.when(overlaps(x, y), "match").otherwise(refused))
        .when(apart <= EXACT, "match").when(apart <= allowed, "in_band").otherwise(refused)
    )
    texts = F.when(F.upper(F.trim(a)) == F.upper(F.trim(b)), "match").otherwise(F.when(spec["role"] == PERFORMANCE, "out_of_band").otherwise("mismatch"))
    return F.when(a.isNull() | b.isNull(), "unknown").when(spec["numeric"], numbers).otherwise(texts)


def comparison(class_code: Column, a: Column, b: Column, schema: dict[str, MaterialClass] = SCHEMA) -> Column:
    """array<struct<attr, role, a, b, result, veto, x, y>> for two attribute maps of one class; x and y are the numbers of ratings that
    may be exceeded."""
    def one(s: Column) -> Column:
        left, right = F.try_element_at(a, s["name"]), F.try_element_at(b, s["name"])
        number = lambda v: parse_number(F.when(s["numeric"], v))
        return let(F.struct(left.alias("a"), right.alias("b"), number(left).alias("x"), number(right).alias("y")), lambda v: let(outcome(v["a"], v["b"], v["x"], v["y"], s), lambda r: told(s, v, r)))

    def told(s: Column, v: Column, result: Column) -> Column:
        veto = ((s["role"] == IDENTITY) & (result == "mismatch")) | ((s["role"] == PERFORMANCE) & (result == "out_of_band"))
        return F.struct(s["name"].alias("attr"), s["role"].alias("role"), v["a"].alias("a"), v["b"].alias("b"), result.alias("result"), veto.alias("veto"), F.when(s["higher"], v["x"]["value"]).alias("x"), F.when(s["higher"], v["y"]["value"]).alias("y"))

    return F.transform(F.try_element_at(specs(schema), class_code), one)


def direction(compared: Column) -> Column:
    """a_to_b if b meets or exceeds a in every rating that may be exceeded, and not the other way round; b_to_a likewise."""
    rated = F.filter(compared, lambda c: c["x"].isNotNull() & c["y"].isNotNull())
    up, down = ~F.exists(rated, lambda c: c["y"] < c["x"] - EXACT), ~F.exists(rated, lambda c: c["x"] < c["y"] - EXACT)
    return F.when((F.size(rated) > 0) & up & ~down, "a_to_b").when((F.size(rated) > 0) & down & ~up, "b_to_a")


def with_items(pairs: DataFrame, items: DataFrame, names: list[str]) -> DataFrame:
    """(a, b) with the named columns of both items, as name_a and name_b. Items are never broadcast: their size in a file tells little of
    the maps and texts that a task would hold."""
    out = pairs
    for side in ("a", "b"):
        out = out.join(items.select(F.col("id").alias(side), *(F.col(n).alias(f"{n}_{side}") for n in names)).hint("merge"), side)
    return out


def compare_pairs(pairs: DataFrame, items: DataFrame, schema: dict[str, MaterialClass] = SCHEMA) -> DataFrame:
    """Per pair (a, b) of one class: compared (the list), n_compared, matched, vetoed_by, agreement, verdict (match,
    tolerance_match, veto), direction of a substitution if only ratings veto. Pairs of unlike classes have no list."""
    both = with_items(pairs, items, ["class_code", "attrs"])
    listed = F.when(F.col("class_code_a") == F.col("class_code_b"), comparison(F.col("class_code_a"), F.col("attrs_a"), F.col("attrs_b"), schema))
    return judged(held(both, compared=F.coalesce(listed, F.array().cast(list_type()))).select(*pairs.columns, "compared"))


def list_type() -> str:
    return "array<struct<attr:string,role:string,a:string,b:string,result:string,veto:boolean,x:double,y:double>>"


def judged(rows: DataFrame) -> DataFrame:
    c = F.col("compared")
    known = F.filter(c, lambda x: x["result"] != "unknown")
    vetoes = F.transform(F.filter(c, lambda x: x["veto"]), lambda x: x["attr"])
    good = F.transform(F.filter(c, lambda x: x["result"].isin("match", "in_band")), lambda x: x["attr"])
    only_ratings = F.forall(F.filter(c, lambda x: x["veto"]), lambda x: x["role"] == PERFORMANCE)
    out = held(rows, n_compared=F.size(known), matched=good, vetoed_by=vetoes)
    verdict = F.when(F.size("vetoed_by") > 0, "veto").when(F.exists(c, lambda x: x["result"] == "in_band"), "tolerance_match").otherwise("match")
    return held(out, agreement=F.try_divide(F.size("matched").cast("double"), F.col("n_compared")), verdict=verdict, direction=F.when((F.size("vetoed_by") > 0) & only_ratings, direction(c)))


def anchor(names: dict[str, tuple[Column, Column]]) -> Column:
    """The strongest exact key that both sides share."""
    out = None
    for name, (x, y) in names.items():
        hit = (x == y) & (x != "")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def band(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence < LOW, "low").otherwise("grey")


def cosine(a: Column, b: Column) -> Column:
    """Of any two vectors, between 0 and 1; 0 if one is missing, empty, zero, or of another length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(F.size(a) == F.size(b), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))).otherwise(0.0)


def score_pairs(pairs: DataFrame, items: DataFrame, schema: dict[str, MaterialClass] = SCHEMA, linkage: DataFrame | None = None) -> DataFrame:
    """Per pair: anchor, fuzzy, semantic, agreement, score, confidence, band, verdict, route, thin, direction, vetoed_by.

    linkage: (a, b, probability) of pairs that a linkage model scored; others take the token-set ratio. Without a vector column
    the semantic signal is missing and the other weights stand in for it. Null texts resemble nothing.
    """
    names = ["class_code", "attrs", "norm_text", "norm_hash", "mpn_norm", "gtin"] + (["vector"] if "vector" in items.columns else [])
    both = with_items(pairs.select("a", "b"), items, names)
    if linkage is not None:
        both = both.join(linkage.select("a", "b", "probability"), ["a", "b"], "left")
    side = lambda n: (F.col(f"{n}_a"), F.col(f"{n}_b"))
    same = (F.col("class_code_a") == F.col("class_code_b")) & (F.col("class_code_a") != UNCLASSIFIED)
    listed = F.when(same, comparison(F.col("class_code_a"), *side("attrs"), schema))
    fuzzy = kernels.similarity(*side("norm_text"))
    rows = both.withColumn("fuzzy", F.coalesce("probability", fuzzy) if linkage is not None else fuzzy)
    semantic = cosine(*side("vector")) if "vector" in items.columns else F.lit(None).cast("double")
    keys = anchor({"mpn": side("mpn_norm"), "gtin": side("gtin"), "norm_text": side("norm_hash")})
    rows = held(rows, compared=F.coalesce(listed, F.array().cast(list_type())), semantic=semantic, anchor=keys, same=F.coalesce(same, F.lit(False)))
    rows = judged(rows).withColumnRenamed("verdict", "comparison")
    # weights of the signals that the pair has
    parts = [(FUZZY, F.col("fuzzy")), (SEMANTIC, F.col("semantic")), (AGREEMENT, F.col("agreement"))]
    weight = sum(F.when(x.isNotNull(), w).otherwise(0.0) for w, x in parts)
    rows = held(rows, score=F.try_divide(sum(w * F.coalesce(x, F.lit(0.0)) for w, x in parts), weight))
    identity = F.filter("compared", lambda c: c["role"] == IDENTITY)
    read = F.size(F.filter(identity, lambda c: c["result"] != "unknown"))
    defining = lookup(F.col("class_code_a"), {code: c.block_on for code, c in schema.items() if c.block_on})
    unread = defining.isNotNull() & ~F.exists("compared", lambda c: (c["attr"] == defining) & (c["result"] != "unknown"))
    thin = (read < 1) | (F.coalesce(F.try_divide(read, F.size(identity)), F.lit(1.0)) < LEAST_COVERAGE) | unread
    strong = F.coalesce(F.col("anchor").isin("mpn", "gtin"), F.lit(False))
    worth = F.coalesce(lookup(F.col("anchor"), ANCHORS), F.lit(0.0))
    brands = F.try_element_at("attrs_a", F.lit("brand")), F.try_element_at("attrs_b", F.lit("brand"))
    makers = F.coalesce(brands[0] != brands[1], F.lit(False))
    raised = F.when(F.col("anchor").isNotNull(), F.least(F.lit(1.0), ANCHORED + (1 - ANCHORED) * F.col("score"))).otherwise(F.col("score"))
    veto = F.size("vetoed_by") > 0
    route = F.when(~F.col("same"), "anchor_only").when(veto & strong, "conflict").when(veto, "veto").when(makers, "manufacturers").otherwise("tiered")
    rows = held(rows, thin=thin & F.col("same"), route=route, raised=raised)
    capped = F.when(F.col("thin") & ~strong, F.least("raised", F.lit(THIN_CAP))).otherwise(F.col("raised"))
    rows = held(rows, raw=F.when(F.col("route").isin("anchor_only", "conflict"), worth).when(F.col("route") == "tiered", capped).otherwise(0.0))
    rows = rows.withColumn("band", F.when(F.col("route") == "conflict", "grey").when(F.col("route").isin("veto", "manufacturers"), "low").otherwise(band(F.col("raw"))))
    by_band = F.when(F.col("band") == "high", "duplicate").when(F.col("band") == "grey", "review").otherwise("distinct")
    verdict = F.when(F.col("route") == "anchor_only", F.when(F.col("anchor").isNotNull(), "duplicate").otherwise("distinct")).when(F.col("route") == "conflict", "conflict").otherwise(by_band)
    return rows.select("a", "b", "anchor", "fuzzy", "semantic", "agreement", "score", F.round("raw", 4).alias("confidence"), "band", verdict.alias("verdict"), "route", "thin", "direction", "vetoed_by")


def worth_keeping(scored: DataFrame) -> DataFrame:
    """Pairs worth storing: not low, or refused although the texts are close, or substitutes of each other."""
    return scored.where("band <> 'low' or (size(vetoed_by) > 0 and fuzzy >= 0.80) or direction is not null or route = 'manufacturers'")


def confident_refusals(scored: DataFrame, most: int = 5000) -> DataFrame:
    """The refused pairs of highest score: a top-k report."""
    return scored.where("verdict = 'distinct'").orderBy(F.desc("score"), "a", "b").limit(most)


def trimmed(scored: DataFrame, refusals: int = 5000) -> DataFrame:
    """What a run stores of its pairs: those worth keeping, and the refusals of highest score as examples of what is not the same."""
    rest = confident_refusals(scored, refusals).select("a", "b")
    kept = worth_keeping(scored)
    return kept.unionByName(scored.join(F.broadcast(rest), ["a", "b"], "left_semi").join(kept.select("a", "b"), ["a", "b"], "left_anti").select(scored.columns))


def undecided(pairs: DataFrame, decided: DataFrame | None) -> DataFrame:
    """Pairs (a, b) that nobody has decided on, whichever way round the decision (a, b) names them."""
    if decided is None:
        return pairs
    known = decided.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).distinct()
    return pairs.join(known, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")


def adjudicate(scored: DataFrame) -> DataFrame:
    """(a, b, lean, reason): what the stored evidence speaks for, first that holds."""
    lean = F.when(F.col("verdict") == "conflict", "split").when(F.size("vetoed_by") > 0, "split").when(F.col("verdict") == "distinct", "split").when(F.col("thin"), "unsure").when(F.coalesce(F.col("agreement"), F.lit(0.0)) < 1, "unsure").otherwise("merge")
    reason = F.when(F.col("verdict") == "conflict", "conflict").when(F.size("vetoed_by") > 0, F.concat(F.lit("veto: "), F.array_join("vetoed_by", ", "))).when(F.col("verdict") == "distinct", "distinct").when(F.col("thin"), "too little was compared").when(F.coalesce(F.col("agreement"), F.lit(0.0)) < 1, "not all attributes agree").otherwise("everything agrees")
    return scored.select("a", "b", lean.alias("lean"), reason.alias("reason"))

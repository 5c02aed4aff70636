"""Searching a catalogue: words, paging, probes, codes, question templates, and what guards them. Parameters, no literals."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes, kernels
from ..functions.normalise import content_tokens, latin, normal_text
from ..functions.wordlists import ABBREVIATIONS
from . import embedding, extraction, matching

#: Suggestions and their least likeness (fixed values).
LIKE, SUGGESTIONS, VOCABULARY_LEAST = 0.78, 3, 5


def query_words(text: str, most: int | None = None) -> list[str]:
    """Words of a search: Latin letters, capitals, abbreviations spelled out; all of them, or of the first ``most`` that were typed."""
    raw = re.sub(r"[^\w./-]+", " ", latin(text or "").upper()).split()[:most]
    return " ".join(ABBREVIATIONS.get(w, w) for w in raw).split()


def starts_word(text: Column, word: str) -> Column:
    return F.concat(F.lit(" "), F.upper(text)).contains(f" {word}")


def search(items: DataFrame, text: str = "", company: str | None = None, class_code: str | None = None, most: int | None = None) -> DataFrame:
    """Rows whose text begins words with all words asked for, or whose code or part number begins with the question; filters that
    are not given let everything through. phrase_miss and code_miss (0 or 1), then length, order the result.

    items: id, norm_text, legacy_code, mpn_norm, company, class_code. most: words of the question that count, all unless given.
    """
    words, bare = query_words(text, most), re.sub(r"[^A-Z0-9]", "", (text or "").upper())
    out = items
    if company is not None:
        out = out.where(F.col("company") == company)
    if class_code is not None:
        out = out.where(F.col("class_code") == class_code)
    if not words:
        return out.withColumn("phrase_miss", F.lit(0)).withColumn("code_miss", F.lit(0))
    t = F.coalesce("norm_text", F.lit(""))
    every = F.lit(True)
    for w in words:
        every = every & starts_word(t, w)
    code = F.lit(False)
    if bare:
        code = F.upper(F.coalesce("legacy_code", F.lit(""))).startswith(text.strip().upper()) | F.coalesce("mpn_norm", F.lit("")).startswith(bare)
    phrase = F.upper(t).contains(" ".join(words))
    return out.where(every | code).withColumn("phrase_miss", F.when(phrase, 0).otherwise(1)).withColumn("code_miss", F.when(code, 0).otherwise(1))


def page(found: DataFrame, number: int = 0, size: int = 25) -> tuple[DataFrame, int]:
    """(one page, rows in all): phrase hits, code hits, short texts, low ids first."""
    return found.orderBy("phrase_miss", "code_miss", F.length("norm_text"), "id").offset(number * size).limit(size), found.count()


def vocabulary(items: DataFrame, least: int = VOCABULARY_LEAST) -> DataFrame:
    """(word, rows): words of four letters or more that ``least`` rows hold."""
    words = F.array_distinct(F.filter(F.split(F.upper(F.coalesce("norm_text", F.lit(""))), r"\s+"), lambda w: w.rlike("^[A-Z]{4,}$")))
    return items.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("rows")).where(F.col("rows") >= least)


def suggest(words: DataFrame, asked: str, least: float = LIKE, most: int = SUGGESTIONS) -> DataFrame:
    """(word, likeness): the vocabulary's words most like the one asked for; only words within reach of its length are compared."""
    asked = asked.upper()
    slack = int(len(asked) * 2 * (1 - least) / least) + 1
    near = words.where(F.length("word").between(len(asked) - slack, len(asked) + slack) & (F.col("word") != asked))
    ratio = F.pandas_udf(lambda x: x.map(lambda w: kernels.indel_ratio(asked, w)), "double")
    return near.select("word", ratio("word").alias("likeness")).where(F.col("likeness") >= least).orderBy(F.desc("likeness"), "word").limit(most)


def facets(found: DataFrame, names: Sequence[str] = ("company", "class_code")) -> DataFrame:
    """(facet, value, rows), all facets in one pass."""
    pairs = F.array(*(F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in names))
    return found.select(F.explode(pairs).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("rows"))


def code_lookup(items: DataFrame, text: str, bins: DataFrame | None = None, equipment: DataFrame | None = None) -> DataFrame:
    """(id, method): rows that a scanned text names, by the first method that finds any: material code, company code, GTIN, part
    number, shelf label (bin, id), equipment tag (tag, id)."""
    t = (text or "").strip().upper()
    probe = F.lit(t)
    hits = [items.where(F.upper("code") == t), items.where(F.upper("legacy_code") == t), items.where(F.col("gtin") == codes.gtin(probe)), items.where(F.col("mpn_norm") == codes.part_number(probe))]
    frames = [h.select("id", F.lit(k).alias("k")) for k, h in enumerate(hits)]
    if bins is not None:
        frames.append(bins.where(F.upper("bin") == t).select("id", F.lit(4).alias("k")))
    if equipment is not None:
        frames.append(equipment.where(F.upper("tag") == t).select("id", F.lit(5).alias("k")))
    every = frames[0]
    for f in frames[1:]:
        every = every.unionByName(f)
    first = every.agg(F.min("k").alias("k"))
    names = F.array(*map(F.lit, ("code", "legacy_code", "gtin", "mpn", "bin", "equipment")))
    return every.join(F.broadcast(first), "k").select("id", F.get(names, F.col("k")).alias("method")).distinct()


def probe(items: DataFrame, description: str, vector: list[float] | None = None, most: int = 80) -> DataFrame:
    """(id, score, verdict, confidence, band, direction): what a new description would duplicate. Candidates are all rows that share
    an exact key and, of its class, the ``most`` highest by cosine + 0.3 Jaccard + 0.5 where the blocking value agrees; each is
    then judged as any pair is. items need id, class_code, norm_text, norm_hash, mpn_norm, gtin, attrs, and vector if one is given.
    """
    spark = items.sparkSession
    one = spark.createDataFrame([(-1, description)], "id long, description string")
    norm = one.select("id", normal_text("description").alias("norm_text"))
    read = extraction.extract_rows(norm).withColumn("mpn_norm", codes.part_number("mpn")).withColumn("norm_hash", F.sha2("norm_text", 256))
    if vector is not None:
        read = read.withColumn("vector", F.array(*map(F.lit, map(float, vector))))
    names = ["id", "class_code", "norm_text", "norm_hash", "mpn_norm", "gtin", "attrs"] + (["vector"] if vector is not None else [])
    q = read.select(*(F.col(n).alias(f"q_{n}") for n in names))
    rows = items.select(*names).crossJoin(F.broadcast(q))  # one row
    exact = matching.anchor({"mpn": (F.col("mpn_norm"), F.col("q_mpn_norm")), "gtin": (F.col("gtin"), F.col("q_gtin")), "text": (F.col("norm_hash"), F.col("q_norm_hash"))}).isNotNull()
    words, asked = content_tokens("norm_text"), content_tokens("q_norm_text")
    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect(words, asked)).cast("double"), F.size(F.array_union(words, asked))), F.lit(0.0))
    band = F.coalesce(extraction.block_value(F.col("class_code"), F.col("attrs")) == extraction.block_value(F.col("q_class_code"), F.col("q_attrs")), F.lit(False))
    score = (matching.cosine(F.col("vector"), F.col("q_vector")) if vector is not None else F.lit(0.0)) + 0.3 * jaccard + F.when(band, 0.5).otherwise(0.0)
    rows = rows.withColumn("score", score)
    pool = rows.where(exact).unionByName(rows.where(F.col("class_code") == F.col("q_class_code")).orderBy(F.desc("score"), "id").limit(most)).dropDuplicates(["id"])
    pairs = pool.select(F.lit(-1).cast("long").alias("a"), F.col("id").cast("long").alias("b"))
    both = pool.select(*names).withColumn("id", F.col("id").cast("long")).unionByName(read.select(*names))
    judged = matching.score_pairs(pairs, both)
    return judged.join(pool.select(F.col("id").cast("long").alias("b"), F.col("score").alias("rank_score")), "b").select(F.col("b").alias("id"), F.col("rank_score").alias("score"), "verdict", "confidence", "band", "direction")


def retrieve(golden: DataFrame, question: str, most: int = 5, least: float = 0.55) -> DataFrame:
    """(cluster, std_description, likeness): golden records most like a question by the token-set ratio, all of them compared."""
    like = kernels.similarity(F.lit(" ".join(query_words(question))), F.upper(F.regexp_replace("std_description", ",", " ")))
    return golden.select("cluster", "std_description", like.alias("likeness")).where(F.col("likeness") >= least).orderBy(F.desc("likeness"), "cluster").limit(most)


def passages(corpus: DataFrame, question: str, most: int = 4, least: float = 0.02) -> DataFrame:
    """(id, piece, text, score): pieces of a corpus (id, text in Markdown) nearest to a question, each with the piece that follows it
    in its document (score null)."""
    cut = embedding.chunks(corpus).withColumn("key", F.concat_ws("#", F.col("id").cast("string"), F.col("piece").cast("string")))
    asked = corpus.sparkSession.createDataFrame([("q", question)], "query string, text string")
    top = embedding.top_documents(cut.select(F.col("key").alias("id"), "text"), asked, most, least).select(F.col("id").alias("key"), "score")
    hits = cut.join(top, "key")
    after = cut.join(hits.select("id", (F.col("piece") + 1).alias("piece")), ["id", "piece"]).join(top, "key", "left_anti")
    return hits.select("id", "piece", "text", "score").unionByName(after.select("id", "piece", "text", F.lit(None).cast("double").alias("score")))


#: What a question may not ask for: orders to the machine, other rights, secrets.
REFUSED = (r"ignore (all |any |the )?(previous|above|prior)", r"(system|hidden) prompt", r"\b(drop|delete|update|insert|alter)\s+(table|from|into)\b", r"(password|api key|secret|credential|token)s?\b", r"(act|pretend) as\b", r"(bypass|override|disable) (the )?(guard|check|rule|filter|scope)")


def guard(question: str) -> str | None:
    """The pattern that a question breaks, None if it may be answered."""
    return next((p for p in REFUSED if re.search(p, question or "", re.IGNORECASE)), None)


def answer(question: str, templates: Sequence[tuple[str, Callable[..., DataFrame]]], **inputs) -> tuple[str, DataFrame | None]:
    """(outcome, frame): refused, the first template whose pattern the question meets, or none. A template gets the pattern's named
    groups beside the inputs; questions never become statements."""
    if guard(question):
        return "refused", None
    for pattern, run in templates:
        if m := re.search(pattern, question, re.IGNORECASE):
            return pattern, run(**inputs, **{k: v for k, v in m.groupdict().items() if v is not None})
    return "none", None


def why(scored: DataFrame, items: DataFrame, a: int, b: int) -> DataFrame:
    """One row that explains a pair: verdict, lean, reason, and every attribute's comparison."""
    x, y = min(a, b), max(a, b)
    one = scored.where((F.col("a") == x) & (F.col("b") == y))
    return matching.adjudicate(one).join(one.select("a", "b", "verdict", "confidence", "fuzzy", "semantic"), ["a", "b"]).join(matching.compare_pairs(one.select("a", "b"), items).select("a", "b", "compared"), ["a", "b"])

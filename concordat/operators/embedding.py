"""Texts as vectors of weighted character n-grams, reduced by a singular value decomposition; neighbours within a class; words.

Terms live in frames (id, term, weight). The vocabulary is chosen, weighted and numbered by Spark; only the projection, whose
size the parameters bound, is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import let
from ..storage import shared_folder, tasks, written
from . import neighbours
from .neighbours import nearest_in_class  # noqa: F401

#: Character n-grams, least documents of a term, most terms, most dimensions.
GRAMS, LEAST, TERMS, DIMS = (3, 5), 2, 200_000, 192
#: Words whose idf every task knows when it bounds the lengths of documents; documents of a part.
FREQUENT, PART_DOCS = 200_000, 4096


def char_grams(text: Column, least: int = GRAMS[0], most: int = GRAMS[1]) -> Column:
    """n-grams within words, each word between spaces; a word shorter than n gives itself once."""
    padded = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of(n: int) -> Column:
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
        shortest = n == least
        return F.flatten(F.transform(padded if shortest else F.filter(padded, lambda w: F.length(w) >= n), cut))

    return F.concat(*(of(n) for n in range(least, most + 1)))


def word_grams(text: Column) -> Column:
    """Words of two characters or more, and pairs of neighbours."""
    def with_pairs(words: Column) -> Column:
        return F.concat(words, F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w)))

    return let(F.regexp_extract_all(F.lower(text), F.lit(r"\b\w\w+\b"), F.lit(0)), with_pairs)  # the words are found once


def weights(docs: DataFrame, terms: Column, least: int = 1, most: int | None = None, sublinear: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows (id, term, weight) of unit length, vocabulary (term, idf)). idf = ln((1 + n) / (1 + df)) + 1. With ``most``, the
    terms of highest document frequency (of equals, the first) make the vocabulary."""
    n = docs.count()
    counts = docs.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    if most is not None:
        df = df.orderBy(F.desc("df"), "term").limit(most)
    vocabulary = df.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    return weighted(counts, vocabulary, sublinear), vocabulary


def weighted(counts: DataFrame, vocabulary: DataFrame, sublinear: bool) -> DataFrame:
    tf = (1 + F.log(F.col("tf").cast("double"))) if sublinear else F.col("tf").cast("double")
    rows = counts.join(vocabulary, "term").withColumn("w", tf * F.col("idf"))
    norm = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return rows.join(norm, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight"))


def top_documents(corpus: DataFrame, queries: DataFrame, k: int = 4, least: float = 0.02) -> DataFrame:
    """(query, rank, id, score): passages (id, text) nearest to each query (query, text) by the cosine of their word weights;
    only passages that share a word meet a query. Exact up to 12 decimals, to which scores are rounded; ties to the smaller id.

    A document's words never leave its part: texts are dealt to parts once, and what is shuffled besides is each part's vocabulary and few
    rows a query and part. A document's length is bounded by the idf of the FREQUENT most frequent words, as all others lie between that
    of the last of them and that of a single document; who can't reach the k-th best of a part, and then of all, by its bounds is left,
    and the lengths of the others are computed from the whole vocabulary.
    """
    spark = corpus.sparkSession
    folder = shared_folder(spark, "words")
    n = corpus.count()
    parts = max(tasks(spark), -(-n // PART_DOCS))
    terms, idf = word_grams(F.col("text")), lambda df: F.log(F.lit(1.0 + n) / (1 + df)) + 1
    docs = corpus.select("id", "text")
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).repartition(parts, "part")
    asked = queries.select("query", F.explode(word_grams(F.col("text"))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("tf"))
    asked = written(asked, f"{folder}/asked")
    # what is missing in the vocabulary is a word of one document, or of none if it was asked for
    df = docs.select(F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = df.join(asked.select("term", F.lit(True).alias("asked")).distinct(), "term", "left").where("df > 1 or asked")
    df = written(df.select("term", "df"), f"{folder}/vocabulary")
    frequent = written(df.orderBy(F.desc("df"), "term").limit(FREQUENT), f"{folder}/frequent")
    held = frequent.agg(F.count("*").alias("n"), F.min("df").alias("df")).first()
    most = F.lit(held["df"] if held["n"] == FREQUENT else 1)
    q = df.join(asked, "term").withColumn("w", F.col("tf") * idf(F.col("df")))
    length = q.groupBy("query").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    q = written(q.join(length, "query").select("query", "term", (F.col("w") / F.col("length") * idf(F.col("df"))).alias("x")), f"{folder}/weights")

    counted = dealt.select("part", "id", F.explode(terms).alias("term")).groupBy("part", "id", "term").agg(F.count("*").alias("tf"))
    square = lambda other: F.pow(F.col("tf") * idf(F.coalesce("df", other)), 2)
    own = Window.partitionBy("part", "id")
    sized = counted.join(F.broadcast(frequent), "term", "left").select("part", "id", "term", "tf", F.sqrt(F.sum(square(most)).over(own)).alias("low"), F.sqrt(F.sum(square(F.lit(1))).over(own)).alias("high"))
    met = sized.join(q, "term").groupBy("part", "query", "id", "low", "high").agg(F.sum(F.col("tf") * F.col("x")).alias("dot"))
    bound = met.select("part", "query", "id", "dot", (F.col("dot") / F.col("high")).alias("sure"), (F.col("dot") / F.col("low") * (1 + 1e-9)).alias("can"))

    def reaching(rows: DataFrame, *group: str) -> DataFrame:
        """Rows that can reach the k-th sure score of their group."""
        place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("sure")))
        floor = F.max(F.when(F.col("place") == k, F.col("sure"))).over(Window.partitionBy(*group))
        return rows.withColumn("place", place).withColumn("floor", floor).where((F.col("can") >= least) & (F.col("floor").isNull() | (F.col("can") >= F.col("floor")))).drop("place", "floor")

    near = written(reaching(bound, "part", "query"), f"{folder}/near")
    near = written(reaching(near, "query").select("query", "id", "dot"), f"{folder}/nearest")
    few = docs.join(near.select("id").distinct(), "id", "left_semi").select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    few = written(few, f"{folder}/few")
    exact = few.join(df.join(few.select("term").distinct(), "term", "left_semi"), "term", "left").groupBy("id").agg(F.sqrt(F.sum(square(F.lit(1)))).alias("norm"))
    total = near.join(exact, "id").select("query", "id", F.round(F.col("dot") / F.col("norm"), 12).alias("score")).where(F.col("score") > least)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return total.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


@dataclass(frozen=True)
class Embedding:
    """What new texts need: terms in the order of the projection's rows, their idf, the projection (terms, dims)."""

    vocabulary: DataFrame  # term, idf, row
    projection: np.ndarray

    def transform(self, docs: DataFrame) -> DataFrame:
        """(id, vector) of unit length; a text without a known term has no row."""
        counts = docs.select("id", F.explode(char_grams(F.coalesce("text", F.lit("")))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
        rows = weighted(counts, self.vocabulary.select("term", "idf"), True).join(self.vocabulary.select("term", "row"), "term")
        return project(rows, self.projection)


def project(rows: DataFrame, projection: np.ndarray) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(projection.astype(np.float32))  # TERMS * DIMS * 4 bytes at most
    listed = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("row", "weight"))).alias("t"))
    listed = listed.select("id", F.col("t.row").alias("row"), F.col("t.weight").alias("weight"))

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        p = held.value
        for r, w in batches:
            out = []
            for i, x in zip(r, w, strict=True):
                v = np.asarray(x, np.float64) @ p[np.asarray(i, np.int64)]
                size = np.linalg.norm(v)
                out.append((v / size if size else v).tolist())
            yield pd.Series(out)

    return listed.select("id", F.pandas_udf(run, "array<double>")("row", "weight").alias("vector"))


def fit(docs: DataFrame, dims: int = DIMS, terms: int = TERMS, least: int = LEAST) -> Embedding | None:
    """Learn from (id, text) of all rows; None if no term is in ``least`` of them. The decomposition is distributed."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    spark = docs.sparkSession
    rows, vocabulary = weights(docs.select("id", "text"), char_grams(F.coalesce("text", F.lit(""))), least, terms, True)
    folder = shared_folder(spark, "embedding")
    numbered = written(vocabulary.withColumn("row", F.row_number().over(Window.orderBy("term")) - 1), f"{folder}/vocabulary")  # at most ``terms`` rows
    size = numbered.count()
    if not size:
        return None
    sparse = written(rows.join(numbered.select("term", "row"), "term").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("row", "weight"))).alias("t")), f"{folder}/rows")
    matrix = RowMatrix(sparse.select("t").rdd.map(lambda r: Vectors.sparse(size, [(x["row"], x["weight"]) for x in r["t"]])), numCols=size)
    k = max(1, min(dims, size - 1, sparse.count() - 1))
    found = matrix.computeSVD(k, computeU=False)
    return Embedding(numbered, found.V.toArray())


def chunks(docs: DataFrame, words: int = 160, least: int = 40) -> DataFrame:
    """(id, heading, piece, text): documents cut at Markdown headings and after ``words`` words; pieces of ``least`` characters or
    fewer are left out."""
    marked = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^(#{1,6}[ \t])", "\u0001$1")
    parts = docs.select("id", F.posexplode(F.split(marked, "\u0001")).alias("part", "body"))
    heading = F.nullif(F.trim(F.regexp_extract("body", r"^#{1,6}[ \t]+(.*)", 1)), F.lit(""))
    body = F.filter(F.split(F.regexp_replace("body", r"^#{1,6}[ \t]+.*", ""), r"\s+"), lambda w: w != "")
    cut = parts.select("id", "part", heading.alias("heading"), body.alias("w")).where(F.size("w") > 0)
    starts = cut.select("id", "part", "heading", "w", F.explode(F.sequence(F.lit(1), F.size("w"), F.lit(words))).alias("start"))
    text = F.array_join(F.slice("w", F.col("start"), words), " ")
    out = starts.select("id", "heading", text.alias("text"), "part", "start").where(F.length("text") > least)
    return out.withColumn("piece", F.row_number().over(Window.partitionBy("id").orderBy("part", "start"))).select("id", "heading", "piece", "text")

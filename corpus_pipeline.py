"""The corpus pipeline: language ID, quality, near duplicates, packing, one after another over all documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder and
hands it to the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concordat.llm import language_id, ngram_join, packing, quality
from concordat.llm.common import drop, shared_folder, written
from concordat.llm.queries import table, tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus itself teaches. Null texts, texts without letters and texts that resemble no learned
    language go; if nothing could be learned, every text with a letter stays. Repeated rows stay, an empty table gives an empty one."""
    return language_id.keep_identified(docs)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good. Null texts are judged as empty ones; without labels of both kinds all stay.
    Repeated rows are judged alike, an empty table gives an empty one."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id. Of equal rows one stays; rows without an id, and texts
    without words, belong to no group and stay; an empty table gives an empty one."""
    return ngram_join.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences of 4096 tokens. Null and empty texts hold the end id alone; an empty
    table packs to nothing."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, length=4096)


STAGES = [("language_id", identify_language), ("quality", classify_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack_sequences)]

#: Learned models decide what stays, which SQL can't express; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            folder = shared_folder(spark, name)
            docs = written(docs, folder)
            if before:  # no later stage reads it
                drop(before)
            before = folder
    return docs

"""A training corpus from ``documents``: toxic rows go, repeated line chunks go, of near copies one stays, sources are mixed, texts become ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planar_spark.llm import line_dedup, mixing, ngram_join, toxicity, unigram
from planar_spark.llm.common import table
from planar_spark.llm.queries import TOKENIZER
from planar_spark.store import discard, scratch_tables, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches their language's calibrated threshold go."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines are cut from texts; no document goes. ``n_chars`` follows the text."""
    cut = line_dedup.dedup_lines(docs, whole=True)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by Jaccard similarity of at least 0.8 on five-word shingles, that with the least id stays."""
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents in curriculum order, by the sources' target weights."""
    return mixing.mixed_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, round_trip, ids) of each document."""
    return unigram.tokenize(docs, unigram.load(TOKENIZER))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("ngram_join", one_of_near_copies),
    ("mixing", mixed),
    ("sentencepiece", tokenized),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage read or wrote on its way goes when its rows are written."""
    docs = table(spark, sf_dir, "documents")
    read: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        with scratch_tables() as made:
            docs = written(stage(spark, docs, sf_dir), name)
        discard(*read, *[t for t in made if t is not docs])
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

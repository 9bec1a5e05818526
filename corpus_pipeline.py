"""Corpus pipeline: toxicity, language ID, near duplicates, benchmark decontamination, packing. Part of tidemark.llm.

Each stage reads all that its predecessor kept and, but for the last, returns the columns of documents. The first two judge each row
by its text. The next two reject ids: rows that share one stay or go together, and rows with a null id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, jaccard_join, language_id, packing, toxicity

LEAST_SCORE = 0.5


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows whose id is in rejected; null ids stay."""
    name = "gone"
    while name in map(str.lower, docs.columns):
        name += "_"
    return docs.join(rejected.select(F.col("doc_id").alias(name)).distinct(), F.col("doc_id") == F.col(name), "left_anti")


def _begun(docs: DataFrame) -> DataFrame:
    """docs, once the driver has given back what it kept of the stage before: plans, broadcasts, shuffles and collected rows."""
    common.cleaned(docs.sparkSession)
    common.freed()
    return docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the network predicts toxic; it learns from the labelled ones among docs."""
    return toxicity.keep_clean(docs, toxicity.train(_begun(docs), common.read(spark, sf_dir, "labels")))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language (no letters) and those whose evidence is divided."""
    return language_id.keep_known(docs, language_id.train(_begun(docs)), LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle sets linked at a Jaccard similarity of 0.8 or more stays: the smallest id."""
    from fractions import Fraction

    classes = jaccard_join.join(_begun(docs), k=5, threshold=Fraction(4, 5), links=False)
    return _without(docs, classes.filter("doc_id != component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents with a window that matches a benchmark item."""
    return _without(docs, decontamination.find(_begun(docs), common.read(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, as the packing operator gives them."""
    return packing.pack(_begun(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained models and tokenizers have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

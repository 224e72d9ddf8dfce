"""A training-data pipeline from documents to packed sequences: STAGES, run and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from optrace.llm import jaccard, line_dedup, packing, quality, toxicity
from optrace.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a shingle and least likeness of near copies; op10's own 4 and 85 bind that query only.
WIDTH, PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality, by a model of the labelled ones among docs."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.quality_verdicts(docs, model).filter("kept").select(docs.columns)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a machine trained on the labelled ones among docs."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxicity_scores(docs, machine).filter("predicted = 0").select(docs.columns)


def line_frequency(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their sources' boilerplate lines; n_chars follows the text."""
    found = line_dedup.drop_boilerplate(docs)
    return found.selectExpr(*[
        f"CASE WHEN n_dropped > 0 THEN char_length(text) ELSE n_chars END AS {c}" if c == "n_chars" else f"`{c}`" for c in docs.columns
    ])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: sets of WIDTH-word shingles, PERCENT alike."""
    return jaccard.one_of_each(docs, width=WIDTH, percent=PERCENT)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("line dedup", line_frequency),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", packed_sequences),
]

#: SQL cannot express the models, the string kernel and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

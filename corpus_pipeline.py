"""A corpus pipeline: language, repeated lines, near duplicates, leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. All but the last return
the columns of documents.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import decontaminate, language, line_dedup, near_dedup, packing
from cohortloom.llm.queries import language_model, read
from cohortloom.plans.registry import Registry
from cohortloom.session import materialise

registry = Registry()


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts; the model learns from the labelled ones.

    Without any labelled text there is nothing to learn from: all documents pass, with a warning.
    """
    model = language_model(docs)
    if not model.labels:
        warnings.warn("no labelled text: documents pass without a language check", stacklevel=2)
        return docs
    found = language.identify(docs, model, names=("__lang", "__score", "__accepted"))
    return found.filter("__accepted").select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that no earlier one has; one that loses all its lines goes."""
    found = line_dedup.dedup_lines(docs, removed="__removed")
    emptied = (F.size("__removed") > 0) & ~F.col("text").rlike(r"\S")
    found = found.filter(~F.coalesce(emptied, F.lit(False)))
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return found.withColumn("n_chars", n_chars).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by 0.8 similarity of five-word shingles."""
    found = near_dedup.near_duplicates(docs)
    gone = found.filter("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    found = decontaminate.leaks(docs, read(spark, sf_dir, "benchmark"), name="__leaks")
    return found.filter(F.size("__leaks") == 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    import public_tokenizers  # only this stage needs it

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("decontaminate", without_leaks),
    ("best_fit_packing", packed),
]

# No SQL: models, sketches, alignments and token ids are outside it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


@registry.query(ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)

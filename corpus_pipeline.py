"""The corpus pipeline: five stages over documents, each one of the corpus operators.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a frame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import classifier, jaccard, packing, pii, substring_dedup
from millrace.llm.arrowio import materialised

#: No SQL says what trained models and the tokenizers decide; the tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a score of 0.3 exactly stays.

    Null and empty texts have the bias's score. Repeated rows are judged alike, columns of any name stay.
    """
    weights = classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.accepted(docs, weights, 0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the least id.

    Documents without words (null or empty texts too) all stay; of equal rows one does.
    """
    return jaccard.representatives(docs)


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 35-word windows that also start elsewhere go from the texts; n_chars follows.

    Null texts stay null; a row that comes twice repeats all of its windows.
    """
    return substring_dedup.remove(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows. Null texts stay null, rows keep their number."""
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast("bigint"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into sequences of at most 2048 tokens; a null text is its end token alone.

    An empty table gives no sequences.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_text),
    ("PII", personal_data),
    ("best-fit packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

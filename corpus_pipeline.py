"""A training corpus from raw documents, in stages. Each stage takes (spark, docs, sf_dir), works on all rows its
predecessor kept and returns a DataFrame; run() applies them in turn, each written as Parquet and read again.

Defined results: columns besides doc_id and text, whatever their names, are passed through up to the last stage, and
n_chars, where there is one, follows the text. A null or empty text is never toxic, near any other or repeated,
stays null or empty, and is packed as the closing id alone. A row without id is judged by its text and is no near-duplicate;
of rows that repeat id and text one stays, and other rows of one id are judged each by its own text. Texts of any
length are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import jaccard_join, packing, pii, suffix_dedup, toxicity
from gridloom.llm.common import discard, load, materialise


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows a text that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.keep_clean(docs, load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays."""
    return jaccard_join.keep_one(docs)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur at more than one place are taken out of the texts."""
    return _measured(suffix_dedup.strip(docs))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return _measured(pii.redact(docs))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents are packed into windows; one row for each piece."""
    return packing.pack(docs, packing.public_tokenization())


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard join", drop_near_duplicates),
    ("suffix-array dedup", strip_repeats),
    ("pii", redact_pii),
    ("packing", pack_windows),
]

#: A trained classifier, hashed candidates and tokenizers decide here; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = load(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*before)
        before = [docs]
    return docs

"""A corpus pipeline: language ID, near-duplicates, benchmark passages, personal data, token ids.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, decontamination, language_id, pii, simhash
from tesserae.llm.catalogue import held_out
from tesserae.session import scratch

#: Text that no learned language explains falls apart into phrases of about one letter; documents below this mean length are rejected.
LEAST_PHRASE = 1.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of none of the learned languages, go; a null lang is filled by the prediction.

    Null and empty texts have no letters. Ties go to the language of smaller name. Nothing depends on doc_id but which documents are
    learned from, where a null id counts as any other. Repeated rows are judged alike; without labelled texts, or rows, all go.
    """
    model = language_id.fit(docs.filter(~held_out()))
    found = language_id.identify(docs, model)
    kept = found.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("phrase_chars") >= LEAST_PHRASE))
    return kept.select(*[F.coalesce("row.lang", "lang_pred").alias("lang") if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-equal fingerprints one stays: that of smallest doc_id, of equal ids that of the smaller text hash, a null id last.

    Of repeated rows one stays. Texts without words are near duplicates of each other. An empty table stays empty.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 10 consecutive words of a benchmark item, or all words of a shorter one, go.

    Null and empty texts, and items, have no words and match nothing. Rows are judged one by one, repeated ones alike, whatever their
    doc_id. An empty benchmark lets all stay.
    """
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the new text. All rows stay, a null text as it is, repeated rows alike."""
    return pii.redacted_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; a null or empty text has no tokens, and extra columns go."""
    return bpe.digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("pii", redact),
    ("bpe", encode),
]

#: SQL cannot express the suffix automata and the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

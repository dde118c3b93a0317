"""A training corpus in five stages over the table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import language_id, minhash_dedup, piece_encoding, secret_scan, source_mixing, storage
from corvane.llm.queries import tokenizer_file

#: A document goes if it has no letter, or if its n-grams lie this far from every profile.
LEAST_LANGUAGE_SCORE = 0.05
#: Characters of a pack of the last stage, a third of the operator's own: executors still hold what four stages have touched, and disk is not short.
PACK = piece_encoding.PACK // 3


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the learnt languages; profiles are learnt from the stage's own input.

    Rows go if their text is null, empty or without a letter, or lies too far from every profile. Each is judged by
    itself: repeated rows share their fate, and a null or repeated id, or a column of any other name, is no matter.
    An empty table stays empty.
    """
    profiles = language_id.learn_profiles(docs)
    return language_id.known_languages(docs, profiles, least_score=LEAST_LANGUAGE_SCORE)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five-word shingles, similarity of 0.8 or more).

    Rows without words are in no group and stay. Of equal rows one stays, whatever their ids. An empty table stays empty.
    """
    return minhash_dedup.one_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind, and n_chars follows; no row goes.

    Null texts stay null and keep their n_chars, texts without a secret stay as they are; ids are not read, and
    equal texts are scanned once. An empty table stays empty.
    """
    hidden = secret_scan.redacted(docs)
    return hidden.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's budget reads them (all tokens once, at most four readings of a row).

    Rows without words stay once. A null source is a source; equal rows are read as often as they are given, and
    null or repeated ids neither multiply nor lose rows. An empty table stays empty.
    """
    return source_mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of every row; a null or empty text has no ids, null ids pass through, repeated rows repeat."""
    return piece_encoding.encode(docs, tokenizer_file("piece_bpe_32k.model"), pack=PACK).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("language_id", keep_known_languages),
    ("minhash_dedup", keep_one_of_each),
    ("secret_scans", hide_secrets),
    ("source_mixing", mix),
    ("sentencepiece", encode),
]

#: Profiles, minima and piece paths are no SQL; tests compare run() with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

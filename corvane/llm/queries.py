"""The queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import byte_pairs, curve_ann, language_id, license_scan, minhash_dedup, piece_encoding, quality_rules, secret_scan, site_quality, source_mixing, spelling, storage, token_binary, whitening

#: Folder of the public tokenizers' files; CORVANE_TOKENIZERS overrides the installed package.
TOKENIZERS = os.environ.get("CORVANE_TOKENIZERS", "")

# The phrases and labels of op1's contract.
LICENSE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf, "documents"), phrases=LICENSE_PHRASES).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_share")


def op3_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    read = source_mixing.mix_sources(_table(spark, sf, "documents"))
    return read.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", F.col("place.block_key").alias("block_key"), F.col("place.doc_key").alias("doc_key"))


def op4_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    profiles = language_id.learn_profiles(docs.where(fold != 2))
    found = language_id.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score")


def op5_token_binary(spark: SparkSession, sf: str) -> DataFrame:
    path = storage.new_path(spark, "tokens")
    token_binary.write_tokens(_table(spark, sf, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return token_binary.read_index(spark, path)


def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return site_quality.site_quality(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op7_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    ids = piece_encoding.encode(_table(spark, sf, "documents"), model)
    digest = ids.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "text_crc32", "ids")
    texts = piece_encoding.decode(digest, model)
    return texts.select("doc_id", "n_pieces", "ids_hash", (F.crc32("text") == F.col("text_crc32")).alias("round_trip"))


def op8_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.secret_scan(_table(spark, sf, "documents"))
    spell = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r[0] for r in secret_scan.BASE]))
    return found.select("doc_id", *[count(r[0]).alias(f"n_{r[0]}") for r in secret_scan.BASE], F.sha2(spell(base), 256).alias("base_sha256"), spell(F.col("spans")).alias("spans"))


def op9_nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings")
    return curve_ann.nearest(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"))


def op10_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf, "documents"), width=3, percent=85)


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(spelling.vocabulary(_table(spark, sf, "documents")))


def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_byte_pairs(spark: SparkSession, sf: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.json")
    texts = byte_pairs.decode(byte_pairs.encode(_table(spark, sf, "documents"), path), path)
    spelt = F.array_join(F.col("ids").cast("array<string>"), ",")
    return texts.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelt, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scans, op2_quality_rules, op3_source_mixing, op4_language_id, op5_token_binary, op6_quality_classifier, op7_sentencepiece, op8_secret_scans, op9_nearest_vectors, op10_minhash_dedup, op11_spelling_variants, op12_embedding_whitening, op13_byte_pairs)}

"""The contract queries: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import audio, bpe, license_scan, ngram_join, packing, pii, quality, secret_scan, spelling, substring_dedup, token_store, toxicity, vector_codes
from tessera.llm._common import written


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _joined(spans: str, only: tuple[str, ...] = ()) -> Column:
    """kind:start:end of a span array, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*only)) if only else F.col(spans)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(_docs(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicate_classes(_docs(spark, sf_dir), k=3, threshold="9/10")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(_docs(spark, sf_dir))
    return found.select("doc_id", *[_count("spans", k) for k in pii.KINDS], F.size("spans").cast("long").alias("n_spans"), F.sha2(_joined("spans", pii.BASE), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_docs(spark, sf_dir).select("doc_id", "text"))
    words = F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(quality.WORD), F.lit(0)), " ")
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(_docs(spark, sf_dir)).withColumn("spans", secret_scan.spans_in_order())
    counts = [_count("base", k) for k in secret_scan.BASE]
    return found.select("doc_id", *counts, F.size("spans").cast("long").alias("n_spans"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_of(_docs(spark, sf_dir))


def op10_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.media_features(audio.stored_media(_docs(spark, sf_dir)))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_docs(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    store = token_store.write_tokens(docs, vocabulary("word_bpe_49k.json"), end_id=1)
    read = token_store.read_tokens(store, docs.select("doc_id").distinct())
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = vector_codes.fit(vectors, parts=16, entries=64, rounds=2)
    coded = vector_codes.label_errors(written(vector_codes.encode(vectors, books), "codes"))
    return coded.select(F.col("id").alias("vec_id"), vector_codes.hex_code().alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        *(op1_best_fit_packing, op2_bpe, op3_ngram_jaccard, op4_quality_rules, op5_pii, op6_toxicity, op7_substring_dedup),
        *(op8_secret_scan, op9_license_scan, op10_audio, op11_spelling_variants, op12_token_store, op13_vector_codes),
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from tessera.llm import oracles

    return dict(oracles.ORACLES)

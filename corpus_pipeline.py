"""The corpus pipeline: quality rules, n-gram Jaccard join, substring dedup, secret scans, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. run() applies them to documents, each stage's result written as Parquet in the shared folder and reread.

Defined cases, of every stage: a table without rows gives none; a null doc_id is a document of its own; rows of one doc_id
and different texts are different documents; columns beyond doc_id and text are carried along whatever their names
(n_chars, where there is one, is counted again when a stage changes the text); very long texts are taken whole. What a
stage does with null and empty texts and with repeated rows stands at the stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import ngram_join, packing, quality, secret_scan, substring_dedup
from tessera.llm._common import discard, mark, only, small_batches, written
from tessera.llm.queries import vocabulary
from tessera.sources.workers import share_path


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage: gives the workers the library's path and bounds their batches first. Its result may read small scratch tables of its own, which stay as
    long as whoever calls it needs that; stages share nothing."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        share_path(spark)
        small_batches(spark)
        return work(spark, docs, sf_dir)

    return run


@_stage
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Null and empty texts fail the base rules (no words); repeated rows go or stay together."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8), that of the smallest doc_id. Null texts and
    texts without a word are near nothing and stay; repeated rows of one doc_id and text stay once."""
    return ngram_join.keep_one_of_each(docs)


@_stage
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of long repeats go; a text that loses all its words goes as well. Null and empty texts stay as they are; rows of
    equal doc_id don't remove each other's words, so repeated rows are each kept; a null doc_id loses nothing."""
    kept = substring_dedup.remove_repeats(docs).where("n_words = 0 or n_removed < n_words")
    names = docs.columns
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in names else None
    return kept.select(*[n_chars if c == "n_chars" else F.col(c) for c in names])


@_stage
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text. Null and empty texts stay as they are; equal texts, repeated rows too, are masked alike."""
    kept = secret_scan.redact(docs)
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if "n_chars" in docs.columns else None
    return kept.select(*[n_chars if c == "n_chars" else F.col(c) for c in docs.columns])


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 2048 tokens: one row per piece. A null or empty text is one piece with the end id;
    repeated rows are packed once each."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality rules", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("substring dedup", without_repeats),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: No stage but the first can be told in SQL within reason; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Once a stage's result is written, what it read and its own scratch tables are removed; those that the last
    stage's result reads stay until `release`."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        since = mark()
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        only(since, docs)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

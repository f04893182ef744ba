"""The operators and the pipeline as queries over the test tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import backoff, byte_bpe, exact_dedup, kneser_ney, licenses, max_sketch, merkle, mixing, partenum, piece_counts, toxicity, wavelet, whitening
from tickloom.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def op1_wavelet_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(documents(spark, sf_dir))


def op3_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_components(documents(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


SQL["op4_license_scan"] = licenses.scan_sql()


def op5_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.resolve(documents(spark, sf_dir)).drop("n_chars")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encoded(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op10_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(documents(spark, sf_dir), cutoff=1)


def op11_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op12_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_sketch.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL["op12_max_sketch_search"] = max_sketch.RANKED_SQL


def op13_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL["op8_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER w = 1 AS kept
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g"""

for _fn in (op1_wavelet_token_ids, op2_merkle_fingerprints, op3_partenum_jaccard, op4_license_scan, op5_sainte_lague_mix, op6_kneser_ney_quality, op7_toxicity_chain, op8_exact_dedup, op9_byte_bpe, op10_stupid_backoff, op11_piece_counts, op12_max_sketch_search, op13_jacobi_davidson_whitening):
    QUERIES[_fn.__name__] = _fn

"""The queries of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import fingerprints as _prints
from codeloom.llm import language_id as _language
from codeloom.llm import line_dedup as _lines
from codeloom.llm import near_dedup as _near
from codeloom.llm import packing as _packing
from codeloom.llm import pieces as _pieces
from codeloom.llm import quality as _quality
from codeloom.llm import secrets as _secrets
from codeloom.llm import suffix_dedup as _suffix
from codeloom.llm import topk as _topk
from codeloom.llm.common import table

#: A merge model with byte fallback, at the same place on every machine.
MODEL = os.environ.get("CODELOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return _topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _quality.classify(docs, _quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str = MODEL) -> DataFrame:
    return _pieces.encode(table(spark, sf_dir, "documents"), model_file)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _language.identify(docs, _language.fit(docs))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prints.i_match(table(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _secrets.scan(docs, _secrets.fit(docs))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_best_fit_packing, op3_exact_top_k, op4_line_dedup, op5_quality_classifier, op6_sentencepiece, op7_language_id, op8_fingerprints, op9_secret_scans, op10_minhash_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": _suffix.oracle(), "op3_exact_top_k": _topk.oracle(), "op4_line_dedup": _lines.oracle(), "op8_fingerprints": _prints.oracle()}

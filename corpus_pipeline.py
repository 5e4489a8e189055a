"""A corpus made ready for training: quality classifier, line dedup, near-dedup, secret scans and packing, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next stage. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import line_dedup, near_dedup, packing, quality, secrets
from codeloom.llm.common import columns, fresh, save, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of over 50 documents go everywhere; copies count as one document, so what is only copied stays for the next stage."""
    counts = [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")]  # of docs itself; the operator has columns called so
    kept = dict(zip(counts, fresh(docs, *(f"__{c.lower()}" for c in counts))))
    out = line_dedup.line_dedup(docs.withColumnsRenamed(kept), copies_count=False).drop("n_lines", "n_dropped").withColumnsRenamed({v: k for k, v in kept.items()})
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*columns(docs))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_dedup.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked."""
    return secrets.mask_secrets(docs, secrets.fit(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 words: (bin_id, slot, doc_id, start, length)."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", drop_common_lines),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Trees, alignment and Viterbi are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs

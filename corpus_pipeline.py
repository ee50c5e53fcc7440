"""A corpus pipeline: rejected, near-copied and contaminated documents go, personal data is masked, texts are encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its output is written as Parquet and
read again.  All but the last return the columns of ``documents``, and any further ones that they were given; rows and values
may be null, texts empty or of any length, and an empty table passes.  Repeated rows are judged alike; near-dedup keeps one of
them, and of documents that tie for the smallest id any one.  The last returns doc_id, n_tokens and the digests of ids, decoded
text and spans of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tunelake.llm import common, decontam, neardup, pieces, pii, quality, registry


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labelled ones among docs."""
    return quality.good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a five-word shingle similarity of 0.8 the document with the smallest id stays.

    Fingerprints propose links by op5's method, bands those that fingerprints don't show; the similarity is exact.
    """
    return neardup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, the others stay whole."""
    return decontam.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by its kind in brackets; n_chars follows the text."""
    return pii.redacted(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's text is encoded and decoded, and every piece's span in it is digested."""
    return pieces.encode_digest(docs, registry.model_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]

#: The classifier, XXH64 and the tokenizer have no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.written(docs)
    return docs

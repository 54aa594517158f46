"""The corpus pipeline: five stages from documents to encoded documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs.
All but the last return the columns of documents and drop whole documents; none changes a text.

Null and empty texts are rated by the classifier's bias, fail the rules (too few words) and so go at the second stage at the latest. Long
texts are read whole by every stage. Equal texts fare alike in all stages but near-duplicate removal, where one of them
stays: that with the smallest id, null ids last; of rows that are equal in all columns one stays. Empty documents give empty stages. Without
labels, or with one grade, the classifier keeps all rows; without benchmark items decontamination does. Columns beside doc_id and text
may have any names and pass unchanged through all stages but the last.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, decontamination, quality_classifier, quality_rules, simhash
from quillon.llm.common import discard, read, scratch, store
from quillon.llm.queries import LEAST_TAIL, quality_model

POLICY = "v1"


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are likely to be graded over the lowest grade."""
    return quality_classifier.selected(docs, quality_model(spark, docs, sf_dir), LEAST_TAIL)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that pass the policy."""
    return quality_rules.filtered(docs, POLICY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each class of links at five bits of the words' fingerprint, verified by that of five-word shingles."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digest of the text that the ids decode to."""
    coded = bpe.encode_decode(docs, tokenizer_path("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("bpe", encode),
]

#: The classifier, the fingerprints and the encoder can't be expressed in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage stored besides its rows is deleted when they are written; the rows of a stage when those of the next are. Those that the last one reads stay."""
    docs, last = read(spark, sf_dir, "documents", dealt=True), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = store(stage(spark, docs, sf_dir), name, lasting=True)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)

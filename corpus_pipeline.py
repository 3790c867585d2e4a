"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import bpe, decontaminate, minhash, quality_rules, suffix_tree
from folioforge.llm.common import written
from folioforge.llm.queries import BPE_DIGEST, bpe_digest, table, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or that the list learned from the labels rejects, go."""
    whole = docs.select("doc_id", "text", F.struct("*").alias("document"))  # a document may have columns named as the verdict's
    judged, _ = quality_rules.judge(whole, table(spark, sf_dir, "labels"), keep=["doc_id", "document"])
    return judged.where("kept").select("document.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays (similarity of 0.8 or more)."""
    return minhash.drop_near_duplicates(docs, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that an earlier document has are cut; a document left without words goes."""
    return suffix_tree.cut_repeated_passages(docs, length=50, gram=20)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage within the edit budget of a benchmark item go."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and of the decoded text of each document that is left."""
    return bpe.encode_texts(docs, tokenizer_file(), digest=bpe_digest, digest_schema=BPE_DIGEST)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: The learned list and the similarity components are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k + 1}")
    return docs

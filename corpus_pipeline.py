"""From documents to token ids in five stages, each written as Parquet and read again.

Quality rules, line dedup, MinHash near-dedup and benchmark decontamination drop what they
reject; the last stage encodes what is left.  Every stage works on all rows of the one before.

Defined cases: a null or empty text has no words and goes in the first stage; rows are judged one by one,
so a null or repeated id neither saves nor costs a document, but for the near copies, of which the one
with the least id stays, a row without an id only if none has one, and of equal rows one; of the columns
only COLUMNS are read, so others don't matter; empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import op2_line_dedup, op6_minhash_dedup, op7_quality_rules, op9_decontamination, op10_byte_bpe
from tickloom.llm.tables import delete, release, shared_folder, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, with limits fitted on the labelled ones.  The rules' verdict travels with the text: no join."""
    return op7_quality_rules.keep_good(docs, limits=op7_quality_rules.fit_limits(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, and passages from fewer sites on; n_chars follows the text.  A document of which no word is left goes too."""
    out = op2_line_dedup.line_dedup(docs, long_sites=op2_line_dedup.LONG_SITES)
    changed = F.col("_n_removed") > 0
    out = out.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, null ids last."""
    return op6_minhash_dedup.distinct_documents(docs).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminating share of benchmark text."""
    return op9_decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of ids and decoded bytes."""
    return op10_byte_bpe.byte_bpe_digests(docs, *op10_byte_bpe.public_vocabulary())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", tokens),
]

#: zstandard ratios and BPE aren't SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_name, stage) in enumerate(STAGES):
        before = written(spark)
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
        # what the stage was made from isn't read again
        release(spark, before)
        if i:
            delete(spark, f"{folder}/{i - 1}")
    return docs

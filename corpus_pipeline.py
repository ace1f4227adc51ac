"""Raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.llm import exactdedup, jaccard, packing, quality, secrets
from graphquarry.llm.common import stash


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.3 go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space, one stays."""
    return exactdedup.keep_exact(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 0.8 or more of their five-word shingles, the smallest doc_id stays."""
    return jaccard.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; n_chars follows. All documents stay; a null text becomes empty."""
    return secrets.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences of 4096."""
    import public_tokenizers as P

    return packing.pack_documents(docs, P.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", dedup_exact),
    ("simhash near-dedup", dedup_near),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

#: The classifier's fit and the packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stash(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs

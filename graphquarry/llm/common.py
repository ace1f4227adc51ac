"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.sources.scratch import scratch_path, shared_dir, spread, stash

__all__ = ["arrow_limits", "keep_rows", "scratch_path", "settle", "shared_dir", "shuffle_parts", "small", "spread", "stash", "text_hash", "whole_row"]

#: Rows per Arrow batch. Texts can be 100 KB and more, so batches stay small.
ARROW_ROWS = 512


def arrow_limits(spark: SparkSession) -> None:
    """Bounds the bytes that a Python worker holds at once."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def settle() -> None:
    """Gives back what a Python worker no longer uses; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def whole_row(docs: DataFrame, *without: str) -> Column:
    """All columns of ``docs`` but some as one struct; names may hold dots and backticks."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in without])


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if, counted, it has at most ``max_rows`` rows; else as it is. For rows of bounded width."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_hash(text_col: str = "text") -> Column:
    """With the doc_id, what tells a row from others; null and empty texts are the same."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


#: Up to so many names of rows are sent to every task, so that texts needn't be shuffled; the result is the same beyond.
MAX_NAMES = 500_000


def keep_rows(docs: DataFrame, verdict: DataFrame, max_broadcast: int = MAX_NAMES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    verdict(doc_id, text_hash, stays): one row for each row of ``docs``; a null doc_id is an id like any
    other. Rows are told apart by both, so texts that share a doc_id have verdicts of their own. Of rows
    that agree in both and stay, one stays, that with the smallest JSON. ``max_broadcast``: up to so many
    names of rows that go are sent to every task, beyond it the join shuffles; the result is the same.
    """
    agreed = verdict.groupBy("doc_id", "text_hash").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    odd = agreed.filter(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "stays")
    odd = stash(odd, "verdict")
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").alias("_doc"), text_hash().alias("_text"))
    same = lambda d: F.col("_doc").eqNullSafe(d["_id"]) & (F.col("_text") == d["_hash"])
    sent = small(odd, max_broadcast)
    out = rows.join(sent, same(sent), "left_anti").select("row.*")
    repeated = odd.filter("stays")
    if repeated.isEmpty():
        return out
    repeated = small(repeated, max_broadcast)
    one = rows.join(repeated, same(repeated), "left_semi").groupBy("_doc", "_text").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.unionByName(one.select("row.*"))

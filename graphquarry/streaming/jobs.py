"""Streaming jobs: rolling cost, telemetry sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_cost(events: DataFrame, width: str = "60 minutes", slide: str = "10 minutes", late: str = "2 hours") -> DataFrame:
    """(start, repo_id, cost, n) for sliding windows; batch or streaming."""
    rows = events.withWatermark("created_at", late) if events.isStreaming else events
    out = rows.groupBy(F.window("created_at", width, slide).alias("w"), "repo_id").agg(F.sum("cost_usd").alias("cost"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "repo_id", "cost", "n")


def telemetry(rows: DataFrame, path: str) -> None:
    """Appends event rows as JSON lines."""
    rows.write.mode("append").json(path)

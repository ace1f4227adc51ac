"""Retrieval quality: metrics, sweeps, gates, baselines."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metrics(ranked: DataFrame, expected: DataFrame, by: list[str] | None = None, every: DataFrame | None = None) -> DataFrame:
    """Per query of ranked(query_id, file_id, rank): p5, hit5, recall, mrr, ndcg10.

    A query without expected files scores 1 in everything if nothing was returned, else 0. by: more
    key columns of ``ranked``, such as a configuration; every: all values of those, also ones that return
    nothing. Queries are those of either side.
    """
    by = by or []
    want = expected.groupBy("query_id").agg(F.count("*").alias("n_expected"))
    hits = ranked.join(expected.withColumn("_hit", F.lit(1)), ["query_id", "file_id"], "left")
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1)
    per = hits.groupBy(*by, "query_id").agg(
        F.count("*").alias("n_returned"), F.count_if((F.col("rank") <= 5) & (F.col("_hit") == 1)).alias("top5"), F.count_if(F.col("_hit") == 1).alias("found"),
        F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when((F.col("_hit") == 1) & (F.col("rank") <= 10), gain)).alias("dcg"),
    )
    if by:
        keys = (ranked.select(*by).distinct() if every is None else every).crossJoin(want.select("query_id"))  # configurations times queries
        both = keys.join(per, [*by, "query_id"], "full").join(want, "query_id", "left")
    else:
        both = per.join(want, "query_id", "full")
    n = F.coalesce("n_expected", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(10), n)).cast("int")), F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1))
    none = F.when(F.coalesce("n_returned", F.lit(0)) == 0, 1.0).otherwise(0.0)
    val = lambda c: F.when(n == 0, none).otherwise(F.coalesce(c, F.lit(0.0)))
    return both.select(
        *by, "query_id", val(F.col("top5") / 5).alias("p5"), val(F.col("top5") / F.least(F.lit(5), n)).alias("hit5"), val(F.col("found") / n).alias("recall"),
        val(F.lit(1.0) / F.col("first")).alias("mrr"), val(F.col("dcg") / ideal).alias("ndcg10"),
    )


NAMES = ["p5", "hit5", "recall", "mrr", "ndcg10"]


def means(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    return per_query.groupBy(*(by or [])).agg(*[F.avg(n).alias(n) for n in NAMES], F.count("*").alias("n_queries"))


def gates(mean: DataFrame, baseline_ndcg: float, least_p5: float = 0.15, least_mrr: float = 0.5, drop: float = 0.02) -> DataFrame:
    """(gate, passed) of one row of means."""
    tests = [("p5", F.col("p5") >= least_p5), ("mrr", F.col("mrr") >= least_mrr), ("ndcg", F.col("ndcg10") >= baseline_ndcg - drop)]
    return mean.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), t.alias("passed")) for n, t in tests])).alias("g")).select("g.*")


# The ablations, the grid and the forensic profiles, each in its order.
ABLATIONS = {
    "baseline": {}, "no-commit-boost": {"alpha": 0.0}, "no-parent-boost": {"beta": 0.0}, "no-child-boost": {"gamma": 0.0}, "pure-cosine": {"alpha": 0.0, "beta": 0.0, "gamma": 0.0},
    "high-parent": {"beta": 0.4, "parent_multiplier": 0.5}, "hybrid-0.3": {"hybrid": 0.3}, "hybrid-0.5": {"hybrid": 0.5}, "semantic-only": {"hybrid": 0.0}, "length-penalty": {"length_weight": 0.05},
}
GRID = {"alpha": [0.1, 0.15, 0.2, 0.25], "beta": [0.15, 0.2, 0.25], "hybrid": [0.2, 0.3, 0.4, 0.5], "length_weight": [0.0, 0.03, 0.05, 0.08], "min_score": [0.2, 0.25, 0.3]}
FORENSICS = {
    "baseline": {}, "no-hybrid": {"hybrid": 0.0}, "no-length-penalty": {"length_weight": 0.0}, "no-parent-boost": {"beta": 0.0, "parent_multiplier": 0.0}, "no-commit-boost": {"alpha": 0.0},
    "semantic-only": {"hybrid": 0.0, "length_weight": 0.0, "alpha": 0.0, "beta": 0.0, "parent_multiplier": 0.0},
}
CAUSES = {"no-hybrid": "hybrid-dilution", "no-length-penalty": "length-penalty", "no-parent-boost": "parent-boost-interference", "no-commit-boost": "commit-boost-noise", "semantic-only": "multi-factor-interference"}


def grid() -> dict[str, dict[str, float]]:
    """Every combination of GRID by its number, the last parameter changing fastest."""
    return {f"{i:04d}": dict(zip(GRID, values)) for i, values in enumerate(product(*GRID.values()))}


def best_config(mean: DataFrame) -> DataFrame:
    """(config, objective): the largest p5 + mrr; ties: the smaller name."""
    goal = F.round(F.col("p5") + F.col("mrr"), 9)
    return mean.select("config", goal.alias("objective")).orderBy(F.desc("objective"), "config").limit(1).select("config", F.round("objective", 6).alias("objective"))


def classify_changes(per_query: DataFrame, order: list[str], baseline: str = "baseline", delta: float = 0.05) -> DataFrame:
    """(query_id, best_config, cause, delta): queries whose mrr some other configuration betters by ``delta`` or more.

    Of equally good configurations the first in ``order`` counts.
    """
    base = per_query.filter(F.col("config") == baseline).select("query_id", F.col("mrr").alias("base"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("config"))
    best = per_query.filter(F.col("config") != baseline).groupBy("query_id").agg(F.max_by(F.struct("config", "mrr"), F.struct(F.round("mrr", 9), -place)).alias("b"))
    cause = F.lit("unknown")
    for name, why in CAUSES.items():
        cause = F.when(F.col("b.config") == name, F.lit(why)).otherwise(cause)
    both = base.join(best, "query_id").withColumn("delta", F.round(F.col("b.mrr") - F.col("base"), 9)).filter(F.col("delta") >= delta)
    return both.select("query_id", F.col("b.config").alias("best_config"), cause.alias("cause"), F.round("delta", 6).alias("delta"))


def keyword_baseline(files: DataFrame, queries: DataFrame, most: int = 5, n: int = 10) -> DataFrame:
    """(query_id, file_id, rank): files by the number of the query's longest keywords that they hold."""
    words = F.array_distinct(F.filter(F.split(F.lower("query"), "[^a-z0-9]+"), lambda w: F.length(w) > 2))
    longest = F.slice(F.array_sort(words, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)), 1, most)
    asked = queries.select("query_id", F.explode(longest).alias("word"))
    held = files.select("file_id", F.explode(F.array_distinct(F.split(F.lower("skeleton"), "[^a-z0-9]+"))).alias("word"))
    counts = held.join(asked, "word").groupBy("query_id", "file_id").agg(F.count("*").alias("n_words"))
    order = Window.partitionBy("query_id").orderBy(F.desc("n_words"), "file_id")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def diversity(ranked: DataFrame, files: DataFrame) -> DataFrame:
    """(query_id, n_files, n_folders) among the five best."""
    top = ranked.filter("rank <= 5").join(files.select("file_id", "dir_path"), "file_id")
    return top.groupBy("query_id").agg(F.countDistinct("file_id").alias("n_files"), F.countDistinct("dir_path").alias("n_folders"))

"""Access tokens, scopes, health, cost and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def validate(tokens: DataFrame, access: DataFrame, presented: DataFrame, now: Column) -> DataFrame:
    """(presented, reason, repo_ids): reason is ok, not_found, revoked or expired; repo_ids only if ok."""
    p = presented.select("presented", F.sha2("presented", 256).alias("token_hash"))
    both = p.join(tokens, "token_hash", "left")
    reason = F.when(F.col("token_id").isNull(), "not_found").when(F.col("revoked"), "revoked").when(F.col("expires_at") <= now, "expired").otherwise("ok")
    lists = access.groupBy("token_id").agg(F.array_sort(F.collect_list("repo_id")).alias("repo_ids"))
    out = both.withColumn("reason", reason).join(lists, "token_id", "left")
    return out.select("presented", "reason", F.when(F.col("reason") == "ok", F.array_join("repo_ids", ",")).alias("repo_ids"))


def in_scope(rows: DataFrame, scope: DataFrame) -> DataFrame:
    return rows.join(scope.select("repo_id"), "repo_id", "left_semi")


def edges_in_scope(edges: DataFrame, scope: DataFrame) -> DataFrame:
    """Edges with either end in scope."""
    s = scope.select(F.col("repo_id").alias("source_repo"), F.lit(True).alias("_s")).distinct()
    t = scope.select(F.col("repo_id").alias("target_repo"), F.lit(True).alias("_t")).distinct()
    return edges.join(s, "source_repo", "left").join(t, "target_repo", "left").filter("_s or _t").select(*edges.columns)


def cost_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("operation", "model").agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("n")
    ).orderBy(F.desc("cost_usd"))


def recent_cost(events: DataFrame, now: Column) -> DataFrame:
    """(repo_id, cost): the last 60 minutes before now; none: no row."""
    return events.filter((F.col("created_at") > now - F.expr("INTERVAL 60 MINUTES")) & (F.col("created_at") <= now)).groupBy("repo_id").agg(F.sum("cost_usd").alias("cost"))


def cap_exceeded(cost: Column, limit: float | None) -> Column:
    return F.lit(False) if limit is None else F.coalesce(cost, F.lit(0.0)) >= limit


def projected_cost(files: Column, commits: Column, price_in: float, price_out: float) -> Column:
    """Dollars for an index: 500 tokens a file, 50 a commit, and 2000 in and 200 out for each folder of five files; prices per million."""
    folders = F.greatest(F.lit(1), F.ceil(files / 5))
    return ((files * 500 + commits * 50 + folders * 2000) * price_in + folders * 200 * price_out) / 1e6


def health(policies: dict[str, tuple[Column, str]], rows: DataFrame) -> DataFrame:
    """(policy, severity, passed) of aggregates over ``rows``: one pass for all policies."""
    one = rows.agg(*[c.alias(n) for n, (c, _) in policies.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(sev).alias("severity"), F.col(n).alias("passed")) for n, (_, sev) in policies.items()])).alias("p")).select("p.*")


def overall(report: DataFrame) -> DataFrame:
    """One row: passes unless a policy of severity error fails."""
    return report.agg((F.count_if((F.col("severity") == "error") & ~F.col("passed")) == 0).alias("passed"), F.count("*").alias("n_policies"))


def checksums(applied: DataFrame, shipped: DataFrame) -> DataFrame:
    """(version, status): ok, changed or missing for every applied migration."""
    both = applied.join(shipped.withColumnRenamed("checksum", "expected"), "version", "left")
    return both.select("version", F.when(F.col("expected").isNull(), "missing").when(F.col("expected") == F.col("checksum"), "ok").otherwise("changed").alias("status"))

"""Queries of access, cost, health and status."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphquarry.operators import access as a

from .registry import query


@query("validate_tokens", """WITH p AS (SELECT r_name AS presented FROM region UNION ALL SELECT 'nobody'), l AS (SELECT token_id, string_agg(repo_id, ',' ORDER BY repo_id) AS ids FROM token_repo_access GROUP BY token_id),
 x AS (SELECT presented, CASE WHEN t.token_id IS NULL THEN 'not_found' WHEN revoked THEN 'revoked' WHEN expires_at <= TIMESTAMP '2024-01-02' THEN 'expired' ELSE 'ok' END AS reason, ids FROM p LEFT JOIN tokens t ON sha256(p.presented) = t.token_hash LEFT JOIN l ON t.token_id = l.token_id)
 SELECT presented, reason, CASE WHEN reason = 'ok' THEN ids END AS repo_ids FROM x""")
def _(v):
    names = v.table("region").select(F.col("r_name").alias("presented"))
    shown = names.unionByName(names.limit(1).select(F.lit("nobody").alias("presented")))  # one made-up token
    return a.validate(v.tokens, v.token_repo_access, shown, F.lit("2024-01-02").cast("timestamp"))


@query("list_tokens", "SELECT t.name, string_agg(a.repo_id, ',' ORDER BY a.repo_id) AS repo_ids, t.revoked FROM tokens t LEFT JOIN token_repo_access a USING (token_id) GROUP BY t.name, t.revoked")
def _(v):
    t = v.tokens.join(v.token_repo_access, "token_id", "left").groupBy("name", "revoked").agg(F.array_join(F.array_sort(F.collect_list("repo_id")), ",").alias("repo_ids"))
    return t.select("name", "repo_ids", "revoked")


@query("row_scope", "SELECT file_id FROM files WHERE repo_id IN (SELECT repo_id FROM token_repo_access WHERE token_id = 1)")
def _(v):
    return a.in_scope(v.files, v.token_repo_access.filter("token_id = 1")).select("file_id")


@query("edge_scope", "SELECT source_file, target_file, imported_module FROM cross_repo_edges WHERE source_repo IN (SELECT repo_id FROM token_repo_access WHERE token_id = 2) OR target_repo IN (SELECT repo_id FROM token_repo_access WHERE token_id = 2)")
def _(v):
    return a.edges_in_scope(v.cross_repo_edges, v.token_repo_access.filter("token_id = 2")).select("source_file", "target_file", "imported_module")


@query("cost_summary", "SELECT operation, model, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost_usd), 4) AS cost_usd, count(*) AS n FROM cost_events GROUP BY ALL")
def _(v):
    return a.cost_summary(v.cost_events).withColumn("cost_usd", F.round("cost_usd", 4))


@query("recent_cost", "SELECT repo_id, round(sum(cost_usd), 4) AS cost FROM cost_events WHERE created_at > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 60 MINUTE AND created_at <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY repo_id")
def _(v):
    return a.recent_cost(v.cost_events, F.lit("2024-01-15 12:00:00").cast("timestamp")).select("repo_id", F.round("cost", 4).alias("cost"))


@query("cost_caps", "SELECT repo_id, coalesce(sum(cost_usd), 0) >= 20000 AS exceeded FROM cost_events GROUP BY repo_id")
def _(v):
    return v.cost_events.groupBy("repo_id").agg(F.sum("cost_usd").alias("c")).select("repo_id", a.cap_exceeded(F.col("c"), 20000.0).alias("exceeded"))


@query("projected_cost", "SELECT f.repo_id, round(((n * 500 + m * 50 + greatest(1, ceil(n / 5.0)) * 2000) * 0.02 + greatest(1, ceil(n / 5.0)) * 200 * 0.6) / 1e6, 6)::DOUBLE AS cost FROM (SELECT repo_id, count(*) AS n FROM files GROUP BY 1) f JOIN (SELECT repo_id, count(*) AS m FROM commits GROUP BY 1) c ON f.repo_id = c.repo_id")
def _(v):
    n = v.files.groupBy("repo_id").agg(F.count("*").alias("n")).join(v.commits.groupBy("repo_id").agg(F.count("*").alias("m")), "repo_id")
    return n.select("repo_id", F.round(a.projected_cost(F.col("n"), F.col("m"), 0.02, 0.6), 6).alias("cost"))


@query("repo_status", "SELECT r.repo_id, r.name, count(f.file_id) AS n_files, strftime(max(f.indexed_at), '%Y-%m-%d %H:%M:%S') AS last_indexed FROM repos r LEFT JOIN files f USING (repo_id) GROUP BY ALL")
def _(v):
    s = v.repos.join(v.files.select("repo_id", "file_id", "indexed_at"), "repo_id", "left").groupBy("repo_id", "name")
    return s.agg(F.count("file_id").alias("n_files"), F.date_format(F.max("indexed_at"), "yyyy-MM-dd HH:mm:ss").alias("last_indexed"))


@query("index_counts", "SELECT 'files' AS kind, count(*) AS n FROM files UNION ALL SELECT 'directories', count(*) FROM directories UNION ALL SELECT 'commits', count(*) FROM commits UNION ALL SELECT 'imports', count(*) FROM file_imports")
def _(v):
    out = None
    for kind, df in (("files", v.files), ("directories", v.directories), ("commits", v.commits), ("imports", v.file_imports)):
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _policies():
    return {
        "index_freshness": (F.count_if(F.col("indexed_at") < F.lit("2024-01-01 08:00:00").cast("timestamp")) / F.count("*") < 0.5, "error"),
        "skeletons": (F.count_if(F.col("skeleton").isNull() | (F.length("skeleton") == 0)) == 0, "error"),
        "short_skeletons": (F.count_if(F.length("skeleton") < 20) / F.count("*") < 0.0001, "warning"),
    }


_HEALTH = """h AS (SELECT 'index_freshness' AS policy, 'error' AS severity, count(*) FILTER (WHERE indexed_at < TIMESTAMP '2024-01-01 08:00:00') / count(*) < 0.5 AS passed FROM files
 UNION ALL SELECT 'skeletons', 'error', count(*) FILTER (WHERE skeleton IS NULL OR length(skeleton) = 0) = 0 FROM files
 UNION ALL SELECT 'short_skeletons', 'warning', count(*) FILTER (WHERE length(skeleton) < 20) / count(*) < 0.0001 FROM files)"""


@query("health_policies", f"WITH {_HEALTH} SELECT * FROM h")
def _(v):
    return a.health(_policies(), v.files)


@query("health_overall", f"WITH {_HEALTH} SELECT count(*) FILTER (WHERE severity = 'error' AND NOT passed) = 0 AS passed, count(*) AS n_policies FROM h")
def _(v):
    return a.overall(a.health(_policies(), v.files))


@query("summary_completeness", "SELECT count(*) AS n, count(summary_vec) AS with_summary, round(count(summary_vec) / count(*), 6) AS share FROM directories")
def _(v):
    return v.directories.agg(F.count("*").alias("n"), F.count("summary_vec").alias("with_summary"), F.round(F.count("summary_vec") / F.count("*"), 6).alias("share"))


@query("needs_review", "SELECT file_id FROM files WHERE skeleton IS NULL OR length(skeleton) < 20")
def _(v):
    return v.files.filter(F.col("skeleton").isNull() | (F.length("skeleton") < 20)).select("file_id")


@query("migration_checksums", "SELECT n_nationkey AS version, CASE WHEN n_nationkey % 5 = 4 THEN 'missing' WHEN n_nationkey % 5 = 3 THEN 'changed' ELSE 'ok' END AS status FROM nation")
def _(v):
    n = v.table("nation")
    applied = n.select(F.col("n_nationkey").alias("version"), F.md5("n_name").alias("checksum"))
    shipped = n.filter("n_nationkey % 5 <> 4").select(F.col("n_nationkey").alias("version"), F.when(F.col("n_nationkey") % 5 == 3, "other").otherwise(F.md5("n_name")).alias("checksum"))
    return a.checksums(applied, shipped)


@query("embedding_dimensions", "SELECT len(embedding)::BIGINT AS dimensions, count(*) AS n FROM embeddings GROUP BY 1")
def _(v):
    return v.table("embeddings").groupBy(F.size("embedding").cast("long").alias("dimensions")).agg(F.count("*").alias("n"))


@query("dedup_stats", "SELECT file_type, count(*) AS n_files, count(DISTINCT content_hash) AS n_blobs, round(1 - count(DISTINCT content_hash) / count(*), 6) AS saved FROM files GROUP BY file_type")
def _(v):
    n = F.countDistinct("content_hash")
    return v.files.groupBy("file_type").agg(F.count("*").alias("n_files"), n.alias("n_blobs"), F.round(1 - n / F.count("*"), 6).alias("saved"))


@query("address_resolution", "SELECT query_id, coalesce(CASE WHEN query_id % 4 = 0 THEN 'local' END, CASE WHEN query_id % 3 = 0 THEN 'cache' END, CASE WHEN query_id % 2 = 0 THEN 'remote' END, 'relay') AS found FROM queries")
def _(v):
    q = v.queries.select("query_id")
    for k, name in ((4, "local"), (3, "cache"), (2, "remote")):
        q = q.join(v.queries.filter(F.col("query_id") % k == 0).select("query_id", F.lit(name).alias(name)), "query_id", "left")
    return q.select("query_id", F.coalesce("local", "cache", "remote", F.lit("relay")).alias("found"))


@query("repo_names_with_fallback", "SELECT DISTINCT c.repo_id, coalesce(r.name, 'repo:' || c.repo_id) AS name FROM (SELECT repo_id FROM commits UNION SELECT -1 - query_id FROM queries) c LEFT JOIN repos r USING (repo_id)")
def _(v):
    ids = v.commits.select("repo_id").union(v.queries.select(-1 - F.col("query_id"))).distinct()  # the latter have no name
    return ids.join(v.repos, "repo_id", "left").select("repo_id", F.coalesce("name", F.concat(F.lit("repo:"), F.col("repo_id").cast("string"))).alias("name"))


@query("remove_repo", "SELECT f.repo_id, count(*) AS n FROM files f WHERE repo_id <> 4 GROUP BY f.repo_id")
def _(v):
    from graphquarry.operators.etl import stale

    return stale(v.files, v.repos.filter("repo_id = 4"), ["repo_id"]).groupBy("repo_id").agg(F.count("*").alias("n"))

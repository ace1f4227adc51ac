"""Queries of windows and sequential state."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphquarry.sources.scratch import scratch_path, stash
from graphquarry.streaming import jobs, limits, references, tables

from .registry import query


@query("rolling_cost", """WITH w AS (SELECT repo_id, cost_usd, unnest(generate_series(time_bucket(INTERVAL 10 MINUTE, created_at) - INTERVAL 50 MINUTE, time_bucket(INTERVAL 10 MINUTE, created_at), INTERVAL 10 MINUTE)) AS s FROM cost_events)
 SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, repo_id, round(sum(cost_usd), 4) AS cost, count(*) AS n FROM w GROUP BY ALL""")
def _(v):
    return jobs.rolling_cost(v.cost_events).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "repo_id", F.round("cost", 4).alias("cost"), "n")


def _folded(key: str, value: str, state: str, first: str, step: str, outcome: str) -> str:
    """SQL for a fold over each key's events by time and event_id: state columns s, their first values and their next."""
    return f"""WITH RECURSIVE e AS (SELECT {key} AS k, event_id, epoch_us(ts) / 1000000.0::DOUBLE AS t, {value} AS x, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events),
 f AS (SELECT k, event_id, t, x, rn, {first} FROM e WHERE rn = 1 UNION ALL SELECT k, event_id, t, x, rn, {step} FROM (SELECT e.*, {state} FROM f JOIN e ON e.k = f.k AND e.rn = f.rn + 1))
 SELECT k AS {key}, event_id, {outcome} AS outcome FROM f"""


_ACCEPTED = "CASE WHEN ok THEN 'accepted' ELSE 'rejected' END"


@query("call_limiter", _folded("event_type", "NULL", "list_filter(f.log, lambda y: e.t - y < 3600) AS held", "[t] AS log, true AS ok", "CASE WHEN len(held) >= 5 THEN held ELSE list_append(held, t) END, len(held) < 5", _ACCEPTED))
def _(v):
    out = limits.fold(v.table("events"), "event_type", "ts", "event_id", lambda: limits.SlidingLog(5, 3600))
    return out.select(F.col("key").alias("event_type"), F.col("tie").alias("event_id"), "outcome")


@query("token_bucket", _folded(
    "user_id", "NULL", "CASE WHEN e.t - f.since > 172800 THEN 2 ELSE f.tokens END AS n, CASE WHEN e.t - f.since > 172800 THEN e.t ELSE f.since END AS z", "1 AS tokens, t AS since, true AS ok",
    "CASE WHEN floor((t - z) / 86400 * 2) > 0 THEN least(2, n + floor((t - z) / 86400 * 2)::INT) ELSE n END - (CASE WHEN floor((t - z) / 86400 * 2) > 0 THEN least(2, n + floor((t - z) / 86400 * 2)::INT) ELSE n END > 0)::INT,"
    " CASE WHEN floor((t - z) / 86400 * 2) > 0 THEN t ELSE z END, CASE WHEN floor((t - z) / 86400 * 2) > 0 THEN least(2, n + floor((t - z) / 86400 * 2)::INT) ELSE n END > 0", _ACCEPTED))
def _(v):
    out = limits.fold(v.table("events"), "user_id", "ts", "event_id", lambda: limits.TokenBucket(2, 86400))
    return out.select(F.col("key").alias("user_id"), F.col("tie").alias("event_id"), "outcome")


@query("embedding_cache", _folded(
    "event_type", "user_id::VARCHAR", "list_filter(f.held, lambda y: y.v = e.x AND e.t - y.m <= 86400) AS found, list_filter(f.held, lambda y: y.v <> e.x) AS rest", "[{'v': x, 'm': t}] AS held, false AS ok",
    "CASE WHEN len(rest) >= 20 THEN list_append(rest, {'v': x, 'm': CASE WHEN len(found) > 0 THEN found[1].m ELSE t END})[2:] ELSE list_append(rest, {'v': x, 'm': CASE WHEN len(found) > 0 THEN found[1].m ELSE t END}) END, len(found) > 0",
    "CASE WHEN ok THEN 'hit' ELSE 'miss' END"))
def _(v):
    out = limits.fold(v.table("events"), "event_type", "ts", "event_id", lambda: limits.LruTtl(20, 86400), "user_id")
    return out.select(F.col("key").alias("event_type"), F.col("tie").alias("event_id"), "outcome")


@query("sessions_by_gap", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS s FROM events) SELECT user_id, sum(s)::BIGINT AS n_sessions FROM e GROUP BY user_id""")
def _(v):
    w = v.table("events").groupBy("user_id", F.session_window("ts", "1 day")).agg(F.count("*").alias("n"))
    return w.groupBy("user_id").agg(F.count("*").alias("n_sessions"))


@query("incremental_upserts", """SELECT user_id, event_id, event_type, value FROM events
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_type <> 'error'""")
def _(v):
    e = v.table("events").select("user_id", "event_id", "event_type", "value", "ts")
    t = tables.KeyedTable(v.spark, scratch_path(v.spark, "upserts"), e.schema, ["user_id"], ["ts", "event_id"])
    for number, part in enumerate((0, 2, 2, 1)):  # out of order, and one batch comes twice
        t.merge(e.filter(F.col("event_id") % 3 == part), number, F.col("event_type") == "error")
    return t.rows().select("user_id", "event_id", "event_type", "value")


@query("incremental_recency", """SELECT file_id, commit_id, row_number() OVER (PARTITION BY file_id ORDER BY authored_at DESC, commit_id) AS recency
 FROM file_commits JOIN commits USING (commit_id) WHERE message <> '1-URGENT'""")
def _(v):
    links = v.file_commits.select("file_id", "commit_id").join(v.commits.select("commit_id", "authored_at", "message"), "commit_id")
    links = stash(links.select("file_id", "commit_id", "authored_at", "message"), "links")  # read by each batch
    t = tables.KeyedTable(
        v.spark, scratch_path(v.spark, "links"), "file_id long, commit_id long, authored_at timestamp, at int", ["file_id", "commit_id"], ["at"], 16, ["file_id"],
        (["file_id"], [F.desc("authored_at"), "commit_id"], "recency"),
    )
    dated = lambda at: links.select("file_id", "commit_id", F.col("authored_at").cast("timestamp").alias("authored_at"), F.lit(at).alias("at"), "message")
    t.merge(dated(1).filter("commit_id % 4 > 0"), 0)
    t.merge(dated(2).filter("message = '1-URGENT'"), 1, F.lit(True))  # some of these links come later, but are older
    t.merge(dated(1).filter("commit_id % 4 = 0"), 2)
    return t.rows().select("file_id", "commit_id", "recency")


@query("incremental_index", """WITH gone AS (SELECT file_id FROM expected), kept AS (SELECT * FROM files WHERE file_id NOT IN (SELECT file_id FROM gone)),
 l AS (SELECT file_id, commit_id, row_number() OVER (PARTITION BY file_id ORDER BY authored_at DESC, commit_id) AS recency FROM file_commits JOIN commits USING (commit_id) WHERE file_id IN (SELECT file_id FROM kept))
 SELECT file_id, CASE WHEN file_id % 5 = 0 THEN sha256(content_hash) ELSE content_hash END AS content_hash, count(commit_id) AS n_commits, min(commit_id) FILTER (WHERE recency = 1) AS newest
 FROM kept LEFT JOIN l USING (file_id) GROUP BY ALL""")
def _(v):
    files = tables.KeyedTable(v.spark, scratch_path(v.spark, "files"), "file_id long, content_hash string, at int", ["file_id"], ["at"], 16)
    links = tables.KeyedTable(
        v.spark, scratch_path(v.spark, "links"), "file_id long, commit_id long, authored_at timestamp, at int", ["file_id", "commit_id"], ["at"], 16, ["file_id"],
        (["file_id"], [F.desc("authored_at"), "commit_id"], "recency"),
    )
    rows = lambda at: v.files.select("file_id", "content_hash", F.lit(at).alias("at"))
    dated = v.file_commits.select("file_id", "commit_id").join(v.commits.select("commit_id", F.col("authored_at").cast("timestamp").alias("authored_at")), "commit_id")
    dated = stash(dated.select("file_id", "commit_id", "authored_at", F.lit(1).alias("at")), "dated")
    none, gone = rows(1).limit(0).select("file_id", "at"), v.expected.select("file_id").distinct()
    tables.update_index(files, links, rows(1), none, dated.filter("commit_id % 3 > 0"), 0)
    changed = rows(2).filter("file_id % 5 = 0").withColumn("content_hash", F.sha2("content_hash", 256)).join(gone, "file_id", "left_anti")
    late = dated.filter("commit_id % 3 = 0")
    tables.update_index(files, links, changed, gone.withColumn("at", F.lit(2)), late, 1)
    tables.update_index(files, links, changed, gone.withColumn("at", F.lit(2)), late, 1)  # again, after a failure
    shown = links.rows().groupBy("file_id").agg(F.count("*").alias("n_commits"), F.min(F.when(F.col("recency") == 1, F.col("commit_id"))).alias("newest"))
    return files.rows().join(shown, "file_id", "left").select("file_id", "content_hash", F.coalesce("n_commits", F.lit(0)).alias("n_commits"), "newest")


@query("gc_by_counts", """WITH b AS (SELECT content_hash FROM blobs UNION SELECT sha256(html) FROM pages), live AS (
  SELECT content_hash FROM files WHERE file_id NOT IN (SELECT file_id FROM expected) UNION SELECT sha256(html) FROM pages WHERE page_id IN (SELECT query_id FROM queries) AND page_id % 2 = 0)
 SELECT content_hash FROM b WHERE content_hash NOT IN (SELECT content_hash FROM live)""")
def _(v):
    blobs = references.ReferenceCounts(v.spark, scratch_path(v.spark, "blob-counts"), 16)
    packages = references.ReferenceCounts(v.spark, scratch_path(v.spark, "package-counts"), 4)
    page = v.table("pages").select("page_id", F.sha2("html", 256).alias("name"))
    held = page.join(v.queries.select(F.col("query_id").alias("page_id")), "page_id", "left_semi").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("package"), "name", "page_id")
    files = v.files.select("file_id", F.col("content_hash").alias("name"))
    blobs.apply(0, files.select("name").unionByName(held.select("name")), names=page.select("name"))
    packages.apply(0, held.filter("page_id % 2 = 0").select(F.col("package").alias("name")), names=held.select(F.col("package").alias("name")))
    blobs.apply(1, files.limit(0), files.join(v.expected.select("file_id").distinct(), "file_id", "left_semi"))  # some files go
    _, gone = packages.sweep(1)  # half of the packages have no repository
    freed = held.join(gone.select(F.col("name").alias("package")), "package", "left_semi").select("name")
    blobs.apply(2, freed.limit(0), freed)
    return blobs.sweep(3)[1].select(F.col("name").alias("content_hash"))

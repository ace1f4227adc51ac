"""Queries of building an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphquarry.operators import build as b
from graphquarry.operators import graph as g
from graphquarry.operators import search as s
from graphquarry.operators import store as st
from graphquarry.operators.etl import embed_plan, tree_hash

from .filters import _SQL_SECRETS
from .registry import query


@query("ls_tree_entries", """SELECT repo_id, file_path AS path, substr(content_hash, 1, 40) AS oid FROM files WHERE file_type <> '.md' AND repo_id NOT IN (SELECT repo_id FROM files JOIN expected USING (file_id) WHERE file_type = '.java' AND file_id % 7 = 0)""")
def _(v):
    kind = F.when(F.col("file_type") == ".md", "160000 commit ").otherwise("100644 blob ")
    lines = v.files.select("repo_id", F.concat(kind, F.substring("content_hash", 1, 40), F.lit("\t"), "file_path").alias("line"))
    odd = v.files.join(v.expected, "file_id", "left_semi").filter("file_type = '.java' and file_id % 7 = 0")
    status = odd.select("repo_id", F.concat(F.lit(" M "), "file_path").alias("line")).unionByName(v.repos.select("repo_id", F.lit(" ").alias("line")))
    return b.tree_entries(lines, status)


@query("diff_tree_paths", "SELECT l_orderkey, 'p' || l_partkey AS path, count(*) AS n FROM lineitem GROUP BY ALL")
def _(v):
    raw = v.table("lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.concat(F.array_join(F.collect_list(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))), "\0"), F.lit("\0")).alias("paths"))
    return b.diff_tree(raw).groupBy(F.col("key").alias("l_orderkey"), "path").agg(F.count("*").alias("n"))


@query("dependency_paths", """WITH e AS (SELECT repo_id, file_id, CASE file_id % 6 WHEN 0 THEN 'node_modules/p' || file_id WHEN 1 THEN 'node_modules/@s/p' || file_id WHEN 2 THEN 'vendor/q' || file_id WHEN 3 THEN 'node_modules/.bin' || file_id WHEN 4 THEN 'node_modules/a/node_modules/p' || file_id ELSE 'src/p' || file_id END AS path,
   '/store/' || (file_id // 12) || CASE WHEN file_id % 6 = 1 THEN 'x' ELSE '' END AS realpath FROM files)
 SELECT repo_id, min_by(path, CASE WHEN path LIKE 'vendor%' THEN 'b' ELSE 'a' END || path) AS path, realpath FROM e WHERE file_id % 6 < 3 GROUP BY repo_id, realpath""")
def _(v):
    d, k = F.col("file_id").cast("string"), F.col("file_id") % 6
    kinds = ["node_modules/p", "node_modules/@s/p", "vendor/q", "node_modules/.bin", "node_modules/a/node_modules/p"]
    path = F.concat(F.lit("src/p"), d)
    for i, name in enumerate(kinds):
        path = F.when(k == i, F.concat(F.lit(name), d)).otherwise(path)
    real = F.concat(F.lit("/store/"), F.expr("file_id div 12").cast("string"), F.when(k == 1, "x").otherwise(""))
    return b.dependency_packages(v.files.select("repo_id", path.alias("path"), real.alias("realpath")))


_COLLECTED = f"""c AS (SELECT f.*, {_SQL_SECRETS} <> '' AS secret, f.file_type = '.go' AS published FROM files f WHERE strlen(skeleton) <= 20000 AND file_id NOT IN (SELECT file_id FROM expected)),
 k AS (SELECT c.*, bl.blob_id IS NOT NULL AS cached FROM c LEFT JOIN (SELECT * FROM blobs WHERE blob_id IN (SELECT file_id FROM expected)) bl USING (content_hash) WHERE NOT secret OR published)"""


def collected(v):
    """A run over all files: those of expected are unchanged, and the store holds their contents."""
    files = v.files.select("repo_id", "file_path", "file_type", F.concat(F.lit("\0"), "skeleton").alias("content"))
    good = v.files.join(v.expected, "file_id", "left_semi")
    blobs = v.blobs.join(v.expected.select(F.col("file_id").alias("blob_id")), "blob_id", "left_semi").select("content_hash", F.array(F.col("blob_id").cast("double")).alias("vec"))
    return b.collect(files, good, blobs, published=v.files.filter("file_type = '.go'"), max_bytes=20_001)


@query("collect_files", f"WITH {_COLLECTED} SELECT repo_id, file_path, content_hash, cached, secret AS overridden FROM k")
def _(v):
    return collected(v).select("repo_id", "file_path", "content_hash", "cached", "overridden")


@query("dedup_hit_rate", f"WITH {_COLLECTED} SELECT repo_id, count(*) FILTER (WHERE cached) AS hits, count(*) FILTER (WHERE NOT cached) AS misses, round(count(*) FILTER (WHERE cached) / count(*), 6) AS rate FROM k GROUP BY repo_id")
def _(v):
    return b.dedup_rate(collected(v), ["repo_id"])


@query("embed_files", f"""WITH {_COLLECTED}, spent AS (SELECT repo_id, sum(cost_usd) AS cost FROM cost_events GROUP BY repo_id), lim AS (SELECT median(cost) AS cap FROM spent),
 o AS (SELECT repo_id FROM k JOIN spent USING (repo_id), lim GROUP BY repo_id HAVING max((NOT cached)::INT) = 1 AND max(cost) >= max(cap))
 SELECT repo_id, file_path, cached FROM k WHERE repo_id NOT IN (SELECT repo_id FROM o) AND (cached OR length(skeleton) % 5 <> 0)""")
def _(v):
    spent = v.cost_events.groupBy("repo_id").agg(F.sum("cost_usd").alias("cost"))
    cap = spent.agg(F.median("cost")).first()[0]
    rows = collected(v).join(spent, "repo_id", "left")
    fresh = rows.filter("not cached").select("content_hash", F.when(F.length("content") % 5 != 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("vec")).dropDuplicates(["content_hash"])
    return b.embed_files(rows, fresh, F.col("cost"), cap).select("repo_id", "file_path", "cached")


def _summary(concat, children):
    return F.concat(F.lit("sum "), F.substring(F.sha2(F.concat(concat, F.lit("|"), children), 256), 1, 8))


@query("build_directories", """WITH f AS (SELECT *, '--- ' || file_path || ' ---' || chr(10) || skeleton AS t FROM files),
 a AS (SELECT repo_id, dir_path, string_agg(t, chr(10) || chr(10) ORDER BY file_path) FILTER (WHERE skeleton <> '') AS c, sha256(string_agg(file_path || ':' || content_hash, chr(10) ORDER BY file_path || ':' || content_hash)) AS h FROM f GROUP BY ALL),
 a2 AS (SELECT a.*, d.summary_vec IS NOT NULL AS hit, CASE WHEN d.summary_vec IS NOT NULL THEN 'kept ' || a.dir_path ELSE 'sum ' || substr(sha256(coalesce(c, '') || '|'), 1, 8) END AS s FROM a LEFT JOIN directories d USING (repo_id, dir_path)),
 b AS (SELECT repo_id, string_split(dir_path, '/')[1] AS dir_path, sha256(string_agg('dir:' || dir_path || ':' || substr(sha256(s), 1, 16), chr(10) ORDER BY 'dir:' || dir_path || ':' || substr(sha256(s), 1, 16))) AS h, 'sum ' || substr(sha256('|' || string_agg('[' || dir_path || ']: ' || s, chr(10) ORDER BY dir_path)), 1, 8) AS s FROM a2 GROUP BY ALL),
 r AS (SELECT repo_id, '.' AS dir_path, sha256(string_agg('dir:' || dir_path || ':' || substr(sha256(s), 1, 16), chr(10) ORDER BY 'dir:' || dir_path || ':' || substr(sha256(s), 1, 16))) AS h, 'sum ' || substr(sha256('|' || string_agg('[' || dir_path || ']: ' || s, chr(10) ORDER BY dir_path)), 1, 8) AS s FROM b GROUP BY repo_id)
 SELECT repo_id, dir_path, 2 AS depth, sha256(coalesce(c, '')) AS concat_hash, h AS children_hash, s AS summary, hit AS cache_hit FROM a2
 UNION ALL SELECT repo_id, dir_path, 1, sha256(''), h, s, false FROM b UNION ALL SELECT repo_id, dir_path, 0, sha256(''), h, s, false FROM r""")
def _(v):
    parts = v.files.select("repo_id", "dir_path", F.concat("file_path", F.lit(":"), "content_hash").alias("p")).groupBy("repo_id", "dir_path")
    stored = parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("p")), "\n"), 256).alias("children_hash"))
    stored = stored.join(v.directories, ["repo_id", "dir_path"]).withColumn("summary", F.when(F.col("summary_vec").isNotNull(), F.concat(F.lit("kept "), "dir_path")))
    out = b.build_directories(v.files, stored, _summary)
    return out.select("repo_id", "dir_path", "depth", F.sha2("concat_skeleton", 256).alias("concat_hash"), "children_hash", "summary", "cache_hit")


_PRUNED = """dead AS (SELECT DISTINCT repo_id FROM token_repo_access JOIN tokens USING (token_id) WHERE revoked AND repo_id IN (SELECT repo_id FROM repos)),
 live AS (SELECT * FROM repos WHERE repo_id IN (SELECT repo_id FROM files JOIN expected USING (file_id)) OR repo_id IN (SELECT repo_id FROM dead)), lf AS (SELECT * FROM files WHERE file_id NOT IN (SELECT query_id FROM queries)), lc AS (SELECT * FROM commits WHERE message <> '1-URGENT')"""


def _tables(v):
    """An index whose files and commits have partly gone, and its dead repositories."""
    dead = v.token_repo_access.join(v.tokens.filter("revoked"), "token_id", "left_semi").select("repo_id").distinct().join(v.repos, "repo_id", "left_semi")
    held = v.files.join(v.expected, "file_id", "left_semi").select("repo_id").union(dead).distinct()
    names = ("directories", "cost_events", "file_commits", "file_imports", "cross_repo_edges")
    tables = {n: getattr(v, n) for n in names} | {"repos": v.repos.join(held, "repo_id", "left_semi"), "commits": v.commits.filter("message <> '1-URGENT'")}
    tables["files"] = v.files.join(v.queries.select(F.col("query_id").alias("file_id")), "file_id", "left_anti")
    return tables, dead


@query("orphan_counts", f"""WITH {_PRUNED}
 SELECT 'repos' AS class, (SELECT count(*) FROM dead)::BIGINT AS n UNION ALL SELECT 'files', (SELECT count(*) FROM lf WHERE repo_id NOT IN (SELECT repo_id FROM live)) UNION ALL SELECT 'commits', (SELECT count(*) FROM lc WHERE repo_id NOT IN (SELECT repo_id FROM live))
 UNION ALL SELECT 'directories', (SELECT count(*) FROM directories WHERE repo_id NOT IN (SELECT repo_id FROM live)) UNION ALL SELECT 'cost_events', (SELECT count(*) FROM cost_events WHERE repo_id NOT IN (SELECT repo_id FROM live))
 UNION ALL SELECT 'file_commits', (SELECT count(*) FROM file_commits WHERE file_id NOT IN (SELECT file_id FROM lf) OR commit_id NOT IN (SELECT commit_id FROM lc))
 UNION ALL SELECT 'file_imports', (SELECT count(*) FROM file_imports WHERE source_file_id NOT IN (SELECT file_id FROM lf)) + (SELECT count(*) FROM file_imports WHERE source_file_id IN (SELECT file_id FROM lf WHERE repo_id IN (SELECT repo_id FROM dead)))
 UNION ALL SELECT 'cross_repo_edges', (SELECT count(*) FROM cross_repo_edges WHERE source_repo NOT IN (SELECT repo_id FROM live) OR target_repo NOT IN (SELECT repo_id FROM live) OR source_file NOT IN (SELECT file_id FROM lf)) + (SELECT count(*) FROM cross_repo_edges WHERE source_repo IN (SELECT repo_id FROM dead) OR target_repo IN (SELECT repo_id FROM dead))""")
def _(v):
    return b.orphan_counts(*_tables(v))


@query("prune_orphans", f"""WITH {_PRUNED}, lr AS (SELECT repo_id FROM live WHERE repo_id NOT IN (SELECT repo_id FROM dead)), kf AS (SELECT * FROM lf WHERE repo_id IN (SELECT repo_id FROM lr)), kc AS (SELECT * FROM lc WHERE repo_id IN (SELECT repo_id FROM lr))
 SELECT 'repos' AS name, count(*) AS n FROM lr UNION ALL SELECT 'files', count(*) FROM kf UNION ALL SELECT 'commits', count(*) FROM kc UNION ALL SELECT 'directories', count(*) FROM directories WHERE repo_id IN (SELECT repo_id FROM lr)
 UNION ALL SELECT 'cost_events', count(*) FROM cost_events WHERE repo_id IN (SELECT repo_id FROM lr) UNION ALL SELECT 'file_commits', count(*) FROM file_commits WHERE file_id IN (SELECT file_id FROM kf) AND commit_id IN (SELECT commit_id FROM kc)
 UNION ALL SELECT 'file_imports', count(*) FROM file_imports WHERE source_file_id IN (SELECT file_id FROM kf)
 UNION ALL SELECT 'cross_repo_edges', count(*) FROM cross_repo_edges WHERE source_repo IN (SELECT repo_id FROM lr) AND target_repo IN (SELECT repo_id FROM lr) AND source_file IN (SELECT file_id FROM kf)""")
def _(v):
    out = None
    for name, rows in b.without_orphans(*_tables(v)).items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("references_by_repo", """WITH one AS (SELECT file_id, max(score) AS score FROM bm25 JOIN files USING (file_id) WHERE skeleton ILIKE '%the%' GROUP BY file_id), top AS (SELECT file_id, score FROM one ORDER BY round(score, 6) DESC, file_id LIMIT 20),
 h AS (SELECT content_hash, max(score) AS score FROM top JOIN files USING (file_id) GROUP BY content_hash),
 m AS (SELECT 'definition' AS kind, file_id, score FROM top UNION ALL SELECT 'same_content', file_id, h.score FROM files JOIN h USING (content_hash) WHERE file_id NOT IN (SELECT file_id FROM top)
   UNION ALL SELECT DISTINCT 'consumer', source_file_id, 0.5::DOUBLE FROM file_imports WHERE resolved_file_id IN (SELECT file_id FROM top)
   UNION ALL SELECT DISTINCT 'cross_repo', source_file, 0.4::DOUBLE FROM cross_repo_edges WHERE imported_module ILIKE '%mod\\_1%' ESCAPE '\\')
 SELECT r.name AS repo_name, count(*) AS n, round(max(m.score), 6) AS best, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM m JOIN files USING (file_id) JOIN repos r USING (repo_id) GROUP BY r.name""")
def _(v):
    scored = s.bm25_scores(v.files, v.queries).groupBy("file_id").agg(F.max("score").alias("score"))
    defs = scored.join(v.files.filter(F.col("skeleton").ilike("%the%")).select("file_id"), "file_id", "left_semi")
    return b.matches_by_repo(g.symbol_references(defs, v.files, v.file_imports, v.cross_repo_edges, "mod_1"), v.files, v.repos)


@query("migration_rows", "SELECT repo_id, file_path, content_hash, file_type, sha256(skeleton) AS skeleton_hash, (row_number() OVER (PARTITION BY repo_id ORDER BY file_path) - 1) // 50 AS batch FROM files")
def _(v):
    return b.migration_rows(v.files, 50).select("repo_id", "file_path", "content_hash", "file_type", F.sha2("skeleton", 256).alias("skeleton_hash"), "batch")


@query("resume_upload", """WITH m AS (SELECT repo_id, file_path, (row_number() OVER (PARTITION BY repo_id ORDER BY file_path) - 1) // 10 AS batch FROM files), a AS (SELECT DISTINCT repo_id, batch FROM m JOIN files USING (repo_id, file_path) WHERE file_id IN (SELECT file_id FROM expected))
 SELECT repo_id, file_path, batch FROM m WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.repo_id = m.repo_id AND a.batch = m.batch)""")
def _(v):
    rows = b.migration_rows(v.files, 10).select("repo_id", "file_path", "batch")
    done = v.files.join(v.expected, "file_id", "left_semi").select("repo_id", "file_path")
    return b.pending(rows, rows.join(done, ["repo_id", "file_path"], "left_semi"))


def _blob(c):
    """The model that a content was embedded with, by its first digit, in two sizes."""
    digit = F.substring(c, 1, 1)
    return [F.lit("local").alias("provider"), F.when(digit < "8", "small").otherwise("large").alias("model"), F.when(digit < "8", 64).otherwise(128).alias("dimensions")]


_KEY = "'local' AS provider, CASE WHEN substr(content_hash, 1, 1) < '8' THEN 'small' ELSE 'large' END AS model, CASE WHEN substr(content_hash, 1, 1) < '8' THEN 64 ELSE 128 END AS dimensions"


@query("embed_plan_by_model", f"""WITH w AS (SELECT file_id, content_hash, 'local' AS provider, CASE file_id % 2 WHEN 0 THEN 'small' ELSE 'large' END AS model, CASE file_id % 2 WHEN 0 THEN 64 ELSE 128 END AS dimensions FROM files),
 b AS (SELECT content_hash, vec_id, {_KEY} FROM blobs) SELECT file_id, b.vec_id IS NOT NULL AS cached, b.vec_id FROM w LEFT JOIN b USING (content_hash, provider, model, dimensions)""")
def _(v):
    even = F.col("file_id") % 2 == 0
    files = v.files.select("file_id", "content_hash", F.lit("local").alias("provider"), F.when(even, "small").otherwise("large").alias("model"), F.when(even, 64).otherwise(128).alias("dimensions"))
    return embed_plan(files, v.blobs.select("content_hash", "vec_id", *_blob(F.col("content_hash"))), st.BLOB)


_STORED = f"""old AS (SELECT * FROM files WHERE file_id % 3 > 0),
 batch AS (SELECT repo_id, file_path, file_id AS was, dir_path, CASE WHEN file_id % 3 = 0 THEN content_hash ELSE sha256(content_hash) END AS content_hash FROM files WHERE file_id % 3 = 0 OR file_id % 5 = 0),
 fresh AS (SELECT repo_id, file_path, (SELECT max(file_id) FROM old) + row_number() OVER (ORDER BY repo_id, file_path) AS file_id FROM batch WHERE (repo_id, file_path) NOT IN (SELECT (repo_id, file_path) FROM old)),
 after AS (SELECT o.repo_id, o.file_path, o.file_id, coalesce(b.content_hash, o.content_hash) AS content_hash, b.was, o.dir_path FROM old o LEFT JOIN batch b USING (repo_id, file_path)
   UNION ALL SELECT repo_id, file_path, f.file_id, content_hash, was, dir_path FROM fresh f JOIN batch USING (repo_id, file_path))"""


def stored(v):
    """A store of two thirds of the files after a batch of the others and of changed ones, whose texts import a neighbour."""
    old = v.files.filter("file_id % 3 > 0")
    key = _blob(F.col("content_hash"))
    blobs = old.groupBy("content_hash").agg(F.min_by("skeleton", "file_id").alias("skeleton")).select("content_hash", *key, "skeleton", F.array().cast("array<double>").alias("vec"))
    imports = v.file_imports.join(old.select(F.col("file_id").alias("source_file_id")), "source_file_id").join(old.select(F.col("file_id").alias("resolved_file_id")), "resolved_file_id", "left_semi")
    before = st.Store(
        old.select("file_id", "repo_id", "file_path", "file_type", "content_hash", "skeleton"), blobs, old.select("repo_id", "file_path", "content_hash", *key),
        imports.select("source_file_id", "imported_module", "resolved_file_id", F.lit("typescript").alias("language")),
    )
    new = v.files.filter("file_id % 3 = 0 or file_id % 5 = 0").withColumn("content_hash", F.when(F.col("file_id") % 3 == 0, F.col("content_hash")).otherwise(F.sha2("content_hash", 256)))
    batch = new.select("repo_id", "file_path", "file_type", "skeleton", "content_hash", *key, F.array(F.lit(1.0)).alias("vec"))
    module = F.concat(F.lit("./doc_"), (F.col("file_id") + 10).cast("string"))
    edges = new.select("repo_id", F.col("file_path").alias("source_path"), module.alias("imported_module"), F.lit("typescript").alias("language"))
    return st.store_files(before, batch, edges)


@query("store_batch", f"""WITH {_STORED},
 imp AS (SELECT a.file_id AS source_file_id, t.file_id AS resolved_file_id FROM after a LEFT JOIN after t ON t.repo_id = a.repo_id AND t.file_path = a.dir_path || '/doc_' || (a.was + 10) || '.ts' WHERE a.was IS NOT NULL
   UNION ALL SELECT i.source_file_id, i.resolved_file_id FROM file_imports i JOIN old s ON s.file_id = i.source_file_id JOIN old t ON t.file_id = i.resolved_file_id WHERE i.source_file_id NOT IN (SELECT file_id FROM after WHERE was IS NOT NULL))
 SELECT a.repo_id, a.file_path, a.file_id, a.content_hash, count(source_file_id) AS n_imports, count(resolved_file_id) AS n_resolved FROM after a LEFT JOIN imp ON imp.source_file_id = a.file_id GROUP BY ALL""")
def _(v):
    s = stored(v)
    n = s.file_imports.groupBy(F.col("source_file_id").alias("file_id")).agg(F.count("*").alias("n_imports"), F.count("resolved_file_id").alias("n_resolved"))
    rows = s.repo_files.join(s.file_blobs.select(*st.BLOB), st.BLOB).join(s.files.select("repo_id", "file_path", "file_id"), ["repo_id", "file_path"]).join(n, "file_id", "left")
    return rows.select("repo_id", "file_path", "file_id", "content_hash", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_imports", "n_resolved")])


@query("store_leaves_nothing_dangling", "SELECT kind, 0::BIGINT AS n FROM (VALUES ('repo_files without file'), ('repo_files without blob'), ('imports without source'), ('imports without target')) t(kind)")
def _(v):
    return st.dangling(stored(v))


@query("package_warm_write", f"""WITH k AS (SELECT f.repo_id, f.file_id, f.content_hash, f.file_id IN (SELECT file_id FROM expected) AND substr(content_hash, 1, 1) < '8' AS own, length(skeleton) % 5 <> 0 AS made FROM files f WHERE file_type <> '.md' AND strlen(skeleton) <= 20000),
 b AS (SELECT DISTINCT content_hash FROM k WHERE own),
 c AS (SELECT repo_id, count(*) FILTER (WHERE b.content_hash IS NOT NULL) AS reused, count(*) FILTER (WHERE b.content_hash IS NULL AND made) AS embedded, count(*) FILTER (WHERE b.content_hash IS NULL AND NOT made) AS failed FROM k LEFT JOIN b USING (content_hash) WHERE repo_id % 2 > 0 GROUP BY repo_id)
 SELECT r.repo_id AS package, r.repo_id % 2 = 0 AS hit, coalesce(reused, 0) AS reused, coalesce(embedded, 0) AS embedded, coalesce(failed, 0) AS failed FROM repos r LEFT JOIN c USING (repo_id)""")
def _(v):
    entries = v.files.select(F.col("repo_id").alias("package"), F.col("file_path").alias("relpath"), "content_hash", "file_type", F.octet_length("skeleton").alias("size"))
    key = [F.lit("local").alias("provider"), F.lit("small").alias("model"), F.lit(64).alias("dimensions")]
    other = [F.lit("local").alias("provider"), F.lit("large").alias("model"), F.lit(64).alias("dimensions")]
    trees = tree_hash(entries, ["package"])
    known = trees.filter("package % 2 = 0").select("tree_hash", *key).unionByName(trees.select("tree_hash", *other))  # another model's don't count
    held = v.files.filter("file_type <> '.md' and octet_length(skeleton) <= 20000").join(v.expected.select("file_id").distinct(), "file_id", "left_semi").select("content_hash", *_blob(F.col("content_hash"))).distinct()
    fresh = v.files.groupBy("content_hash").agg(F.when(F.length(F.min("skeleton")) % 5 != 0, F.array(F.lit(1.0))).otherwise(F.array().cast("array<double>")).alias("vec"))
    return st.warm_packages(entries, known, held, fresh, ("local", "small", 64), [".ts", ".py", ".go", ".java"], 20_000).stats

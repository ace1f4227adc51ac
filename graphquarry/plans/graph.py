"""Queries of the import graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphquarry.operators import graph as g
from graphquarry.operators import search as s

from .registry import query

DEPTH = 10  # of a walk over imports, by default


@query("importers", "SELECT i.resolved_file_id, i.source_file_id, f.file_path, i.imported_module FROM file_imports i JOIN files f ON i.source_file_id = f.file_id WHERE i.resolved_file_id IN (SELECT file_id FROM expected)")
def _(v):
    return g.importers(v.file_imports, v.files, v.expected.select("file_id").distinct())


@query("dependencies", "SELECT i.source_file_id, i.imported_module, i.resolved_file_id, f.file_path FROM file_imports i LEFT JOIN files f ON i.resolved_file_id = f.file_id WHERE i.source_file_id IN (SELECT file_id FROM expected)")
def _(v):
    return g.dependencies(v.file_imports, v.files, v.expected.select("file_id").distinct())


_EDGES = "e AS (SELECT DISTINCT source_file_id AS a, resolved_file_id AS b FROM file_imports WHERE resolved_file_id IS NOT NULL)"


@query("trace_import_chain", f"""WITH RECURSIVE {_EDGES}, w AS (SELECT query_id AS seed, query_id AS file_id, 0 AS depth FROM queries UNION SELECT seed, b, depth + 1 FROM w JOIN e ON file_id = a WHERE depth < 10)
 SELECT seed, file_id, min(depth)::BIGINT AS depth FROM w WHERE file_id <> seed GROUP BY seed, file_id""")
def _(v):
    return g.trace_imports(v.file_imports, v.queries.select(F.col("query_id").alias("file_id")), DEPTH)


@query("trace_import_chain_inward", f"""WITH RECURSIVE {_EDGES}, w AS (SELECT query_id AS seed, query_id AS file_id, 0 AS depth FROM queries UNION SELECT seed, a, depth + 1 FROM w JOIN e ON file_id = b WHERE depth < 10)
 SELECT seed, file_id, min(depth)::BIGINT AS depth FROM w WHERE file_id <> seed GROUP BY seed, file_id""")
def _(v):
    return g.trace_imports(v.file_imports, v.queries.select(F.col("query_id").alias("file_id")), DEPTH, inward=True)


@query("trace_import_chain_all_depths", f"""WITH RECURSIVE {_EDGES}, w AS (SELECT query_id AS seed, query_id AS file_id, 0 AS depth FROM queries UNION SELECT seed, b, depth + 1 FROM w JOIN e ON file_id = a WHERE depth < 10)
 SELECT seed, file_id, depth::BIGINT AS depth FROM w WHERE depth > 0""")
def _(v):
    return g.trace_imports(v.file_imports, v.queries.select(F.col("query_id").alias("file_id")), DEPTH, all_depths=True)


_SCOPED = "sc AS (SELECT file_id FROM files WHERE repo_id % 3 > 0), " + _EDGES


@query("trace_import_chain_scoped", f"""WITH RECURSIVE {_SCOPED}, w AS (SELECT query_id AS seed, query_id AS file_id, 0 AS depth FROM queries UNION SELECT seed, b, depth + 1 FROM w JOIN e ON file_id = a JOIN sc ON sc.file_id = b WHERE depth < 10)
 SELECT seed, file_id, min(depth)::BIGINT AS depth FROM w WHERE file_id <> seed GROUP BY seed, file_id""")
def _(v):
    scope = v.files.filter("repo_id % 3 > 0").select("file_id")
    return g.trace_imports(v.file_imports, v.queries.select(F.col("query_id").alias("file_id")), DEPTH, scope=scope)


@query("trace_import_chain_scoped_inward", f"""WITH RECURSIVE {_SCOPED}, w AS (SELECT query_id AS seed, query_id AS file_id, 0 AS depth FROM queries UNION SELECT seed, a, depth + 1 FROM w JOIN e ON file_id = b JOIN sc ON sc.file_id = a WHERE depth < 10)
 SELECT seed, file_id, depth::BIGINT AS depth FROM w WHERE depth > 0""")
def _(v):
    scope = v.files.filter("repo_id % 3 > 0").select("file_id")
    return g.trace_imports(v.file_imports, v.queries.select(F.col("query_id").alias("file_id")), DEPTH, inward=True, all_depths=True, scope=scope)


@query("trace_conversation_turns", """WITH RECURSIVE w AS (SELECT conv_id, min(turn) AS turn, 0 AS depth FROM conversations GROUP BY conv_id UNION SELECT c.conv_id, c.turn, depth + 1 FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn + 1 WHERE depth < 10)
 SELECT conv_id, max(depth)::BIGINT AS depth FROM w WHERE depth > 0 GROUP BY conv_id""")
def _(v):
    c = v.table("conversations").select("conv_id", "turn").distinct()
    key = lambda t: F.col("conv_id") * 100_000 + t
    edges = c.select(key(F.col("turn")).alias("source_file_id"), key(F.col("turn") + 1).alias("resolved_file_id"))
    edges = edges.join(c.select(key(F.col("turn")).alias("resolved_file_id")), "resolved_file_id", "left_semi")
    seeds = c.groupBy("conv_id").agg(F.min("turn").alias("turn")).select(key(F.col("turn")).alias("file_id"))
    return g.trace_imports(edges, seeds, DEPTH).groupBy(F.expr("seed div 100000").alias("conv_id")).agg(F.max("depth").alias("depth"))


@query("cross_repo_edges", "SELECT e.source_repo, e.target_repo, s.file_path AS source_path, t.file_path AS target_path, e.imported_module FROM cross_repo_edges e JOIN files s ON e.source_file = s.file_id JOIN files t ON e.target_file = t.file_id")
def _(v):
    f = v.files.select("file_id", "file_path")
    e = v.cross_repo_edges.join(f.select(F.col("file_id").alias("source_file"), F.col("file_path").alias("source_path")), "source_file")
    e = e.join(f.select(F.col("file_id").alias("target_file"), F.col("file_path").alias("target_path")), "target_file")
    return e.select("source_repo", "target_repo", "source_path", "target_path", "imported_module")


@query("repo_graph", "SELECT source_repo, target_repo, count(*) AS n_edges FROM cross_repo_edges GROUP BY ALL")
def _(v):
    return g.repo_graph(v.cross_repo_edges)


@query("repo_graph_dot", "SELECT string_agg('  \"' || source_repo || '\" -> \"' || target_repo || '\" [label=' || n || '];', chr(10) ORDER BY source_repo, target_repo) AS dot FROM (SELECT source_repo, target_repo, count(*) AS n FROM cross_repo_edges GROUP BY ALL)")
def _(v):
    line = F.concat(F.lit('  "'), F.col("source_repo").cast("string"), F.lit('" -> "'), F.col("target_repo").cast("string"), F.lit('" [label='), F.col("n_edges").cast("string"), F.lit("];"))
    e = g.repo_graph(v.cross_repo_edges).agg(F.array_sort(F.collect_list(F.struct("source_repo", "target_repo", line.alias("line")))).alias("a"))  # pairs of repositories, not files
    return e.select(F.array_join(F.transform("a", lambda x: x["line"]), "\n").alias("dot"))


@query("repo_neighbours", """WITH p AS (SELECT DISTINCT source_repo AS s, target_repo AS t FROM cross_repo_edges), a AS (SELECT s AS repo_id, string_agg(t, ',' ORDER BY t) AS depends_on FROM p GROUP BY s), b AS (SELECT t AS repo_id, string_agg(s, ',' ORDER BY s) AS used_by FROM p GROUP BY t)
 SELECT repo_id, coalesce(depends_on, '') AS depends_on, coalesce(used_by, '') AS used_by FROM a FULL JOIN b USING (repo_id)""")
def _(v):
    return g.repo_neighbours(v.cross_repo_edges)


_DECLARED = "CASE file_id % 4 WHEN 0 THEN skeleton || chr(10) || 'class A' || file_id || ' extends my_base' WHEN 1 THEN skeleton || chr(10) || 'mybase extends nothing' ELSE skeleton END"


def declared(v):
    """The files, some with a line that extends a class, some with one that is close to it."""
    k, d = F.col("file_id") % 4, F.col("file_id").cast("string")
    more = F.when(k == 0, F.concat(F.lit("\nclass A"), d, F.lit(" extends my_base"))).when(k == 1, F.lit("\nmybase extends nothing")).otherwise(F.lit(""))
    return v.files.withColumn("skeleton", F.concat("skeleton", more))


@query("implementors", f"SELECT repo_id, file_path, file_id FROM (SELECT repo_id, file_path, file_id, {_DECLARED} AS s FROM files) WHERE s LIKE '%my\\_base%' ESCAPE '\\' AND (s LIKE '%implements%' OR s LIKE '%extends%' OR s LIKE '%: %' OR s LIKE '%conform%') ORDER BY repo_id, file_path LIMIT 100")
def _(v):
    return g.implementors(declared(v), "my_base")


@query("callers", "SELECT DISTINCT repo_id, file_path, file_id FROM files JOIN file_imports ON file_id = source_file_id WHERE imported_module LIKE '%pkg\\_1%' ESCAPE '\\' ORDER BY repo_id, file_path LIMIT 100")
def _(v):
    return g.callers(v.file_imports, v.files, "pkg_1")


@query("symbol_references", """WITH one AS (SELECT file_id, max(score) AS score FROM bm25 JOIN files USING (file_id) WHERE skeleton ILIKE '%the%' GROUP BY file_id), top AS (SELECT file_id, score FROM one ORDER BY round(score, 6) DESC, file_id LIMIT 20),
 h AS (SELECT content_hash, max(score) AS score FROM top JOIN files USING (file_id) GROUP BY content_hash)
 SELECT 'definition' AS kind, file_id, round(score, 6) AS score FROM top
 UNION ALL SELECT 'same_content', file_id, round(h.score, 6) FROM files JOIN h USING (content_hash) WHERE file_id NOT IN (SELECT file_id FROM top)
 UNION ALL SELECT DISTINCT 'consumer', source_file_id, 0.5::DOUBLE FROM file_imports WHERE resolved_file_id IN (SELECT file_id FROM top)
 UNION ALL SELECT DISTINCT 'cross_repo', source_file, 0.4::DOUBLE FROM cross_repo_edges WHERE imported_module ILIKE '%mod\\_1%' ESCAPE '\\'""")
def _(v):
    scored = s.bm25_scores(v.files, v.queries).groupBy("file_id").agg(F.max("score").alias("score"))
    defs = scored.join(v.files.filter(F.col("skeleton").ilike("%the%")).select("file_id"), "file_id", "left_semi")
    return g.symbol_references(defs, v.files, v.file_imports, v.cross_repo_edges, "mod_1").withColumn("score", F.round("score", 6))


_SOURCE = """concat('import { a } from \"./doc_', doc_id + 5, '\";', chr(10), 'import \"side\";', chr(10), 'const x = require(\"../d', doc_id % 7, '/doc_', doc_id + 10, '\");')"""


def _ts(v):
    d = F.col("doc_id")
    code = F.concat(F.lit('import { a } from "./doc_'), (d + 5).cast("string"), F.lit('";\nimport "side";\nconst x = require("../d'), (d % 7).cast("string"), F.lit("/doc_"), (d + 10).cast("string"), F.lit('");'))
    return v.table("documents").select(d.alias("file_id"), F.lit(".ts").alias("file_type"), code.alias("content"), "lang")


@query("extract_imports_typescript", f"SELECT DISTINCT doc_id AS file_id, unnest(list_concat(list_concat(regexp_extract_all(c, 'import\\s+(?:type\\s+)?(?:[\\s\\S]*?)\\s+from\\s+[\"'']([^\"'']+)[\"'']', 1), regexp_extract_all(c, 'import\\s+[\"'']([^\"'']+)[\"'']', 1)), regexp_extract_all(c, 'require\\s*\\(\\s*[\"'']([^\"'']+)[\"'']\\s*\\)', 1))) AS imported_module, 'typescript' AS language FROM (SELECT doc_id, {_SOURCE} AS c FROM documents)")
def _(v):
    return g.extract_imports(_ts(v))


@query("resolve_imports_typescript", f"""WITH p AS (SELECT lang || '/d' || (doc_id % 10) AS folder, lang || '/d' || (doc_id % 10) || '/doc_' || doc_id || '.ts' AS path, doc_id, lang FROM documents),
 m AS (SELECT path, './doc_' || (doc_id + 5) AS m, folder || '/doc_' || (doc_id + 5) || '.ts' AS t FROM p UNION ALL SELECT path, '../d' || (doc_id % 7) || '/doc_' || (doc_id + 10), lang || '/d' || (doc_id % 7) || '/doc_' || (doc_id + 10) || '.ts' FROM p UNION ALL SELECT path, 'side', NULL FROM p)
 SELECT m.path AS source_path, m.m AS imported_module, q.path AS target_path FROM m LEFT JOIN p q ON m.t = q.path""")
def _(v):
    path = F.concat(F.col("lang"), F.lit("/d"), (F.col("file_id") % 10).cast("string"), F.lit("/doc_"), F.col("file_id").cast("string"), F.lit(".ts"))
    files = _ts(v).select("file_id", path.alias("file_path"), F.lit(1).alias("repo_id"))
    edges = g.extract_imports(_ts(v)).join(files, "file_id").select("repo_id", F.col("file_path").alias("source_path"), "imported_module", "language")
    return g.resolve_imports(edges, files).select("source_path", "imported_module", "target_path")


@query("discover_cross_repo_edges", """WITH u AS (SELECT s.repo_id, i.source_file_id AS source_file, 'pkg' || (i.source_file_id % 20 + 1) || CASE WHEN i.source_file_id % 2 = 0 THEN '/en/d1/doc_' || (i.source_file_id * 3 % (SELECT n FROM nf)) ELSE '' END AS imported_module, i.source_file_id % 20 + 1 AS t, CASE WHEN i.source_file_id % 2 = 0 THEN 'en/d1/doc_' || (i.source_file_id * 3 % (SELECT n FROM nf)) || '.ts' END AS path
   FROM file_imports i JOIN files s ON i.source_file_id = s.file_id WHERE i.resolved_file_id IS NULL),
 e AS (SELECT repo_id, min(file_path) AS entry FROM files GROUP BY repo_id)
 SELECT u.repo_id AS source_repo, u.t AS target_repo, u.source_file, u.imported_module, CASE WHEN u.path IS NULL THEN e.entry ELSE f.file_path END AS target_file
 FROM u JOIN e ON u.t = e.repo_id LEFT JOIN files f ON f.repo_id = u.t AND f.file_path = u.path WHERE u.repo_id <> u.t""")
def _(v):
    i = v.file_imports.filter("resolved_file_id is null").join(v.files.select(F.col("file_id").alias("source_file_id"), "repo_id"), "source_file_id")
    n, d = v.n_files, F.col("source_file_id")
    tail = F.when(d % 2 == 0, F.concat(F.lit("/en/d1/doc_"), (d * 3 % n).cast("string"))).otherwise(F.lit(""))
    u = i.select("repo_id", d.alias("source_file"), F.concat(F.lit("pkg"), (d % 20 + 1).cast("string"), tail).alias("imported_module"))
    packages = v.files.groupBy("repo_id").agg(F.min("file_path").alias("entry")).withColumn("package", F.concat(F.lit("pkg"), F.col("repo_id").cast("string")))
    return g.cross_repo_edges(u, packages, v.files.select("repo_id", "file_path"))


@query("import_refresh", "SELECT source_file_id, imported_module FROM file_imports WHERE source_file_id NOT IN (SELECT file_id FROM expected) UNION ALL SELECT DISTINCT file_id, 'fresh_' || file_id FROM expected")
def _(v):
    from graphquarry.operators.etl import replace_by_key

    fresh = v.expected.select(F.col("file_id").alias("source_file_id")).distinct().withColumn("imported_module", F.concat(F.lit("fresh_"), F.col("source_file_id").cast("string")))
    return replace_by_key(v.file_imports.select("source_file_id", "imported_module"), fresh, ["source_file_id"])


@query("repo_graph_mermaid", "SELECT 'graph LR' || chr(10) || string_agg('  r' || source_repo || ' -->|' || n || '| r' || target_repo, chr(10) ORDER BY source_repo, target_repo) AS mermaid FROM (SELECT source_repo, target_repo, count(*) AS n FROM cross_repo_edges GROUP BY ALL)")
def _(v):
    line = F.concat(F.lit("  r"), F.col("source_repo").cast("string"), F.lit(" -->|"), F.col("n_edges").cast("string"), F.lit("| r"), F.col("target_repo").cast("string"))
    e = g.repo_graph(v.cross_repo_edges).agg(F.array_sort(F.collect_list(F.struct("source_repo", "target_repo", line.alias("line")))).alias("a"))  # pairs of repositories, not files
    return e.select(F.concat(F.lit("graph LR\n"), F.array_join(F.transform("a", lambda x: x["line"]), "\n")).alias("mermaid"))


@query("results_with_repo_neighbours", """WITH p AS (SELECT DISTINCT source_repo AS s, target_repo AS t FROM cross_repo_edges), a AS (SELECT s AS repo_id, string_agg(t, ',' ORDER BY t) AS depends_on FROM p GROUP BY s)
 SELECT f.file_id, f.repo_id, coalesce(a.depends_on, '') AS depends_on FROM files f LEFT JOIN a USING (repo_id) WHERE f.file_id IN (SELECT file_id FROM expected)""")
def _(v):
    near = g.repo_neighbours(v.cross_repo_edges).select("repo_id", "depends_on")
    hits = v.files.join(v.expected, "file_id", "left_semi").select("file_id", "repo_id")
    return hits.join(near, "repo_id", "left").select("file_id", "repo_id", F.coalesce("depends_on", F.lit("")).alias("depends_on"))

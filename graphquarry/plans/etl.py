"""Queries of index maintenance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphquarry.functions import text as tx
from graphquarry.operators import etl as t

from .registry import query


@query("recency", "SELECT file_id, commit_id, recency FROM file_commits")
def _(v):
    links = v.table("lineitem").select((F.col("l_partkey") % v.n_files).alias("file_id"), F.col("l_orderkey").alias("commit_id"))
    return t.recency(links.join(v.commits.select("commit_id", "authored_at"), "commit_id"))


@query("recency_shift", "SELECT file_id, commit_id, recency + (file_id IN (SELECT file_id FROM expected))::INT AS recency FROM file_commits UNION ALL SELECT DISTINCT file_id, -1, 1 FROM expected")
def _(v):
    new = v.expected.select("file_id").distinct().withColumn("commit_id", F.lit(-1).cast("long"))
    return t.shift_recency(v.file_commits, new)


@query("stale_paths", "SELECT file_id, file_path FROM files WHERE file_path NOT IN (SELECT file_path FROM files WHERE file_id IN (SELECT file_id FROM expected))")
def _(v):
    disk = v.files.join(v.expected, "file_id", "left_semi").select("file_path")
    return t.stale(v.files.select("file_id", "file_path"), disk, ["file_path"]).select("file_id", "file_path")


@query("prune_imports", "SELECT source_file_id, CASE WHEN resolved_file_id IN (SELECT file_id FROM expected) THEN resolved_file_id END AS resolved_file_id, imported_module FROM file_imports WHERE source_file_id IN (SELECT file_id FROM expected)")
def _(v):
    disk = v.files.join(v.expected, "file_id", "left_semi").select("file_path")
    return t.prune(v.files, disk, v.file_imports, v.file_commits)[1]


@query("prune_commit_links", "SELECT file_id, commit_id, recency FROM file_commits WHERE file_id IN (SELECT file_id FROM expected)")
def _(v):
    disk = v.files.join(v.expected, "file_id", "left_semi").select("file_path")
    return t.prune(v.files, disk, v.file_imports, v.file_commits)[2]


@query("merge_replace", "SELECT repo_id, file_path, CASE WHEN file_id IN (SELECT file_id FROM expected) THEN 'new' ELSE content_hash END AS content_hash FROM files")
def _(v):
    old = v.files.select("repo_id", "file_path", "content_hash")
    new = v.files.join(v.expected, "file_id", "left_semi").select("repo_id", "file_path", F.lit("new").alias("content_hash"))
    return t.merge(old, new, ["repo_id", "file_path"])


@query("merge_keep", "SELECT content_hash, blob_id FROM blobs UNION ALL SELECT 'x' || query_id, query_id FROM queries")
def _(v):
    old = v.blobs.select("content_hash", "blob_id")
    new = v.queries.select(F.concat(F.lit("x"), F.col("query_id").cast("string")).alias("content_hash"), F.col("query_id").alias("blob_id"))
    again = v.blobs.select("content_hash", F.lit(-5).cast("long").alias("blob_id"))
    return t.merge(old, new.unionByName(again), ["content_hash"], replace=False)


@query("upsert_is_idempotent", "SELECT content_hash, blob_id FROM blobs")
def _(v):
    b = v.blobs.select("content_hash", "blob_id")
    return t.merge(t.merge(b, b, ["content_hash"]), b, ["content_hash"])


@query("tree_hash", "SELECT repo_id, sha256(string_agg(file_path || chr(0) || content_hash || chr(10), '' ORDER BY file_path)) AS tree_hash FROM files GROUP BY repo_id")
def _(v):
    return t.tree_hash(v.files.select("repo_id", F.col("file_path").alias("relpath"), "content_hash"), ["repo_id"])


@query("children_hash", "SELECT repo_id, dir_path, sha256(string_agg(content_hash, chr(10) ORDER BY content_hash)) AS children_hash FROM files GROUP BY repo_id, dir_path")
def _(v):
    return t.children_hash(v.files, ["repo_id", "dir_path"], "content_hash")


@query("directory_hashes", """WITH a AS (SELECT repo_id, dir_path, sha256(string_agg('file:' || content_hash, chr(10) ORDER BY 'file:' || content_hash)) AS h FROM files GROUP BY ALL),
 b AS (SELECT repo_id, string_split(dir_path, '/')[1] AS dir_path, sha256(string_agg('dir:' || h, chr(10) ORDER BY 'dir:' || h)) AS h FROM a GROUP BY ALL),
 c AS (SELECT repo_id, '.' AS dir_path, sha256(string_agg('dir:' || h, chr(10) ORDER BY 'dir:' || h)) AS h FROM b GROUP BY ALL)
 SELECT repo_id, dir_path, 2 AS depth, h AS children_hash FROM a UNION ALL SELECT repo_id, dir_path, 1, h FROM b UNION ALL SELECT repo_id, dir_path, 0, h FROM c""")
def _(v):
    return t.directory_hashes(v.files)


@query("concat_skeletons", "SELECT repo_id, dir_path, sha256(string_agg(skeleton, chr(10) || chr(10) ORDER BY file_path)) AS hash FROM files GROUP BY ALL")
def _(v):
    return v.files.groupBy("repo_id", "dir_path").agg(F.sha2(t.ordered_join(F.col("skeleton"), F.col("file_path"), "\n\n"), 256).alias("hash"))


@query("files_by_folder", "SELECT repo_id, dir_path, string_agg(file_path, ', ' ORDER BY file_path) AS names FROM files GROUP BY ALL")
def _(v):
    return v.files.groupBy("repo_id", "dir_path").agg(F.array_join(F.array_sort(F.collect_list("file_path")), ", ").alias("names"))


@query("affected_folders", "WITH c AS (SELECT repo_id, dir_path FROM files WHERE file_id IN (SELECT file_id FROM expected)) SELECT repo_id, dir_path FROM c UNION SELECT repo_id, string_split(dir_path, '/')[1] FROM c UNION SELECT repo_id, '.' FROM c")
def _(v):
    return t.affected_folders(v.files.join(v.expected, "file_id", "left_semi"))


@query("depth_sorted_folders", "SELECT repo_id, dir_path, length(dir_path) - length(replace(dir_path, '/', '')) + 1 AS depth FROM directories")
def _(v):
    return v.directories.select("repo_id", "dir_path", F.size(F.split("dir_path", "/")).cast("long").alias("depth")).orderBy(F.desc("depth"), "dir_path")


@query("package_warm", """WITH p AS (SELECT repo_id, sha256(string_agg(file_path || chr(0) || content_hash || chr(10), '' ORDER BY file_path)) AS tree_hash FROM files GROUP BY repo_id)
 SELECT repo_id AS package, tree_hash, repo_id % 2 = 0 AS hit FROM p""")
def _(v):
    p = t.tree_hash(v.files.select("repo_id", F.col("file_path").alias("relpath"), "content_hash"), ["repo_id"])
    return t.package_warm(p.withColumnRenamed("repo_id", "package"), p.filter("repo_id % 2 = 0"))


_PAGES = "SELECT sha256(html) AS content_hash, -1 - page_id AS blob_id FROM pages"


def _stores(v):
    """Blobs of files and of pages, and the pages that packages hold: those that queries are named after."""
    pages = v.table("pages").select(F.sha2("html", 256).alias("content_hash"), (-1 - F.col("page_id")).alias("blob_id"))
    held = v.table("pages").join(v.queries.select(F.col("query_id").alias("page_id")), "page_id", "left_semi").select(F.sha2("html", 256).alias("content_hash"))
    return v.blobs.select("content_hash", "blob_id").unionByName(pages), held


@query("orphan_blobs", f"SELECT content_hash, blob_id FROM (SELECT content_hash, blob_id FROM blobs UNION ALL {_PAGES}) WHERE content_hash NOT IN (SELECT content_hash FROM files) AND content_hash NOT IN (SELECT sha256(html) FROM pages WHERE page_id IN (SELECT query_id FROM queries))")
def _(v):
    blobs, packages = _stores(v)
    return t.orphan_blobs(blobs, v.repo_files, packages).select("content_hash", "blob_id")


@query("live_hashes", "SELECT content_hash FROM files UNION SELECT sha256(html) FROM pages WHERE page_id IN (SELECT query_id FROM queries)")
def _(v):
    return t.live_hashes(v.repo_files, _stores(v)[1])


@query("orphan_imports", "SELECT source_file_id, imported_module FROM file_imports WHERE resolved_file_id NOT IN (SELECT file_id FROM expected)")
def _(v):
    gone = v.file_imports.filter("resolved_file_id is not null").join(v.expected.select(F.col("file_id").alias("resolved_file_id")), "resolved_file_id", "left_anti")
    return gone.select("source_file_id", "imported_module")


@query("orphan_commits", "SELECT commit_id FROM commits WHERE commit_id NOT IN (SELECT commit_id FROM file_commits)")
def _(v):
    return v.commits.select("commit_id").join(v.file_commits, "commit_id", "left_anti")


@query("embed_plan", "SELECT file_id, blob_id IS NOT NULL AS cached, b.vec_id FROM files f LEFT JOIN (SELECT * FROM blobs WHERE blob_id IN (SELECT file_id FROM expected)) b USING (content_hash)")
def _(v):
    return t.embed_plan(v.files, v.blobs.join(v.expected.select(F.col("file_id").alias("blob_id")), "blob_id", "left_semi"))


@query("blob_scores_to_files", "SELECT f.file_id, q.query_id, round(m.sim, 6) AS sim FROM queries q JOIN sims m USING (query_id) JOIN blobs b ON b.vec_id = m.vec_id JOIN files f USING (content_hash)")
def _(v):
    from graphquarry.functions import vectors as vx

    good, asked = vx.good_vectors(v.table("embeddings"), 64), vx.ask(v.queries, v.table("embeddings"), 64)
    # each vector is scored once, and a blob takes the scores of its vector as one list to its files
    lists = vx.score_lists(v.blobs.select("vec_id").distinct().join(good, "vec_id"), asked, 64)
    scored = v.files.select("file_id", "content_hash").join(v.blobs.select("content_hash", "vec_id"), "content_hash").select("file_id", "vec_id").join(lists, "vec_id")
    return scored.select("file_id", F.explode("scores").alias("x")).select("file_id", "x.query_id", F.round("x.sim", 6).alias("sim"))


@query("legacy_ids", "SELECT r.repo_id, r.file_path, coalesce(l.file_id, -1 - r.file_id) AS file_id FROM files r LEFT JOIN (SELECT file_id, file_path FROM files WHERE file_id IN (SELECT file_id FROM expected)) l USING (file_path)")
def _(v):
    old = v.files.join(v.expected, "file_id", "left_semi").select(F.col("file_id").alias("old"), "file_path")
    return v.files.join(old, "file_path", "left").select("repo_id", "file_path", F.coalesce("old", -1 - F.col("file_id")).alias("file_id"))


@query("lru_evict", """WITH c AS (SELECT c_custkey AS name, length(c_name) AS size, c_acctbal AS last_access FROM customer), r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY last_access, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed, sum(size) OVER () AS total FROM c)
 SELECT name, size, last_access FROM r WHERE total - freed > 1000""")
def _(v):
    c = v.table("customer").select(F.col("c_custkey").alias("name"), F.length("c_name").cast("long").alias("size"), F.col("c_acctbal").alias("last_access"))
    return t.lru_evict(c, 1000)


@query("export_files", "SELECT file_id, repo_id, file_path, content_hash FROM files WHERE file_path NOT LIKE 'es/%'")
def _(v):
    return t.export(v.files, v.file_commits, F.col("file_path").startswith("es/"))[0].select("file_id", "repo_id", "file_path", "content_hash")


@query("export_commit_links", "SELECT file_id, commit_id, recency FROM file_commits WHERE file_id IN (SELECT file_id FROM files WHERE file_path NOT LIKE 'es/%')")
def _(v):
    return t.export(v.files, v.file_commits, F.col("file_path").startswith("es/"))[1]


@query("ingest_rows", """WITH x AS (SELECT * FROM files WHERE content_hash NOT IN (SELECT content_hash FROM files WHERE repo_id = 3)) SELECT repo_id, file_path, file_type, content_hash, strlen(skeleton) AS size_bytes, (row_number() OVER (PARTITION BY repo_id ORDER BY file_path) - 1) // 25 AS batch FROM x""")
def _(v):
    return t.ingest_rows(v.files, v.files.filter("repo_id = 3"), 25)


@query("markdown_sections", "SELECT doc_id, 1 AS pos, source || '/x' AS folder, md5(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS body FROM documents UNION ALL SELECT doc_id, 2, '.', md5('end') FROM documents")
def _(v):
    text = F.concat(F.lit("intro\n## "), "source", F.lit("/x/ [REVIEW]\n**Files:** a, b\n"), F.regexp_replace("text", "(?m)^## ", "# "), F.lit("\n## ./\nend\n## none"))
    return t.sections(v.table("documents").select("doc_id", text.alias("text"))).select("doc_id", "pos", "folder", F.md5("body").alias("body"))


@query("git_log_records", "SELECT o_orderkey AS log, 0 AS n, sha256(o_orderkey::VARCHAR) AS commit_hash, o_orderpriority AS message, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def _(v):
    text = F.concat_ws("\n", F.sha2(F.col("o_orderkey").cast("string"), 256), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"))
    lines = v.table("orders").select(F.col("o_orderkey").alias("log"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return t.git_log(lines)


@query("first_module_kept", "SELECT source_file_id, imported_module FROM (SELECT DISTINCT source_file_id, imported_module FROM file_imports)")
def _(v):
    return t.first_modules(v.file_imports)


@query("delete_file_nulls_imports", "SELECT source_file_id, CASE WHEN resolved_file_id IN (SELECT file_id FROM expected) THEN NULL ELSE resolved_file_id END AS resolved_file_id FROM file_imports WHERE source_file_id NOT IN (SELECT file_id FROM expected)")
def _(v):
    return t.delete_file(v.file_imports, v.expected.select("file_id").distinct()).select("source_file_id", "resolved_file_id")


@query("changed_since_files", "SELECT file_id FROM files WHERE indexed_at >= TIMESTAMP '2024-01-01 10:00:00'")
def _(v):
    return v.files.filter(F.col("indexed_at") >= F.lit(datetime(2024, 1, 1, 10))).select("file_id")


@query("paragraph_starts", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), p AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM l) SELECT doc_id, count(*) FILTER (WHERE trim(line) <> '' AND (prev IS NULL OR trim(prev) = '')) AS n_paragraphs FROM p GROUP BY doc_id")
def _(v):
    return t.paragraph_starts(v.table("documents")).groupBy("doc_id").agg(F.count_if("starts").alias("n_paragraphs"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS hash, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.ceil(F.length("text") / 4).cast("long").alias("tokens"))


@query("page_links", "SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_distinct FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id")
def _(v):
    p = v.table("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))
    return p.groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_distinct"))


def _manifests(v):
    """Documents as package folders of five kinds."""
    k, d = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    hash64 = F.translate(F.base64(F.unhex(F.sha2("text", 256))), "+/=", "-_")
    return v.table("documents").select(
        "doc_id", F.when(k == 0, F.concat(F.lit("node_modules/p"), d)).when(k == 1, F.concat(F.lit("registry/my-crate"), d, F.lit("-1.2.3"))).when(k == 2, F.concat(F.lit("site/pkg"), d, F.lit("-0.1.dist-info"))).when(k == 3, F.concat(F.lit("mod/tool"), d, F.lit("@v2"))).otherwise(F.concat(F.lit("other/x"), d)).alias("dir"),
        F.when(k == 0, F.concat(F.lit('{"name": "@s/p'), d, F.lit('", "version": "1.0", "x": []}'))).when(k == 4, F.lit('{"name": "broken"')).alias("package_json"),
        F.when(k == 1, F.concat(F.lit('{"files": {"src/lib.rs": "'), F.sha2("text", 256), F.lit('"}}'))).alias("cargo_checksum"),
        F.when(k == 2, F.concat(F.lit("pkg/a.py,sha256="), hash64, F.lit(",12\npkg/RECORD,,\n"))).alias("record"), F.when(k == 2, F.lit("Name: pkg")).alias("metadata"), F.when(k == 3, F.lit("module tool")).alias("go_mod"),
    )


@query("detect_packages", """SELECT * FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'node_modules/p' || doc_id WHEN 1 THEN 'registry/my-crate' || doc_id || '-1.2.3' WHEN 2 THEN 'site/pkg' || doc_id || '-0.1.dist-info' WHEN 3 THEN 'mod/tool' || doc_id || '@v2' END AS dir,
   CASE doc_id % 5 WHEN 0 THEN 'npm' WHEN 1 THEN 'cargo' WHEN 2 THEN 'python' WHEN 3 THEN 'go' END AS ecosystem, CASE doc_id % 5 WHEN 0 THEN '@s/p' || doc_id WHEN 1 THEN 'my-crate' || doc_id WHEN 2 THEN 'pkg' || doc_id ELSE 'tool' || doc_id END AS name,
   CASE doc_id % 5 WHEN 0 THEN '1.0' WHEN 1 THEN '1.2.3' WHEN 2 THEN '0.1' ELSE 'v2' END AS version FROM documents) WHERE dir IS NOT NULL""")
def _(v):
    from graphquarry.sources.scan import detect_packages

    return detect_packages(_manifests(v))


@query("manifest_files", "SELECT CASE doc_id % 5 WHEN 1 THEN 'registry/my-crate' || doc_id || '-1.2.3' ELSE 'site/pkg' || doc_id || '-0.1.dist-info' END AS dir, CASE doc_id % 5 WHEN 1 THEN 'src/lib.rs' ELSE 'pkg/a.py' END AS relpath, sha256(text) AS content_hash FROM documents WHERE doc_id % 5 IN (1, 2)")
def _(v):
    from graphquarry.sources.scan import manifest_files

    return manifest_files(_manifests(v))


@query("folder_outline", """WITH l AS (SELECT repo_id, dir_path, string_agg(regexp_extract(file_path, '([^/]*)$', 1), ', ' ORDER BY file_path) AS names FROM files GROUP BY ALL),
 s AS (SELECT d.repo_id, d.dir_path, CASE WHEN summary_vec IS NOT NULL THEN 'A summary of this folder in words.' END AS summary, names FROM directories d LEFT JOIN l USING (repo_id, dir_path))
 SELECT repo_id, md5('# AGENTS.md' || chr(10) || string_agg(chr(10) || '## ' || dir_path || '/' || CASE WHEN summary IS NULL THEN ' [REVIEW]' ELSE '' END || chr(10) || coalesce(chr(10) || summary, '') || coalesce(chr(10) || chr(10) || '**Files:** ' || names, ''), chr(10) ORDER BY dir_path) || chr(10)) AS hash FROM s GROUP BY repo_id""")
def _(v):
    from graphquarry.sources.scan import folder_outline

    d = v.directories.select("repo_id", "dir_path", F.when(F.col("summary_vec").isNotNull(), "A summary of this folder in words.").alias("summary"))
    return folder_outline(d, v.files).select("repo_id", F.md5("markdown").alias("hash"))


@query("repos_below", "SELECT 'w/' || source AS root, count(*) AS n_files FROM documents GROUP BY source")
def _(v):
    from graphquarry.sources.scan import repos_below

    d = v.table("documents")
    files = d.select(F.concat(F.lit("w/"), "source", F.lit("/a/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return repos_below(files.unionByName(d.select(F.concat(F.lit("w/"), "source", F.lit("/.git/HEAD")).alias("path")).distinct()))


@query("incremental_update", """SELECT repo_id, file_path, CASE WHEN file_id IN (SELECT file_id FROM expected) THEN 'changed' ELSE content_hash END AS content_hash FROM files WHERE repo_id <> 6""")
def _(v):
    """One update of an index: deleted paths go, changed files replace, the rest stays."""
    index = v.files.select("repo_id", "file_path", "content_hash")
    deleted = v.files.filter("repo_id = 6").select("repo_id", "file_path")
    changed = v.files.filter("repo_id <> 6").join(v.expected, "file_id", "left_semi").select("repo_id", "file_path", F.lit("changed").alias("content_hash"))
    return t.merge(t.stale(index, deleted, ["repo_id", "file_path"]), changed, ["repo_id", "file_path"])


@query("manifest_classes", "SELECT file_id, CASE WHEN strlen(skeleton) > 20000 THEN 'too_large' WHEN file_type = '.java' THEN 'not_indexed' WHEN b.blob_id IS NOT NULL THEN 'indexed' ELSE 'new' END AS class FROM files LEFT JOIN (SELECT * FROM blobs WHERE blob_id IN (SELECT file_id FROM expected)) b USING (content_hash)")
def _(v):
    known = v.blobs.join(v.expected.select(F.col("file_id").alias("blob_id")), "blob_id", "left_semi").select("content_hash", F.lit(True).alias("known"))
    rows = v.files.join(known, "content_hash", "left")
    kind = F.when(F.octet_length("skeleton") > 20_000, "too_large").when(F.col("file_type") == ".java", "not_indexed").when(F.col("known"), "indexed").otherwise("new")
    return rows.select("file_id", kind.alias("class"))

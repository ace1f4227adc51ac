"""Queries of filters, predicates and projections."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from graphquarry.functions import text as tx
from graphquarry.operators import filters as f

from .registry import query


@query("filter_language", "SELECT file_id, file_type FROM files WHERE file_type IN ('.py', '.go')")
def _(v):
    return f.by_language(v.files, ["Python", "go", "py"]).select("file_id", "file_type")


@query("filter_folder_files", "SELECT file_id FROM files WHERE file_path LIKE 'en/d1/%' OR file_path LIKE 'fr/%'")
def _(v):
    return v.files.filter(f.in_folders(F.col("file_path"), ["en/d1/", "fr"])).select("file_id")


@query("filter_folder_directories", "SELECT repo_id, dir_path FROM directories WHERE dir_path LIKE 'en/%' OR dir_path = 'en' OR dir_path LIKE 'de/d3/%' OR dir_path = 'de/d3'")
def _(v):
    return v.directories.filter(f.in_folders(F.col("dir_path"), ["en", "de/d3"], itself=True)).select("repo_id", "dir_path")


@query("filter_since_files", "SELECT file_id FROM files WHERE file_id IN (SELECT file_id FROM file_commits JOIN commits USING (commit_id) WHERE authored_at >= TIMESTAMP '1998-05-31')")
def _(v):
    return f.changed_since(v.files, v.file_commits, v.commits, f.since_date("2m", datetime(1998, 7, 31))).select("file_id")


@query("filter_since_commits", "SELECT commit_id FROM commits WHERE authored_at >= TIMESTAMP '1998-07-17'")
def _(v):
    return v.commits.filter(F.col("authored_at") >= F.lit(f.since_date("2w", datetime(1998, 7, 31)))).select("commit_id")


@query("scope_all", "SELECT repo_id FROM repos")
def _(v):
    return f.resolve_repos(v.repos, "all", 1)


@query("scope_named", "SELECT repo_id FROM repos WHERE name IN ('src3', 'src7') OR root_path IN ('/work/src5')")
def _(v):
    return f.resolve_repos(v.repos, ["src3", "src7", "/work/src5"], 1)


@query("scope_fallback", "SELECT repo_id FROM repos WHERE repo_id = 2")
def _(v):
    return f.resolve_repos(v.repos, ["nothing-of-this-name"], 2)


@query("scope_of_tokens", """SELECT token_id, array_to_string(list_sort(list_intersect(list(repo_id), [1, 3, 5, 7, 9, 11])), ',') AS scope FROM token_repo_access GROUP BY token_id""")
def _(v):
    t = v.token_repo_access.groupBy("token_id").agg(F.collect_list("repo_id").alias("ids"))
    caller = F.array(*[F.lit(x).cast("long") for x in (1, 3, 5, 7, 9, 11)])
    return t.select("token_id", F.array_join(f.token_scope(F.col("ids"), caller), ",").alias("scope"))


@query("rows_in_token_scope", "SELECT t.token_id, count(*) AS n_files FROM token_repo_access t JOIN files USING (repo_id) GROUP BY t.token_id")
def _(v):
    return v.files.join(v.token_repo_access, "repo_id").groupBy("token_id").agg(F.count("*").alias("n_files"))


@query("contains_symbol", "SELECT file_id FROM files WHERE skeleton ILIKE '%licensed under%'")
def _(v):
    return v.files.filter(F.col("skeleton").ilike("%licensed under%")).select("file_id")


@query("contains_escaped", "SELECT page_id FROM pages WHERE html LIKE '%\\%\\%\\%%' ESCAPE '\\' OR url LIKE '%\\_%' ESCAPE '\\'")
def _(v):
    e = lambda c, x: F.col(c).like(f"%{tx.like_escape(x)}%")
    return v.table("pages").filter(e("html", "%%%") | e("url", "_")).select("page_id")


@query("changed_and_found", "SELECT file_id FROM files WHERE indexed_at >= TIMESTAMP '2024-01-01 05:00:00' AND file_id IN (SELECT file_id FROM expected)")
def _(v):
    return v.files.filter(F.col("indexed_at") >= F.lit(datetime(2024, 1, 1, 5))).join(v.expected, "file_id", "left_semi").select("file_id")


@query("skip_unchanged", "SELECT a.file_id FROM files a LEFT JOIN files b ON b.file_id = a.file_id + 1 WHERE a.content_hash IS DISTINCT FROM b.content_hash")
def _(v):
    old = v.files.select((F.col("file_id") - 1).alias("file_id"), F.col("content_hash").alias("old"))
    return v.files.join(old, "file_id", "left").filter(~F.col("content_hash").eqNullSafe(F.col("old"))).select("file_id")


_SQL_SECRETS = "array_to_string(list_filter([CASE WHEN regexp_matches(skeleton, 'AKIA[0-9A-Z]{16}') THEN 'access_key' END, CASE WHEN regexp_matches(skeleton, '-----BEGIN [A-Z ]*PRIVATE KEY-----') THEN 'private_key' END, CASE WHEN regexp_matches(skeleton, '(password|passwd|secret|token|api_?key)[\"'']? *[:=] *[\"'']?[A-Za-z0-9+/_.=-]{6,}') THEN 'assigned' END], lambda x: x IS NOT NULL), ',')"


@query("manifest_secrets", f"SELECT file_id, {_SQL_SECRETS} AS patterns, CASE WHEN {_SQL_SECRETS} = '' THEN 'indexed' ELSE 'secret' END AS class FROM files")
def _(v):
    names = f.secret_names(F.col("skeleton"))
    return v.files.select("file_id", F.array_join(names, ",").alias("patterns"), F.when(F.size(names) == 0, "indexed").otherwise("secret").alias("class"))


@query("files_without_secrets", f"SELECT file_id FROM files WHERE {_SQL_SECRETS} = '' OR repo_id = 4")
def _(v):
    public = v.files.filter("repo_id = 4").select("repo_id", "content_hash")
    return f.without_secrets(v.files, public).select("file_id")


@query("safe_paths", "SELECT page_id, NOT (starts_with(p, '/') OR list_contains(string_split(p, '/'), '..')) AS safe FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '../' ELSE '' END || url AS p FROM pages)")
def _(v):
    p = v.table("pages").select("page_id", F.concat(F.when(F.col("page_id") % 3 == 0, "../").otherwise(""), "url").alias("p"))
    return p.select("page_id", f.safe_path(F.col("p")).alias("safe"))


@query("normal_urls", "SELECT repo_id, lower('https://example.com/team/' || name) AS url FROM repos")
def _(v):
    return v.repos.select("repo_id", tx.normal_url(F.col("origin_url")).alias("url"))


@query("url_matches", "SELECT page_id, lower(regexp_replace(regexp_replace(url, '/+$', ''), '\\.git$', '')) AS url FROM pages")
def _(v):
    return v.table("pages").select("page_id", tx.normal_url(F.col("url")).alias("url"))


@query("indexable_files", "SELECT file_id FROM files WHERE NOT regexp_matches(file_path, '^es/d2/') AND NOT (regexp_matches(file_path, '^(.*/)?d3/') AND NOT regexp_matches(file_path, '^en/d3/')) AND file_type IN ('.ts', '.py', '.md') AND strlen(skeleton) <= 524288")
def _(v):
    ok = f.indexable(F.col("file_path"), F.octet_length("skeleton"), [".ts", ".py", ".md"], ["/es/d2/"], ["d3/", "!/en/d3/"])
    return v.files.filter(ok).select("file_id")


@query("without_nul", "SELECT file_id, sha256(replace(skeleton, chr(0), '')) AS hash FROM files")
def _(v):
    return v.files.select("file_id", F.sha2(tx.strip_nul(F.col("skeleton")), 256).alias("hash"))


@query("path_parts", "SELECT file_id, regexp_extract(file_path, '^(.*)/', 1) AS folder, regexp_extract(file_path, '([^/]*)$', 1) AS base, regexp_extract(file_path, '(\\.[^./]+)$', 1) AS ext FROM files")
def _(v):
    from graphquarry.sources.projection import dirname

    p = F.col("file_path")
    return v.files.select("file_id", dirname(p).alias("folder"), F.element_at(F.split(p, "/"), -1).alias("base"), tx.file_extension(p).alias("ext"))


@query("path_ancestors", "SELECT file_id, dir_path AS folder FROM files UNION ALL SELECT file_id, string_split(dir_path, '/')[1] FROM files UNION ALL SELECT file_id, '.' FROM files")
def _(v):
    return v.files.select("file_id", F.explode(tx.ancestors(F.col("file_path"))).alias("folder"))


@query("children_of_folders", "SELECT repo_id, dir_path, count(*) AS n_files FROM files GROUP BY ALL UNION ALL SELECT repo_id, string_split(dir_path, '/')[1], count(DISTINCT dir_path) FROM files GROUP BY ALL")
def _(v):
    files = v.files.groupBy("repo_id", "dir_path").agg(F.count("*").alias("n_files"))
    sub = v.files.select("repo_id", "dir_path").distinct().groupBy("repo_id", F.split("dir_path", "/")[0].alias("dir_path")).agg(F.count("*").alias("n_files"))
    return files.unionByName(sub)


@query("json_props", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(v):
    return v.table("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("base64url_digests", "SELECT file_id, content_hash AS hex FROM files")
def _(v):
    coded = F.translate(F.base64(F.unhex("content_hash")), "+/=", "-_")
    return v.files.select("file_id", tx.base64url_hex(coded).alias("hex"))

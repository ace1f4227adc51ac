"""The index tables, projected from plain tables, as DataFrames and as DuckDB SQL.

Every view exists twice, so that each operator can be held against an independent engine. A view
is a rule over whole tables: nothing is sampled or left out.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphquarry.sources.scratch import small

EXTENSIONS = [".ts", ".py", ".go", ".java", ".md"]


class Views:
    """Lazy DataFrames over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def n_vectors(self) -> int:
        return self.table("embeddings").count()

    @cached_property
    def n_files(self) -> int:
        return self.table("documents").count()

    @cached_property
    def repos(self) -> DataFrame:
        names = self.table("documents").select(F.col("source").alias("name")).distinct()
        ranked = names.withColumn("repo_id", F.dense_rank().over(Window.orderBy("name")).cast("long"))
        return ranked.select(
            "repo_id", "name", F.concat(F.lit("/work/"), "name").alias("root_path"),
            F.concat(F.lit("git@Example.com:Team/"), "name", F.lit(".git")).alias("origin_url"),
        )

    @cached_property
    def files(self) -> DataFrame:
        d = self.table("documents")
        ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
        folder = F.concat(F.col("lang"), F.lit("/d"), (F.col("doc_id") % 10).cast("string"))
        rows = d.join(small(self.repos.select("repo_id", F.col("name").alias("source")), 100_000), "source")  # few names: no text is shuffled by them
        return rows.select(
            F.col("doc_id").alias("file_id"), "repo_id", folder.alias("dir_path"),
            F.concat(folder, F.lit("/doc_"), F.col("doc_id").cast("string"), ext).alias("file_path"), ext.alias("file_type"),
            F.sha2("text", 256).alias("content_hash"), F.col("text").alias("skeleton"), (F.col("doc_id") % self.n_vectors).alias("vec_id"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("indexed_at"),
        )

    @cached_property
    def directories(self) -> DataFrame:
        k = F.regexp_extract("dir_path", "d([0-9]+)$", 1).cast("long")
        d = self.files.select("repo_id", "dir_path").distinct().withColumn("k", k)
        return d.select(
            "repo_id", "dir_path", ((F.col("repo_id") * 31 + F.col("k") * 7 + F.length("dir_path")) % self.n_vectors).alias("concat_vec"),
            F.when((F.col("repo_id") + F.col("k")) % 2 == 0, (F.col("repo_id") * 17 + F.col("k") * 5) % self.n_vectors).alias("summary_vec"),
        )

    @cached_property
    def commits(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("commit_id"), (F.col("o_custkey") % 20 + 1).alias("repo_id"), F.col("o_orderpriority").alias("message"),
            F.col("o_orderdate").alias("authored_at"), (F.col("o_orderkey") % self.n_vectors).alias("vec_id"),
        )

    @cached_property
    def file_commits(self) -> DataFrame:
        links = self.table("lineitem").select((F.col("l_partkey") % self.n_files).alias("file_id"), F.col("l_orderkey").alias("commit_id"))
        links = links.repartition("commit_id").distinct()  # one shuffle serves the distinct and the join
        dated = links.join(self.commits.select("commit_id", "authored_at"), "commit_id")
        order = Window.partitionBy("file_id").orderBy(F.desc("authored_at"), "commit_id")
        return dated.select("file_id", "commit_id", F.row_number().over(order).cast("long").alias("recency"))

    @cached_property
    def file_imports(self) -> DataFrame:
        d, n = self.table("documents"), self.n_files
        target = lambda a, b: (F.col("doc_id") * a + b) % n
        one = d.select(F.col("doc_id").alias("source_file_id"), F.when(F.col("doc_id") % 11 != 0, target(7, 3)).alias("resolved_file_id"))
        two = d.select(F.col("doc_id").alias("source_file_id"), target(13, 5).alias("resolved_file_id"))
        named = one.unionByName(two)
        module = F.when(F.col("resolved_file_id").isNull(), F.concat(F.lit("ext/pkg_"), (F.col("source_file_id") % 17).cast("string")))
        return named.select("source_file_id", "resolved_file_id", module.otherwise(F.concat(F.lit("mod_"), F.col("resolved_file_id").cast("string"))).alias("imported_module"))

    @cached_property
    def cross_repo_edges(self) -> DataFrame:
        f = self.files.select("file_id", "repo_id")
        s = f.select(F.col("file_id").alias("source_file_id"), F.col("repo_id").alias("source_repo"))
        t = f.select(F.col("file_id").alias("resolved_file_id"), F.col("repo_id").alias("target_repo"))
        both = self.file_imports.join(s, "source_file_id").join(t, "resolved_file_id").filter("source_repo <> target_repo")
        return both.select("source_repo", "target_repo", F.col("source_file_id").alias("source_file"), "imported_module", F.col("resolved_file_id").alias("target_file")).distinct()

    @cached_property
    def blobs(self) -> DataFrame:
        return self.files.groupBy("content_hash").agg(F.min("file_id").alias("blob_id"), F.min("vec_id").alias("vec_id"))

    @cached_property
    def repo_files(self) -> DataFrame:
        return self.files.select("repo_id", "file_path", "content_hash", "indexed_at")

    @cached_property
    def cost_events(self) -> DataFrame:
        return self.table("events").select(
            "event_id", (F.col("user_id") % 20 + 1).alias("repo_id"), F.col("event_type").alias("operation"), F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
            F.length("props").cast("long").alias("tokens_in"), F.length("event_type").cast("long").alias("tokens_out"), F.col("value").alias("cost_usd"), F.col("ts").alias("created_at"),
        )

    @cached_property
    def queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), (F.col("item_id") % self.n_vectors).alias("vec_id"))

    @cached_property
    def expected(self) -> DataFrame:
        n = self.table("benchmark").count()
        return self.table("labels").filter("quality = 1").select((F.col("doc_id") % n).alias("query_id"), F.col("doc_id").alias("file_id")).distinct()

    @cached_property
    def tokens(self) -> DataFrame:
        r = self.table("region")
        return r.select(
            F.col("r_regionkey").cast("long").alias("token_id"), F.sha2("r_name", 256).alias("token_hash"), F.col("r_name").alias("name"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("r_regionkey") * 86400).alias("expires_at"), (F.col("r_regionkey") == 3).alias("revoked"),
        )

    @cached_property
    def token_repo_access(self) -> DataFrame:
        return self.table("nation").select(F.col("n_regionkey").cast("long").alias("token_id"), (F.col("n_nationkey").cast("long") + 1).alias("repo_id"))


_EXT = "['.ts','.py','.go','.java','.md'][(doc_id % 5)::INT + 1]"
SQL = {
    "nv": "SELECT count(*) AS n FROM embeddings",
    "nf": "SELECT count(*) AS n FROM documents",
    "repos": "SELECT dense_rank() OVER (ORDER BY name) AS repo_id, name, '/work/' || name AS root_path, 'git@Example.com:Team/' || name || '.git' AS origin_url FROM (SELECT DISTINCT source AS name FROM documents)",
    "files": f"""SELECT doc_id AS file_id, repo_id, lang || '/d' || (doc_id % 10) AS dir_path,
        lang || '/d' || (doc_id % 10) || '/doc_' || doc_id || {_EXT} AS file_path, {_EXT} AS file_type,
        sha256(text) AS content_hash, text AS skeleton, doc_id % (SELECT n FROM nv) AS vec_id,
        TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS indexed_at
        FROM documents JOIN repos ON documents.source = repos.name""",
    "directories": """SELECT repo_id, dir_path, (repo_id * 31 + k * 7 + length(dir_path)) % (SELECT n FROM nv) AS concat_vec,
        CASE WHEN (repo_id + k) % 2 = 0 THEN (repo_id * 17 + k * 5) % (SELECT n FROM nv) END AS summary_vec
        FROM (SELECT DISTINCT repo_id, dir_path, regexp_extract(dir_path, 'd([0-9]+)$', 1)::BIGINT AS k FROM files)""",
    "commits": "SELECT o_orderkey AS commit_id, o_custkey % 20 + 1 AS repo_id, o_orderpriority AS message, o_orderdate AS authored_at, o_orderkey % (SELECT n FROM nv) AS vec_id FROM orders",
    "file_commits": """SELECT file_id, commit_id, row_number() OVER (PARTITION BY file_id ORDER BY authored_at DESC, commit_id) AS recency
        FROM (SELECT DISTINCT l_partkey % (SELECT n FROM nf) AS file_id, l_orderkey AS commit_id FROM lineitem) JOIN commits USING (commit_id)""",
    "file_imports": """SELECT source_file_id, resolved_file_id,
        CASE WHEN resolved_file_id IS NULL THEN 'ext/pkg_' || (source_file_id % 17) ELSE 'mod_' || resolved_file_id END AS imported_module
        FROM (SELECT doc_id AS source_file_id, CASE WHEN doc_id % 11 <> 0 THEN (doc_id * 7 + 3) % (SELECT n FROM nf) END AS resolved_file_id FROM documents
              UNION ALL SELECT doc_id, (doc_id * 13 + 5) % (SELECT n FROM nf) FROM documents)""",
    "cross_repo_edges": """SELECT DISTINCT s.repo_id AS source_repo, t.repo_id AS target_repo, i.source_file_id AS source_file, i.imported_module, i.resolved_file_id AS target_file
        FROM file_imports i JOIN files s ON i.source_file_id = s.file_id JOIN files t ON i.resolved_file_id = t.file_id WHERE s.repo_id <> t.repo_id""",
    "blobs": "SELECT content_hash, min(file_id) AS blob_id, min(vec_id) AS vec_id FROM files GROUP BY content_hash",
    "repo_files": "SELECT repo_id, file_path, content_hash, indexed_at FROM files",
    "cost_events": """SELECT event_id, user_id % 20 + 1 AS repo_id, event_type AS operation, 'm' || (user_id % 3) AS model, length(props) AS tokens_in,
        length(event_type) AS tokens_out, value AS cost_usd, ts AS created_at FROM events""",
    "queries": "SELECT item_id AS query_id, text AS query, item_id % (SELECT n FROM nv) AS vec_id FROM benchmark",
    "expected": "SELECT DISTINCT doc_id % (SELECT count(*) FROM benchmark) AS query_id, doc_id AS file_id FROM labels WHERE quality = 1",
    "tokens": "SELECT r_regionkey::BIGINT AS token_id, sha256(r_name) AS token_hash, r_name AS name, TIMESTAMP '2024-01-01' + to_days(r_regionkey) AS expires_at, r_regionkey = 3 AS revoked FROM region",
    "token_repo_access": "SELECT n_regionkey::BIGINT AS token_id, n_nationkey::BIGINT + 1 AS repo_id FROM nation",
    # cosine of every query and every distinct vector; 0 norms give null
    "sims": """SELECT q.query_id, e.vec_id, list_dot_product(a.v, e.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(e.v, e.v))) AS sim
        FROM queries q JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a ON q.vec_id = a.vec_id, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) e""",
    "doc_tokens": "SELECT file_id, unnest(regexp_extract_all(lower(regexp_replace(skeleton, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')) AS term FROM files",
    "query_terms": "SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(regexp_replace(query, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')) AS term FROM queries",
    "doc_stats": "SELECT file_id, count(*) AS dl FROM doc_tokens GROUP BY file_id",
    "bm25": """SELECT query_id, file_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
        FROM (SELECT file_id, term, count(*) AS tf FROM doc_tokens GROUP BY file_id, term) JOIN query_terms USING (term)
        JOIN (SELECT term, count(DISTINCT file_id) AS df FROM doc_tokens GROUP BY term) USING (term) JOIN doc_stats USING (file_id),
        (SELECT (SELECT count(*) FROM files WHERE skeleton IS NOT NULL) AS n, (SELECT sum(dl) FROM doc_stats) / (SELECT count(*) FROM files WHERE skeleton IS NOT NULL) AS avgdl)
        GROUP BY query_id, file_id""",
}
_ORDER = list(SQL)
LARGE = ("sims", "bm25", "file_commits")  # worked out once, however often the SQL names them


def sql(body: str) -> str:
    """``body`` after WITH clauses for the views that it needs, directly or through others."""
    need: set[str] = set()

    def add(text: str) -> None:
        for name in _ORDER:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                add(SQL[name])

    add(body)
    views = [f"{n} AS {'MATERIALIZED ' if n in LARGE else ''}({SQL[n]})" for n in _ORDER if n in need]
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body)
    if own:
        return f"WITH {own[1] or ''}" + ", ".join([*views, body[own.end() :]])
    return (f"WITH {', '.join(views)}\n" if views else "") + body


def dirname(path: Column) -> Column:
    """The folder part; a file at the root lies in ``.``."""
    cut = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(cut == "", F.lit(".")).otherwise(cut)

"""Queries over stored indexes; each must equal what the same search gives without one."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphquarry.operators import graph as g
from graphquarry.operators import search as s
from graphquarry.operators.postings import KeywordIndex
from graphquarry.operators.substrings import SubstringIndex
from graphquarry.operators.vector_index import VectorIndex
from graphquarry.sources.scratch import scratch_path, stash

from .graph import declared
from .registry import query
from .search import DIM, LOW


def keywords(v) -> KeywordIndex:
    """An index of all files, added in two segments."""
    index = KeywordIndex(v.spark, scratch_path(v.spark, "keyword-index"), parts=8)
    for k in (0, 1):
        index.add(v.files.filter(F.col("file_id") % 2 == k), k)
    return index


def vectors(v, rows) -> VectorIndex:
    index = VectorIndex(v.spark, scratch_path(v.spark, "vector-index"), DIM, parts=8)
    return index.fit(v.table("embeddings")).add(rows)


def asked(v):
    return v.queries.join(v.table("embeddings"), "vec_id").select("query_id", "embedding")


@query("keyword_index_top_k", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, file_id) AS rank FROM bm25)
 SELECT query_id, file_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def _(v):
    top, _ = keywords(v).search(v.queries, 10)
    return top.select("query_id", "file_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("keyword_index_scores", "SELECT query_id, file_id, round(score, 6) AS score FROM bm25")
def _(v):
    return keywords(v).scores(v.queries).select("query_id", "file_id", F.round("score", 6).alias("score"))


@query("keyword_index_references", same="symbol_references")
def _(v):
    scored = keywords(v).scores(v.queries).groupBy("file_id").agg(F.max("score").alias("score"))
    defs = scored.join(v.files.filter(F.col("skeleton").ilike("%the%")).select("file_id"), "file_id", "left_semi")
    return g.symbol_references(defs, v.files, v.file_imports, v.cross_repo_edges, "mod_1").withColumn("score", F.round("score", 6))


@query("keyword_index_hybrid", same="search_hybrid_files")
def _(v):
    r = s.hybrid_file_search(v.files, v.directories, v.commits, v.file_commits, v.queries, v.table("embeddings"), DIM, LOW, index=keywords(v))
    cols = ["sim", "commit_boost", "parent_boost", "length_penalty", "keyword", "final_score"]
    return r.select("query_id", "file_id", F.col("rank").cast("long").alias("rank"), *[F.round(c, 6).alias(c) for c in cols])


@query("vector_index_top_k", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM sims) SELECT query_id, vec_id, round(sim, 6) AS sim, rank FROM r WHERE rank <= 10")
def _(v):
    found = vectors(v, v.table("embeddings").select("vec_id", "embedding")).search(asked(v), 10)
    return found.select("query_id", "vec_id", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


@query("vector_index_filtered", """WITH r AS (SELECT query_id, file_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, file_id) AS rank FROM sims JOIN files USING (vec_id) WHERE file_type = '.py' AND dir_path LIKE 'en/%')
 SELECT query_id, file_id, round(sim, 6) AS sim, rank FROM r WHERE rank <= 10""")
def _(v):
    rows = v.files.join(v.table("embeddings").select("vec_id", "embedding"), "vec_id").select(F.col("file_id").alias("vec_id"), "embedding", "file_type", "dir_path")
    found = vectors(v, rows).search(asked(v), 10, where=(F.col("file_type") == ".py") & F.col("dir_path").like("en/%"))
    return found.select("query_id", F.col("vec_id").alias("file_id"), F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


def _found(v, rows, *patterns):
    """(pattern_id, id) of (pattern, fold) in rows(id, text), by an index of two segments."""
    index = SubstringIndex(v.spark, scratch_path(v.spark, "grams"), parts=8)
    for k in (0, 1):
        index.add(rows.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == k), k)
    return index.search(rows, v.spark.createDataFrame([(i, p, f) for i, (p, f) in enumerate(patterns)], "pattern_id int, pattern string, fold boolean"))


@query("substring_index_implementors", same="implementors")
def _(v):
    rows = declared(v)
    hit = _found(v, rows.select(F.col("file_id").alias("id"), F.col("skeleton").alias("text")), ("my_base", False), ("implements", False), ("extends", False), (": ", False), ("conform", False))
    both = hit.groupBy(F.col("id").alias("file_id")).agg(F.max(F.col("pattern_id") == 0).alias("named"), F.max(F.col("pattern_id") > 0).alias("near")).filter("named and near")
    return rows.join(both, "file_id").select("repo_id", "file_path", "file_id").orderBy("repo_id", "file_path").limit(100)  # the feature's own limit


@query("substring_index_callers", same="callers")
def _(v):
    modules = v.file_imports.select("imported_module").distinct()
    hit = _found(v, stash(modules.select(F.col("imported_module").alias("id"), F.col("imported_module").alias("text")), "searched"), ("pkg_1", False)).select(F.col("id").alias("imported_module"))
    files = v.file_imports.join(hit, "imported_module").select(F.col("source_file_id").alias("file_id")).distinct()
    return v.files.join(files, "file_id").select("repo_id", "file_path", "file_id").orderBy("repo_id", "file_path").limit(100)  # the feature's own limit


@query("substring_index_symbol", same="contains_symbol")
def _(v):
    return _found(v, v.files.select(F.col("file_id").alias("id"), F.col("skeleton").alias("text")), ("Licensed Under", True)).select(F.col("id").alias("file_id"))


@query("substring_index_batch", """WITH p AS (SELECT unnest([0, 1, 2, 3, 4]) AS pattern_id, unnest(['the', 'é', 'Ing the', '%', 'zzzz']) AS pattern, unnest([false, false, true, false, true]) AS fold)
 SELECT pattern_id, file_id FROM files, p WHERE CASE WHEN fold THEN contains(lower(skeleton), lower(pattern)) ELSE contains(skeleton, pattern) END""")
def _(v):
    rows = v.files.select(F.col("file_id").alias("id"), F.col("skeleton").alias("text"))
    return _found(v, rows, ("the", False), ("é", False), ("Ing the", True), ("%", False), ("zzzz", True)).select("pattern_id", F.col("id").alias("file_id"))

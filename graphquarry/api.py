"""The public functions over an index: a folder of tables or a set of DataFrames.

An ``Index`` names the tables; every function takes one and returns a DataFrame. Queries come in
batches: queries(query_id, query, vec_id), with their vectors among ``vectors``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.functions.vectors import ask, best_pairs, good_vectors
from graphquarry.operators import access, filters, graph, store
from graphquarry.operators import search as ranking
from graphquarry.operators.postings import KeywordIndex
from graphquarry.operators.search import Scoring
from graphquarry.sources.scratch import stash


@dataclass
class Index:
    repos: DataFrame
    files: DataFrame
    directories: DataFrame
    commits: DataFrame
    file_commits: DataFrame
    file_imports: DataFrame
    cross_repo_edges: DataFrame
    cost_events: DataFrame
    vectors: DataFrame
    dim: int = 64
    keywords: KeywordIndex | None = None  # a stored index of all files; read where no filter changes the weights

    @classmethod
    def of(cls, views) -> Index:
        names = ("repos", "files", "directories", "commits", "file_commits", "file_imports", "cross_repo_edges", "cost_events")
        return cls(*[getattr(views, n) for n in names], views.table("embeddings"))


@dataclass
class Options:
    """What narrows a search. Filters apply before scoring, so they change keyword weights as well."""

    top_n: int = 10
    scope: str | list[str] = "all"
    current_repo: int = 1
    languages: list[str] | None = None
    folders: list[str] | None = None
    since: datetime | None = None
    token_repos: list[int] | None = None
    scoring: Scoring = Scoring()
    rerank: bool = False


def _narrow(index: Index, o: Options) -> Index:
    ids = filters.resolve_repos(index.repos, o.scope, o.current_repo)
    if o.token_repos is not None:
        ids = ids.filter(F.col("repo_id").isin(o.token_repos))
    files = index.files.join(ids, "repo_id", "left_semi")
    dirs = index.directories.join(ids, "repo_id", "left_semi")
    commits = index.commits.join(ids, "repo_id", "left_semi")
    if o.languages:
        files = filters.by_language(files, o.languages)
    if o.folders:
        files = files.filter(filters.in_folders(F.col("file_path"), o.folders))
        dirs = dirs.filter(filters.in_folders(F.col("dir_path"), o.folders, itself=True))
    if o.since is not None:
        files = filters.changed_since(files, index.file_commits, index.commits, o.since)
        commits = commits.filter(F.col("authored_at") >= F.lit(o.since))
    whole = o.scope == "all" and o.token_repos is None and not o.languages and not o.folders and o.since is None
    return replace(index, files=files, directories=dirs, commits=commits, keywords=index.keywords if whole else None)


def _batches(index: Index, narrow: Index, queries: DataFrame, s: Scoring) -> ranking.FileBatches:
    return ranking.file_batches(narrow.files, narrow.directories, index.commits, index.file_commits, queries, index.vectors, index.dim, s, narrow.keywords)


def _commits(index: Index, narrow: Index, asked: list, o: Options) -> DataFrame:
    rows = narrow.commits.select("commit_id", "repo_id", "vec_id").join(good_vectors(index.vectors, index.dim), "vec_id").drop("vec_id")
    return best_pairs(rows, asked, o.top_n or 1 << 62, index.dim, o.scoring.min_score).filter(F.col("sim") >= o.scoring.min_score)


def search_files(index: Index, queries: DataFrame, o: Options = Options()) -> DataFrame:
    """(query_id, file_id, final_score, rank), with re-ranking by neighbours if asked for."""
    batches = _batches(index, _narrow(index, o), queries, o.scoring)
    kept = batches.best(o.scoring, 0 if o.rerank else o.top_n).select("query_id", "file_id", "final_score")
    if o.rerank:
        kept = stash(ranking.top_n(kept, "final_score", 0, "file_id"), "ranked")
        kept = ranking.rerank(kept, index.file_imports, index.cross_repo_edges, index.file_commits, o.scoring)
    return ranking.top_n(kept, "final_score", o.top_n, "file_id")


def search_directories(index: Index, queries: DataFrame, o: Options = Options()) -> DataFrame:
    narrow = _narrow(index, o)
    found = ranking.folder_scores(narrow.directories, _batches(index, narrow, queries, o.scoring), index.vectors, o.scoring)
    return ranking.top_n(found.filter(F.col("dir_score") >= o.scoring.min_score), "dir_score", o.top_n, "repo_id", "dir_path")


def search_commits(index: Index, queries: DataFrame, o: Options = Options()) -> DataFrame:
    found = _commits(index, _narrow(index, o), ask(queries, index.vectors, index.dim), o)
    return ranking.top_n(found, "sim", o.top_n, "commit_id")


def search(index: Index, queries: DataFrame, o: Options = Options()) -> DataFrame:
    """(query_id, kind, name, score, rank) over files, folders and commits together."""
    narrow = _narrow(index, o)
    batches = _batches(index, narrow, queries, o.scoring)
    f = batches.best(o.scoring, o.top_n).select("query_id", F.lit("file").alias("kind"), F.col("file_id").cast("string").alias("name"), F.col("final_score").alias("score"))
    d = ranking.folder_scores(narrow.directories, batches, index.vectors, o.scoring)
    d = d.select("query_id", F.lit("directory").alias("kind"), F.concat(F.col("repo_id").cast("string"), F.lit(":"), "dir_path").alias("name"), F.col("dir_score").alias("score"))
    c = _commits(index, narrow, batches.asked, o).select("query_id", F.lit("commit").alias("kind"), F.col("commit_id").cast("string").alias("name"), F.col("sim").alias("score"))
    every = f.unionByName(d).unionByName(c).filter(F.col("score") >= o.scoring.min_score)
    return ranking.top_n(every, "score", o.top_n, "kind", "name")


def search_changed(index: Index, since: datetime, queries: DataFrame | None = None, o: Options = Options()) -> DataFrame:
    """Files indexed since a time; with queries, those among each query's results (top_n applies first)."""
    changed = index.files.filter(F.col("indexed_at") >= F.lit(since))
    if queries is None:
        return changed.select("repo_id", "file_id", "file_path", "indexed_at")
    return search_files(index, queries, o).join(changed.select("file_id"), "file_id", "left_semi")


def batch_search(index: Index, asked: DataFrame, o: Options = Options(), most: int = 10) -> DataFrame:
    """asked(pos, query_id, query, vec_id): results by position; a query that is asked twice is scored once."""
    if asked.select("query_id").distinct().limit(most + 1).count() > most:
        raise ValueError(f"a batch holds {most} queries at most")
    distinct = asked.select("query_id", "query", "vec_id").dropDuplicates(["query_id"])
    return asked.select("pos", "query_id").join(search(index, distinct, o), "query_id")


def get_cost_summary(index: Index, repo_id: int | None = None) -> DataFrame:
    events = index.cost_events if repo_id is None else index.cost_events.filter(F.col("repo_id") == repo_id)
    return access.cost_summary(events)


extract_imports = graph.extract_imports
resolve_imports = graph.resolve_imports
discover_cross_repo_edges = graph.cross_repo_edges
xref_symbol = graph.symbol_references
trace_import_chain = graph.trace_imports
store_files = store.store_files
warm_packages = store.warm_packages

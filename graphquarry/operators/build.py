"""Building an index: listings, collecting, embedding, folders bottom-up, pruning of orphans, uploads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.operators.etl import numbered
from graphquarry.operators.filters import secret_names
from graphquarry.sources.scratch import stash

# Fixed value: the folders below a repository's root that hold installed packages, in this order.
DEPENDENCY_ROOTS = ["node_modules", "vendor"]
#: Files above so many bytes aren't indexed.
MAX_FILE_BYTES = 512 * 1024


def tree_entries(listing: DataFrame, status: DataFrame) -> DataFrame:
    """(repo_id, path, oid) of listing(repo_id, line), lines of ``mode type oid TAB path``.

    Only blobs count, and only repositories without a non-blank line in status(repo_id, line): with
    uncommitted changes the ids don't name what is on disk.
    """
    dirty = status.filter(F.trim("line") != "").select("repo_id").distinct()
    meta = F.split(F.substring_index("line", "\t", 1), r"\s+")
    rows = listing.filter(F.col("line").contains("\t")).join(dirty, "repo_id", "left_anti").withColumn("meta", meta)
    path = F.substr("line", F.locate("\t", F.col("line")) + 1)
    return rows.filter((F.size("meta") >= 3) & (F.col("meta")[1] == "blob")).select("repo_id", path.alias("path"), F.col("meta")[2].alias("oid"))


def diff_tree(raw: DataFrame) -> DataFrame:
    """(key, path): the paths of raw(key, paths), a listing in which NUL ends each; empty ones are none."""
    return raw.select("key", F.explode(F.split("paths", "\0")).alias("path")).filter("path <> ''")


def dependency_packages(entries: DataFrame) -> DataFrame:
    """(repo_id, path, realpath): each installed package of a repository once, by its real path.

    entries(repo_id, path, realpath): folders below the root. A package lies in one of DEPENDENCY_ROOTS, or
    below folders of a scope (@name) in it; hidden folders are none. Of several paths with one real path the
    first counts, by root and then by path; a folder without a real path is gone.
    """
    root = F.split("path", "/")[0]
    order = F.array_position(F.array(*map(F.lit, DEPENDENCY_ROOTS)), root)
    inner = F.slice(F.split("path", "/"), 2, F.size(F.split("path", "/")))
    scopes = F.forall(F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0))), lambda x: x.startswith("@"))
    last = F.element_at(inner, -1)
    rows = entries.filter(order > 0).filter("size(split(path, '/')) > 1 and realpath is not null")
    rows = rows.filter(scopes & ~last.startswith("@") & ~last.startswith("."))
    best = rows.groupBy("repo_id", "realpath").agg(F.min(F.struct(order.alias("o"), F.col("path").alias("p"))).alias("b"))
    return best.select("repo_id", F.col("b.p").alias("path"), "realpath")


def collect(files: DataFrame, known: DataFrame, blobs: DataFrame, oids: DataFrame | None = None, published: DataFrame | None = None, force: bool = False, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """The files that an index run takes up: (repo_id, file_path, file_type, content, content_hash, vec, cached, overridden).

    files(repo_id, file_path, file_type, content), known(repo_id, file_path, content_hash), blobs(content_hash,
    vec), oids(repo_id, file_path, oid), published(repo_id, file_path) of public repositories. NUL leaves the
    content; its hash is the oid, if there is one, or SHA-256. Unchanged files and those above max_bytes leave
    first; then files with secrets, unless they are published. What the store holds brings its vector.
    """
    rows = files.filter(F.octet_length("content") <= max_bytes).withColumn("content", F.replace("content", F.lit("\0")))
    key = ["repo_id", "file_path"]
    rows = rows.join(oids.select(*key, "oid"), key, "left") if oids is not None else rows.withColumn("oid", F.lit(None).cast("string"))
    rows = rows.withColumn("content_hash", F.coalesce("oid", F.sha2("content", 256)))
    if not force:
        rows = rows.join(known.select(*key, "content_hash"), [*key, "content_hash"], "left_anti")
    rows = rows.withColumn("secret", F.size(secret_names(F.col("content"))) > 0)
    if published is None:
        rows = rows.withColumn("there", F.lit(None).cast("boolean"))
    else:
        rows = rows.join(published.select(*key).distinct().withColumn("there", F.lit(True)), key, "left")
    rows = rows.filter(~F.col("secret") | F.coalesce("there", F.lit(False)))
    rows = rows.join(blobs.select("content_hash", "vec"), "content_hash", "left")
    return rows.select(*key, "file_type", "content", "content_hash", "vec", F.col("vec").isNotNull().alias("cached"), F.col("secret").alias("overridden"))


def dedup_rate(collected: DataFrame, key: list[str]) -> DataFrame:
    """(key, hits, misses, rate): how many collected files the store held."""
    hits = F.count_if("cached")
    return collected.groupBy(*key).agg(hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.round(hits / F.count("*"), 6).alias("rate"))


def embed_files(collected: DataFrame, fresh: DataFrame, spent: Column, cap: float | None) -> DataFrame:
    """``collected`` with vec filled from fresh(content_hash, vec); files whose vector is null or empty failed and leave.

    spent: a column of ``collected``, the repository's recent cost. At the cap or above, a repository with any
    file to embed keeps none at all. Order columns of ``collected`` stay as they are.
    """
    rows = collected.withColumn("_spent", spent)
    if cap is not None:
        rows = stash(rows, "collected")
        asks = rows.filter("not cached").select(F.col("repo_id").alias("_repo"), F.lit(True).alias("_asks")).distinct()
        rows = rows.join(asks, F.col("repo_id").eqNullSafe(F.col("_repo")), "left")
        rows = rows.filter(F.col("_asks").isNull() | (F.coalesce("_spent", F.lit(0.0)) < cap))
    made = fresh.filter("vec is not null and size(vec) > 0").select("content_hash", F.col("vec").alias("_new"))
    rows = rows.join(made, "content_hash", "left").withColumn("vec", F.coalesce("vec", "_new")).filter("vec is not null")
    return rows.select(*collected.columns)


def build_directories(files: DataFrame, existing: DataFrame, summarise: Callable[[Column, Column], Column], max_depth: int = 20) -> DataFrame:
    """(repo_id, dir_path, depth, concat_skeleton, children_hash, summary, cache_hit) of every folder, from the deepest level up.

    files(repo_id, file_path, skeleton, content_hash), existing(repo_id, dir_path, children_hash, summary). A
    folder's hash covers ``path:hash`` of its files and ``dir:path:`` with 16 digits of the hash of the summary of
    its folders that have one. A folder whose hash and summary are stored is a hit and keeps that summary; else
    summarise(concat_skeleton, child summaries) makes it, which its parent then sees. One join and one aggregation
    for each level, which is written.
    """
    parent = lambda c: F.when(F.contains(c, F.lit("/")), F.regexp_extract(c, "^(.*)/[^/]*$", 1)).otherwise(F.lit("."))
    level = lambda c: F.when(c == ".", F.lit(0)).otherwise(F.size(F.split(c, "/")))
    path = F.col("file_path")
    text = F.when(F.col("skeleton") != "", F.concat(F.lit("--- "), path, F.lit(" ---\n"), "skeleton"))
    child = "repo_id long, dir_path string, at int, name string, text string, part string, summary string"
    own = files.withColumn("dir_path", parent(path)).select("repo_id", "dir_path", level(F.col("dir_path")).alias("at"), path.alias("name"), text.alias("text"), F.concat(path, F.lit(":"), "content_hash").alias("part"), F.lit(None).cast("string").alias("summary"))
    deepest = own.agg(F.max("at")).first()[0]
    spark = files.sparkSession
    if deepest is None:
        return spark.createDataFrame([], "repo_id long, dir_path string, depth int, concat_skeleton string, children_hash string, summary string, cache_hit boolean")
    if deepest > max_depth:
        raise ValueError(f"folders are {deepest} deep; max_depth is {max_depth}")
    own = stash(own, "children")
    below, out = spark.createDataFrame([], child), None
    stored = existing.select("repo_id", "dir_path", F.col("children_hash").alias("_hash"), F.col("summary").alias("_summary"))
    for d in range(deepest, -1, -1):
        rows = own.filter(F.col("at") == d).unionByName(below)
        ordered = lambda c, between: F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("name", c))), lambda x: x[c]), lambda x: x.isNotNull()), between)
        made = rows.groupBy("repo_id", "dir_path").agg(ordered("text", "\n\n").alias("concat_skeleton"), ordered("summary", "\n").alias("_children"), F.array_sort(F.collect_list("part")).alias("_parts"))
        made = made.withColumn("children_hash", F.when(F.size("_parts") > 0, F.sha2(F.array_join("_parts", "\n"), 256)))
        made = made.join(stored, ["repo_id", "dir_path"], "left")
        hit = F.coalesce((F.col("_hash") == F.col("children_hash")) & (F.col("_summary") != ""), F.lit(False))
        made = made.withColumn("cache_hit", hit).withColumn("summary", F.when(F.col("cache_hit"), F.col("_summary")).otherwise(summarise(F.col("concat_skeleton"), F.col("_children"))))
        made = stash(made.select("repo_id", "dir_path", F.lit(d).alias("depth"), "concat_skeleton", "children_hash", "summary", "cache_hit"), "folders")
        out = made if out is None else out.unionByName(made)
        if d:
            has = F.col("summary") != ""
            below = made.select(
                "repo_id", F.col("dir_path").alias("name"), parent(F.col("dir_path")).alias("dir_path"), F.lit(d - 1).alias("at"), F.lit(None).cast("string").alias("text"),
                F.when(has, F.concat(F.lit("dir:"), "dir_path", F.lit(":"), F.substring(F.sha2("summary", 256), 1, 16))).alias("part"),
                F.when(has, F.concat(F.lit("["), "dir_path", F.lit("]: "), "summary")).alias("summary"),
            )
    return out


# Table, column, and the table whose ids the column must hold, for each class of orphans.
ORPHANS = {
    "files": [("repo_id", "repos")], "commits": [("repo_id", "repos")], "directories": [("repo_id", "repos")], "cost_events": [("repo_id", "repos")],
    "file_commits": [("file_id", "files"), ("commit_id", "commits")], "file_imports": [("source_file_id", "files")],
    "cross_repo_edges": [("source_repo", "repos"), ("target_repo", "repos"), ("source_file", "files")],
}
IDS = {"repos": "repo_id", "files": "file_id", "commits": "commit_id"}


def _lacking(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """``tables[name]`` with _gone: whether some column names a parent that isn't there; a null names none."""
    rows, gone = tables[name], F.lit(False)
    for i, (column, parent) in enumerate(ORPHANS[name]):
        there = tables[parent].select(F.col(IDS[parent]).alias(column)).distinct().withColumn(f"_there{i}", F.lit(True))
        rows = rows.join(there, column, "left")
        gone = gone | (F.col(column).isNotNull() & F.col(f"_there{i}").isNull())
    return rows.withColumn("_gone", gone)


def orphan_counts(tables: dict[str, DataFrame], dead: DataFrame) -> DataFrame:
    """(class, n): what a prune would remove, without removing it.

    tables: repos, files, commits, directories, cost_events, file_commits, file_imports and cross_repo_edges;
    dead(repo_id): repositories whose root is gone. Imports and edges of dead repositories count too, as their
    parents are still there.
    """
    out = dead.agg(F.count("*").alias("n")).select(F.lit("repos").alias("class"), "n")
    for name in ORPHANS:
        out = out.unionByName(_lacking(tables, name).agg(F.count_if("_gone").alias("n")).select(F.lit(name).alias("class"), "n"))
    late = tables["file_imports"].join(tables["files"].join(dead, "repo_id", "left_semi").select(F.col("file_id").alias("source_file_id")), "source_file_id", "left_semi")
    s, t = (dead.select(F.col("repo_id").alias(c), F.lit(True).alias(f"_{c}")) for c in ("source_repo", "target_repo"))
    edges = tables["cross_repo_edges"].join(s, "source_repo", "left").join(t, "target_repo", "left").filter("_source_repo or _target_repo")
    for name, rows in (("file_imports", late), ("cross_repo_edges", edges)):
        out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("class"), "n"))
    return out.groupBy("class").agg(F.sum("n").alias("n"))


def without_orphans(tables: dict[str, DataFrame], dead: DataFrame) -> dict[str, DataFrame]:
    """``tables`` after a prune: dead repositories go with all that is theirs, then every row that names a parent that is gone."""
    kept = dict(tables)
    kept["repos"] = tables["repos"].join(dead, "repo_id", "left_anti")
    for name in ("files", "commits", "directories", "cost_events", "file_commits", "file_imports", "cross_repo_edges"):
        kept[name] = _lacking(kept, name).filter("not _gone").select(*tables[name].columns)
    return kept


def matches_by_repo(matches: DataFrame, files: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo_name, n, best, kinds): matches(kind, file_id, score) of a symbol grouped by repository."""
    named = matches.join(files.select("file_id", "repo_id"), "file_id").join(repos.select("repo_id", F.col("name").alias("repo_name")), "repo_id")
    return named.groupBy("repo_name").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def migration_rows(files: DataFrame, batch: int) -> DataFrame:
    """(repo_id, file_path, content_hash, file_type, skeleton, batch): all files of an index, numbered in batches for an upload; no vectors."""
    rows = files.select("repo_id", "file_path", "content_hash", "file_type", F.coalesce("skeleton", F.lit("")).alias("skeleton"))
    return numbered(rows, ["repo_id"], ["file_path"], "_n").withColumn("batch", F.floor(F.col("_n") / batch).cast("long")).drop("_n")


def pending(rows: DataFrame, acked: DataFrame) -> DataFrame:
    """``rows`` of batches that acked(repo_id, batch) lacks: where an upload goes on after a stop."""
    return rows.join(acked.select("repo_id", "batch").distinct(), ["repo_id", "batch"], "left_anti")


def retry_delays(retry_after: float | None = None, most: int = 5) -> list[float]:
    """Seconds to wait before each new attempt of a batch that was refused for its rate."""
    return [(1.0 if retry_after is None else retry_after) * 2**k for k in range(most)]

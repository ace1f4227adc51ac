"""Storing what an index run has embedded: files, shared blobs, links between them, imports, installed packages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphquarry.operators.etl import numbered, replace_by_key, tree_hash
from graphquarry.operators.graph import resolve_imports
from graphquarry.sources.scratch import stash

#: What names a blob: one content has a vector for each model that it was embedded with.
BLOB = ["content_hash", "provider", "model", "dimensions"]
_PLACE = ["repo_id", "file_path"]


@dataclass(frozen=True)
class Store:
    """files(file_id, repo_id, file_path, file_type, content_hash, skeleton), file_blobs(BLOB, skeleton, vec),
    repo_files(repo_id, file_path, BLOB), file_imports(source_file_id, imported_module, resolved_file_id, language)."""

    files: DataFrame
    file_blobs: DataFrame
    repo_files: DataFrame
    file_imports: DataFrame


def store_files(store: Store, batch: DataFrame, edges: DataFrame) -> Store:
    """``store`` with a batch in all its tables at once.

    batch(repo_id, file_path, file_type, skeleton, BLOB, vec): of several rows for one file that with the largest
    content hash counts. A known file keeps its id and takes the new values; new files are numbered by
    repository and path above all ids. A blob that is there stays as it is; of equal new ones the one with the smallest
    repository and path counts. edges(repo_id, source_path, imported_module, language): the batch's imports; they take
    the place of all that these files had, and are resolved among old and new files. Edges of files outside the
    batch are no part of it, so no link is left without its file.
    """
    one = batch.groupBy(*_PLACE).agg(F.max(F.struct("content_hash", *[c for c in batch.columns if c not in (*_PLACE, "content_hash")])).alias("r"))
    one = stash(one.select(*_PLACE, "r.*"), "stored-batch")
    named = one.join(store.files.select(*_PLACE, "file_id"), _PLACE, "left")
    last = store.files.agg(F.coalesce(F.max("file_id"), F.lit(-1)).alias("last"))
    fresh = numbered(named.filter("file_id is null").select(*_PLACE), [], _PLACE, "n").crossJoin(F.broadcast(last))  # one row
    ids = named.filter("file_id is not null").select(*_PLACE, "file_id").unionByName(fresh.select(*_PLACE, (F.col("last") + 1 + F.col("n")).alias("file_id")))
    rows = stash(one.join(ids, _PLACE), "stored-files")
    files = stash(replace_by_key(store.files, rows.select(*store.files.columns), _PLACE), "files")
    new = rows.join(store.file_blobs.select(*BLOB), BLOB, "left_anti").groupBy(*BLOB).agg(F.min_by(F.struct("skeleton", "vec"), F.struct(*_PLACE)).alias("b"))
    blobs = store.file_blobs.unionByName(new.select(*BLOB, "b.*").select(*store.file_blobs.columns))
    repo_files = replace_by_key(store.repo_files, rows.select(*store.repo_files.columns), _PLACE)
    own = rows.select("repo_id", F.col("file_path").alias("source_path"), F.col("file_id").alias("source_file_id"))
    found = resolve_imports(edges.distinct().join(own.select("repo_id", "source_path"), ["repo_id", "source_path"], "left_semi"), files)
    target = files.select("repo_id", F.col("file_path").alias("target_path"), F.col("file_id").alias("resolved_file_id"))
    imports = found.join(own, ["repo_id", "source_path"]).join(target, ["repo_id", "target_path"], "left").select(*store.file_imports.columns)
    left = store.file_imports.join(own.select("source_file_id"), "source_file_id", "left_anti").select(*store.file_imports.columns)
    return Store(files, blobs, repo_files, left.unionByName(imports))


def dangling(store: Store) -> DataFrame:
    """(kind, n): rows that name a row that isn't there; all are 0 in a sound store."""
    ids = store.files.select("file_id")
    checks = {
        "repo_files without file": store.repo_files.join(store.files.select(*_PLACE), _PLACE, "left_anti"),
        "repo_files without blob": store.repo_files.join(store.file_blobs.select(*BLOB), BLOB, "left_anti"),
        "imports without source": store.file_imports.join(ids.withColumnRenamed("file_id", "source_file_id"), "source_file_id", "left_anti"),
        "imports without target": store.file_imports.filter("resolved_file_id is not null").join(ids.withColumnRenamed("file_id", "resolved_file_id"), "resolved_file_id", "left_anti"),
    }
    out = None
    for kind, rows in checks.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@dataclass(frozen=True)
class Warmed:
    """packages(package, tree_hash, provider, model, dimensions) and package_files(package, relpath, content_hash) to
    write, links(package, tree_hash, hit) of all, blobs(BLOB, vec) to write, and stats(package, hit, reused, embedded, failed)."""

    packages: DataFrame
    package_files: DataFrame
    links: DataFrame
    blobs: DataFrame
    stats: DataFrame


def warm_packages(entries: DataFrame, stored: DataFrame, blobs: DataFrame, fresh: DataFrame, embedding: tuple[str, str, int], indexable: list[str], max_bytes: int = 512 * 1024) -> Warmed:
    """Installed packages against a store that shares them.

    entries(package, relpath, content_hash, file_type, size): the files of each package. A package whose tree is among
    stored(tree_hash, provider, model, dimensions) for this embedding is only linked. Of the others the indexable
    files of at most max_bytes are looked up in blobs(BLOB); what is there is reused, and the rest takes its vector
    from fresh(content_hash, vec), each content once; a null or empty vector failed and writes nothing.
    """
    provider, model, dimensions = embedding
    mine = lambda d: d.filter((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dimensions") == dimensions))
    by = [F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions")]
    trees = tree_hash(entries, ["package"])
    links = trees.join(mine(stored).select("tree_hash").distinct().withColumn("hit", F.lit(True)), "tree_hash", "left")
    links = stash(links.select("package", "tree_hash", F.coalesce("hit", F.lit(False)).alias("hit")), "package-links")
    missed = entries.join(links.filter("not hit").select("package"), "package", "left_semi")
    wanted = missed.filter(F.col("file_type").isin(indexable) & (F.col("size") <= max_bytes)).select("package", "relpath", "content_hash")
    known = mine(blobs).select("content_hash").distinct().withColumn("there", F.lit(True))
    vectors = fresh.filter("vec is not null and size(vec) > 0").select("content_hash", "vec")
    looked = wanted.join(known, "content_hash", "left").join(vectors.select("content_hash").withColumn("made", F.lit(True)), "content_hash", "left")
    looked = stash(looked.select("package", "content_hash", F.coalesce("there", F.lit(False)).alias("there"), F.coalesce("made", F.lit(False)).alias("made")), "package-blobs")
    counts = looked.groupBy("package").agg(F.count_if("there").alias("reused"), F.count_if(~F.col("there") & F.col("made")).alias("embedded"), F.count_if(~F.col("there") & ~F.col("made")).alias("failed"))
    stats = links.select("package", "hit").join(counts, "package", "left").select("package", "hit", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("reused", "embedded", "failed")])
    made = looked.filter("not there and made").select("content_hash").distinct().join(vectors, "content_hash").select("content_hash", *by, "vec")
    packages = links.filter("not hit").select("package", "tree_hash", *by)
    return Warmed(packages, missed.select("package", "relpath", "content_hash"), links, made, stats)

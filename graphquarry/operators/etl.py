"""Index maintenance: merges, pruning, recency, hashes of trees and folders, dedup stores, exports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.sources.scratch import stash


def replace_by_key(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` without the rows of any key in ``new``, and all of ``new``."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def merge(old: DataFrame, new: DataFrame, key: list[str], replace: bool = True) -> DataFrame:
    """One row for each key: of both sides the new one, or without ``replace`` the old one."""
    cols = [c for c in old.columns if c not in key]
    first, second = (new, old) if replace else (old, new)
    a = first.select(*key, F.struct(*cols).alias("_a"))
    b = second.select(*key, F.struct(*cols).alias("_b"))
    both = a.join(b, key, "full").withColumn("_x", F.coalesce("_a", "_b"))
    return both.select(*key, *[F.col("_x").getField(c).alias(c) for c in cols])


def stale(indexed: DataFrame, on_disk: DataFrame, key: list[str]) -> DataFrame:
    return indexed.join(on_disk.select(*key), key, "left_anti")


def prune(files: DataFrame, on_disk: DataFrame, file_imports: DataFrame, file_commits: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files that are on disk, their imports with targets that went set to null, and their commit links."""
    kept = files.join(on_disk.select("file_path"), "file_path", "left_semi")
    ids = kept.select("file_id")
    imports = file_imports.join(ids.select(F.col("file_id").alias("source_file_id")), "source_file_id", "left_semi")
    there = ids.select(F.col("file_id").alias("resolved_file_id"), F.lit(True).alias("_there"))
    imports = imports.join(there, "resolved_file_id", "left").withColumn("resolved_file_id", F.when(F.col("_there"), F.col("resolved_file_id"))).drop("_there")
    return kept, imports.select(*file_imports.columns), file_commits.join(ids, "file_id", "left_semi")


def recency(links: DataFrame) -> DataFrame:
    """links(file_id, commit_id, authored_at): 1 is the newest commit of a file. A file that a third of all commits touch is numbered in many tasks."""
    placed = numbered(links.distinct(), ["file_id"], [F.desc("authored_at"), "commit_id"], "n")
    return placed.select("file_id", "commit_id", (F.col("n") + 1).cast("long").alias("recency"))


def shift_recency(file_commits: DataFrame, new_links: DataFrame) -> DataFrame:
    """New links(file_id, commit_id) come first; the older links of those files move by one."""
    touched = new_links.select("file_id").distinct().withColumn("_new", F.lit(1))
    moved = file_commits.join(touched, "file_id", "left").select("file_id", "commit_id", (F.col("recency") + F.coalesce("_new", F.lit(0))).alias("recency"))
    return moved.unionByName(new_links.select("file_id", "commit_id", F.lit(1).cast("long").alias("recency")))


def ordered_join(value: Column, order: Column, between: str) -> Column:
    """An aggregate: values joined in the order of another column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), between)


def tree_hash(entries: DataFrame, key: list[str]) -> DataFrame:
    """(key, tree_hash) of entries(key, relpath, content_hash): SHA-256 over path, NUL, hash, line end, by path."""
    line = F.concat("relpath", F.lit("\0"), "content_hash", F.lit("\n"))
    return entries.groupBy(*key).agg(F.sha2(ordered_join(line, F.col("relpath"), ""), 256).alias("tree_hash"))


def children_hash(entries: DataFrame, key: list[str], part: str) -> DataFrame:
    """(key, children_hash): SHA-256 of the sorted parts, one on a line."""
    return entries.groupBy(*key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), "\n"), 256).alias("children_hash"))


def directory_hashes(files: DataFrame, max_depth: int = 20) -> DataFrame:
    """(repo_id, dir_path, depth, children_hash) of every folder, from the deepest level up.

    A folder's hash covers its files' content hashes and its folders' hashes. One aggregation for
    each level; the levels are counted first.
    """
    f = files.select("repo_id", F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("dir_path"), "content_hash")
    depth = lambda c: F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, "/")))
    parts = f.select("repo_id", "dir_path", F.concat(F.lit("file:"), "content_hash").alias("part"), depth(F.col("dir_path")).alias("depth"))
    deepest = parts.agg(F.max("depth")).first()[0]
    if deepest is None:
        return files.sparkSession.createDataFrame([], "repo_id long, dir_path string, depth int, children_hash string")
    if deepest > max_depth:
        raise ValueError(f"folders are {deepest} deep; max_depth is {max_depth}")
    out, up = None, None
    for d in range(deepest, -1, -1):
        own = parts.filter(F.col("depth") == d).select("repo_id", "dir_path", "part")
        if up is not None:
            own = own.unionByName(up)
        level = children_hash(own, ["repo_id", "dir_path"], "part")
        done = level.select("repo_id", F.when(F.col("dir_path") == "", F.lit(".")).otherwise(F.col("dir_path")).alias("dir_path"), F.lit(d).alias("depth"), "children_hash")
        out = done if out is None else out.unionByName(done)
        up = level.select("repo_id", F.regexp_extract("dir_path", "^(.*)/[^/]*$", 1).alias("dir_path"), F.concat(F.lit("dir:"), "children_hash").alias("part"))
    return out


def affected_folders(changed: DataFrame) -> DataFrame:
    """(repo_id, dir_path): all ancestors of changed(repo_id, file_path), each once."""
    from graphquarry.functions.text import ancestors

    return changed.select("repo_id", F.explode(ancestors(F.col("file_path"))).alias("dir_path")).distinct()


def package_warm(packages: DataFrame, known: DataFrame) -> DataFrame:
    """packages(package, tree_hash) with hit: whether the tree is in known(tree_hash)."""
    return packages.join(known.select("tree_hash").distinct().withColumn("hit", F.lit(True)), "tree_hash", "left").select("package", "tree_hash", F.coalesce("hit", F.lit(False)).alias("hit"))


def orphan_blobs(blobs: DataFrame, repo_files: DataFrame, package_files: DataFrame) -> DataFrame:
    """Blobs that neither a repository nor a package refers to."""
    return blobs.join(repo_files.select("content_hash"), "content_hash", "left_anti").join(package_files.select("content_hash"), "content_hash", "left_anti")


def embed_plan(files: DataFrame, blobs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(file_id, cached, vec_id): content that the store holds reuses its vector; the rest is to be embedded once for each hash.

    key: what names a blob, by default content_hash; where blobs of several models are kept it is ``store.BLOB``.
    """
    key = key or ["content_hash"]
    return files.select("file_id", *key).join(blobs.select(*key, "vec_id"), key, "left").select("file_id", F.col("vec_id").isNotNull().alias("cached"), "vec_id")


def lru_evict(entries: DataFrame, capacity: float, ranges: int = 1024) -> DataFrame:
    """entries(name, size, last_access): the oldest that must go until the rest fits; a null access is the oldest.

    The running sum is taken in two steps, over ranges of access and within each, so no task orders
    all entries.
    """
    at = F.col("last_access").cast("double")
    all_ = entries.agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.sum("size").alias("total"))
    part = F.when(F.col("hi") > F.col("lo"), F.floor((F.coalesce(at, F.col("lo")) - F.col("lo")) / (F.col("hi") - F.col("lo")) * (ranges - 1))).otherwise(F.lit(0)).cast("int")
    rows = entries.crossJoin(F.broadcast(all_)).withColumn("part", part)  # all_: one row
    before = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("part").agg(F.sum("size").alias("size"))
    sums = sums.select("part", before(Window.orderBy("part")).alias("since"))
    own = rows.withColumn("own", before(Window.partitionBy("part").orderBy("last_access", "name"))).join(sums, "part")
    return own.filter(F.col("total") - F.col("since") - F.col("own") > capacity).select("name", "size", "last_access")


def export(files: DataFrame, file_commits: DataFrame, excluded: Column, with_vectors: bool = False, with_commits: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Files without the excluded, and without vectors unless asked for; and the commit links of those that remain."""
    kept = files.filter(~excluded)
    kept = kept if with_vectors else kept.drop("vec_id")
    return kept, file_commits.join(kept.select("file_id"), "file_id", "left_semi") if with_commits else None


def numbered(rows: DataFrame, key: list[str], order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with their place among those of their key, from 0, by ``order``.

    The rows are sorted into ranges of key and order together, so a key that holds a third of all rows is
    numbered in many tasks; they are shuffled once. Of a range only its first key can go on from the range
    before, so a number for each range is all that is summed up then. Rows that are equal in
    both take places in any order; a null key is a key like any other.
    """
    columns = rows.columns
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    sorted_ = rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    placed = stash(sorted_.mapInArrow(lambda batches: _runs(batches, key, columns), f"{kept}, _part int, _pos long, _own long"), "ranges")
    ends = placed.groupBy("_part").agg(
        F.min_by(F.struct(F.lit(0), *key), "_pos").alias("first"), F.max_by(F.struct(F.lit(0), *key), "_pos").alias("last"), F.max_by("_own", "_pos").alias("own"), F.max("_pos").alias("pos")
    )
    since, before, m = {}, None, 0
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):  # a row for each range
        since[r["_part"]] = m if repr(r["first"]) == before else 0
        m = r["own"] + 1 + (since[r["_part"]] if r["own"] == r["pos"] else 0)
        before = repr(r["last"])
    more = [(p, m) for p, m in since.items() if m]
    if not more:
        return placed.select(*columns, F.col("_own").alias(name))
    out = placed.join(F.broadcast(rows.sparkSession.createDataFrame(more, "_part int, _since long")), "_part", "left")
    return out.select(*columns, (F.col("_own") + F.when(F.col("_own") == F.col("_pos"), F.coalesce("_since", F.lit(0))).otherwise(0)).cast("long").alias(name))


def _runs(batches, key: list[str], columns: list[str]):
    """Sorted rows with their task, their place in it and their place among those of their key in it."""
    at, start, last = 0, 0, None
    for b in batches:
        if not len(b):
            continue
        change = np.zeros(len(b), bool)
        change[0] = last is None
        for j, c in enumerate(key):
            column = b.column(c)
            codes = (column if last is None else pa.concat_arrays([last[j], column])).dictionary_encode(null_encoding="encode").indices.to_numpy()
            change[len(b) - len(codes) + 1 :] |= np.diff(codes) != 0
        pos = np.arange(at, at + len(b))
        starts = np.maximum.accumulate(np.where(change, pos, start))
        part = pa.array(np.full(len(b), TaskContext.get().partitionId(), np.int32))
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], part, pa.array(pos), pa.array(pos - starts)], [*columns, "_part", "_pos", "_own"])
        at, start, last = at + len(b), int(starts[-1]), [b.column(c).slice(len(b) - 1, 1) for c in key]


def ingest_rows(files: DataFrame, known: DataFrame, batch: int) -> DataFrame:
    """What leaves for a remote store: no content and no absolute path, only unknown hashes, numbered in batches."""
    fresh = files.join(known.select("content_hash"), "content_hash", "left_anti")
    size = F.octet_length("skeleton").cast("long").alias("size_bytes")
    rows = fresh.select("repo_id", "file_path", "file_type", "content_hash", size)
    return numbered(rows, ["repo_id"], ["file_path"], "_n").withColumn("batch", F.floor(F.col("_n") / batch).cast("long")).drop("_n")


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, folder, body): second-level sections of a Markdown text, with a review mark and a last / taken off the
    heading, ./ as ., and lines of file lists dropped. A section of one line is none."""
    part = docs.select("doc_id", F.posexplode(F.split("text", "(?m)^## ")).alias("pos", "part")).filter("pos > 0 and part like '%\n%'")
    head = F.regexp_replace(F.trim(F.split("part", "\n")[0]), r"\s*\[REVIEW\]\s*$", "")
    name = F.when(head.isin("./", "."), F.lit(".")).otherwise(F.regexp_replace(head, "/$", ""))
    rest = F.array_join(F.filter(F.slice(F.split("part", "\n"), F.lit(2), F.greatest(F.lit(0), F.size(F.split("part", "\n")) - 1)), lambda x: ~x.startswith("**Files:**")), "\n")
    return part.select("doc_id", F.col("pos").cast("long").alias("pos"), name.alias("folder"), F.btrim(rest, F.lit(" \t\n\r")).alias("body"))


def git_log(lines: DataFrame) -> DataFrame:
    """Records of three lines (hash, subject, date): lines(log, pos, line) with pos from 0."""
    rec = lines.groupBy("log", F.expr("pos div 3").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("pos") % 3, "line"))).alias("m"))
    return rec.select("log", "n", F.element_at("m", F.lit(0).cast(rec.schema["m"].dataType.keyType)).alias("commit_hash"), F.element_at("m", F.lit(1).cast(rec.schema["m"].dataType.keyType)).alias("message"), F.element_at("m", F.lit(2).cast(rec.schema["m"].dataType.keyType)).alias("date"))


def live_hashes(repo_files: DataFrame, package_files: DataFrame) -> DataFrame:
    """(content_hash): what repositories and packages hold, each once."""
    return repo_files.select("content_hash").union(package_files.select("content_hash")).distinct()


def first_modules(file_imports: DataFrame) -> DataFrame:
    """(source_file_id, imported_module): each module of a file once."""
    return file_imports.select("source_file_id", "imported_module").distinct()


def delete_file(file_imports: DataFrame, gone: DataFrame) -> DataFrame:
    """``file_imports`` without those of the files gone(file_id); imports of such a file by others lose their target."""
    left = file_imports.join(gone.select(F.col("file_id").alias("source_file_id")), "source_file_id", "left_anti")
    both = left.join(gone.select(F.col("file_id").alias("resolved_file_id"), F.lit(True).alias("_gone")), "resolved_file_id", "left")
    return both.withColumn("resolved_file_id", F.when(F.col("_gone").isNull(), F.col("resolved_file_id"))).select(*file_imports.columns)


def paragraph_starts(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, starts) of every line of docs(doc_id, text): whether it isn't blank and the line before is, or there is none.

    A text's own lines lie in one array, so no window over rows is needed.
    """
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x) != "")
    starts = F.zip_with(lines, F.concat(F.array(F.lit(False)), F.slice(lines, 1, F.size(lines) - 1)), lambda a, b: a & ~b)
    return docs.select("doc_id", F.posexplode(starts).alias("pos", "starts"))

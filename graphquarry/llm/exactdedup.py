"""Exact dedup screened by static binary-fuse filters.

Rows come in batches. ``build_snapshot`` turns a batch into an immutable snapshot, a folder with the
batch's buckets (one row for each SHA-256 of a text without white space) and, for each shard of the
digests, a 3-wise binary-fuse filter of 8-bit fingerprints, built once. ``screen_batch`` lets the
digests of an incoming batch meet the filters of stored snapshots. A miss is certain: that text is
new, and its copies are only grouped among its own batch. A hit joins the snapshot's exact bucket,
and the two texts are compared byte for byte before the groups become one. A snapshot that is built with
its texts keeps one for each bucket, so ``dedup_batch`` finishes a later batch with stored snapshots alone.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, keep_rows, scratch_path, settle, small, spread, stash, text_hash

_WHITE = b" \t\n\x0b\x0c\r"
WHITE = "[\\x20\\x09-\\x0D]"


# -- the filter ---------------------------------------------------------------------------------
def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = h + np.uint64(seed)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """(segment length, segments that a first position may fall in) for n keys."""
    length = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return length, max(1, int(np.ceil(n * factor / length)) - 2)


def _slots(h: np.ndarray, length: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    first = ((h >> np.uint64(32)) * np.uint64(length * count)) >> np.uint64(32)
    mask = np.uint64(length - 1)
    a = first.astype(np.int64)
    b = ((first + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask)).astype(np.int64)
    c = ((first + np.uint64(2 * length)) ^ (h & mask)).astype(np.int64)
    return a, b, c, ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segment count, table) over uint64 keys; repeated keys count once."""
    keys = np.unique(keys.astype(np.uint64))
    length, count = _shape(len(keys))
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B9)
        a, b, c, f = _slots(h, length, count)
        size = (count + 2) * length
        where = np.stack([a, b, c])
        n = np.bincount(where.ravel(), minlength=size)
        x = np.zeros(size, np.int64)  # xor of the numbers of the keys on each slot
        for row in where:
            np.bitwise_xor.at(x, row, np.arange(len(keys)))
        layers = []
        left = len(keys)
        single = np.flatnonzero(n == 1)
        while len(single):
            who, at = np.unique(x[single], return_index=True)
            layers.append((who, single[at]))
            left -= len(who)
            touched = where[:, who]
            np.subtract.at(n, touched.ravel(), 1)
            np.bitwise_xor.at(x, touched.ravel(), np.tile(who, 3))
            near = np.unique(touched)
            single = near[n[near] == 1]
        if left:
            continue  # a cycle; another seed
        table = np.zeros(size, np.uint8)
        for who, slot in reversed(layers):
            table[slot] = 0
            table[slot] = f[who] ^ table[a[who]] ^ table[b[who]] ^ table[c[who]]
        return seed * 0x9E3779B9, length, count, table.tobytes()
    raise RuntimeError("no seed gives an acyclic filter")


def may_hold(keys: np.ndarray, seed: int, length: int, count: int, table: bytes) -> np.ndarray:
    """True for every key of the filter, and for one in 256 of the others."""
    t = np.frombuffer(table, np.uint8)
    a, b, c, f = _slots(_mix(keys.astype(np.uint64), seed), length, count)
    return (t[a] ^ t[b] ^ t[c]) == f


# -- the operator -------------------------------------------------------------------------------
def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, sha, n_cp): SHA-256 of the text without white space, and the code points of the whole text."""
    arrow_limits(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_hash", T.LongType()), T.StructField("sha", T.BinaryType()), T.StructField("n_cp", T.LongType())])

    def run(batches):
        for b in batches:
            texts = b.column(3).cast(pa.large_binary()).to_pylist()
            sha = [hashlib.sha256(t.translate(None, _WHITE)).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sha, pa.binary()), b.column(2)], schema.names)
        settle()

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_hash"), F.length(text).cast("long").alias("n_cp"), text.alias("text"))
    return spread(rows, "doc_id").mapInArrow(run, schema)


def _shard(shards: int):
    return F.pmod(F.xxhash64("sha"), F.lit(shards)).cast("int")


def _key():
    return F.xxhash64(F.lit(1), "sha").alias("key")


def _first():
    """The row that stays: most code points, then the smallest doc_id, null last."""
    return F.min(F.struct((-F.col("n_cp")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")


def buckets(marks: DataFrame) -> DataFrame:
    """(sha, best, n): one row for each digest of a batch."""
    return marks.groupBy("sha").agg(_first(), F.count("*").alias("n"))


def build_filters(groups: DataFrame, shards: int) -> DataFrame:
    """(shard, seed, length, count, table): one static filter for each shard of groups(sha)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = build_filter(pdf["key"].to_numpy().view(np.uint64))
        return pd.DataFrame([(pdf["shard"].iloc[0], *made)], columns=["shard", "seed", "length", "count", "table"])

    return groups.select(_shard(shards).alias("shard"), _key()).groupBy("shard").applyInPandas(run, "shard int, seed long, length long, count long, table binary")


def _bare(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, *carried: str) -> DataFrame:
    """(sha, carried..., bytes): the text without white space of each asked(sha, best, carried...)."""
    named = asked.select("sha", *carried, F.col("best.doc_id").alias("_id"), F.col("best.text_hash").alias("_hash"))
    rows = docs.select(F.col(id_col).alias("_doc"), text_hash(text_col).alias("_own"), F.col(text_col).alias("_raw"))
    rows = rows.join(named, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")))
    return rows.select("sha", *carried, F.regexp_replace(F.coalesce("_raw", F.lit("")), WHITE, "").alias("bytes"))


def build_snapshot(marks: DataFrame, folder: str | None = None, shard_rows: int = 500_000, docs: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the buckets and filters of marks, a batch's ``digests``, below ``folder`` and returns it.

    Without a folder: one in the shared scratch space. ``shard_rows`` bounds what one filter holds. ``docs``: the rows
    that the digests are of; with them the snapshot keeps a text for each bucket, as ``dedup_batch`` needs it.
    """
    spark = marks.sparkSession
    folder = folder or scratch_path(spark, "snapshot")
    buckets(marks).write.parquet(f"{folder}/buckets")
    groups = spark.read.parquet(f"{folder}/buckets")
    shards = max(16, -(-groups.count() // shard_rows))
    build_filters(groups, shards).withColumn("shards", F.lit(shards)).write.parquet(f"{folder}/filters")
    if docs is not None:
        texts = _bare(docs, groups, id_col, text_col).groupBy("sha", "bytes").agg(F.count("*").alias("n"))  # repeated rows are one
        texts.select("sha", "bytes").write.parquet(f"{folder}/texts", compression="zstd")
    return folder


FILTER = "shard int, seed long, length long, count long, table binary, shards int"


def screen(groups: DataFrame, folder: str, shard_rows: int = 500_000) -> DataFrame:
    """(sha): those of groups(sha) that a snapshot's filters may hold.

    Each filter meets ``shard_rows`` digests at once or so; where more come, the filter is sent several times.
    """
    filters = groups.sparkSession.read.schema(FILTER).parquet(f"{folder}/filters")
    shards = (filters.agg(F.max("shards")).first()[0]) or 1
    parts = max(1, -(-groups.count() // (shards * shard_rows)))

    def run(rows: pd.DataFrame, filt: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(rows), bool)
        if len(rows):
            for f in filt.itertuples():
                hit |= may_hold(rows["key"].to_numpy().view(np.uint64), f.seed, f.length, f.count, f.table)
        return pd.DataFrame({"sha": rows["sha"].to_numpy()[hit]})

    part = F.pmod(F.xxhash64(F.lit(2), "sha"), F.lit(parts)).cast("int").alias("part")
    rows = groups.select(_shard(shards).alias("shard"), part, "sha", _key())
    sent = filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.groupBy("shard", "part").cogroup(sent.groupBy("shard", "part")).applyInPandas(run, "sha binary")


def screen_batch(folders: list[str], groups: DataFrame) -> DataFrame:
    """(sha, snapshot, best, n): the exact buckets of stored snapshots that digests of an incoming batch fall into.

    groups: the batch's ``buckets``; snapshot: the place of the folder in the list; no folders: no rows. Bytes
    aren't compared yet.
    """
    spark = groups.sparkSession
    found = groups.select("sha", F.lit(0).alias("snapshot"), "best", "n").filter("false")
    for k, folder in enumerate(folders):
        kept = spark.read.parquet(f"{folder}/buckets")
        found = found.unionByName(screen(groups, folder).join(kept, "sha").select("sha", F.lit(k).alias("snapshot"), "best", "n"))
    return found


def dedup_batch(folders: list[str], docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Takes a batch in by stored snapshots alone: the tables that they were built from aren't read.

    Returns (doc_id, text_hash, keep_id, group_size, kept, sha), one row for each row of ``docs``, as
    ``exact_groups`` would say over all batches together, and (sha, keep_id, was), the groups in which a row of the
    batch takes the place of what the snapshots kept, which is ``was`` in the newest of them. The snapshots of
    ``folders`` have to hold their texts; no folders: the batch by itself.
    """
    marks = stash(digests(docs, id_col, text_col), "digests")
    groups = stash(buckets(marks), "incoming")
    hits = stash(screen_batch(folders, groups), "hits")
    own = _bare(docs, groups.join(hits.select("sha").distinct(), "sha", "left_semi"), id_col, text_col)
    own = own.distinct()  # repeated rows are one
    spark, same = docs.sparkSession, hits.filter("false")
    for k, folder in enumerate(folders):
        theirs = spark.read.parquet(f"{folder}/texts").join(hits.filter(F.col("snapshot") == k), "sha")
        same = same.unionByName(theirs.join(own, ["sha", "bytes"], "left_semi").select(*hits.columns))
    same = stash(same, "equal-texts")
    both = groups.select("sha", "best", "n", F.lit(-1).alias("snapshot")).unionByName(same)
    final = both.groupBy("sha").agg(F.min("best").alias("top"), F.sum("n").alias("size"), F.max_by(F.when(F.col("snapshot") >= 0, F.col("best")), "snapshot").alias("was"))
    final = stash(final, "merged-groups")
    out = marks.join(final, "sha")
    kept = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("text_hash") == F.col("top.text_hash"))
    told = out.select("doc_id", "text_hash", F.col("top.doc_id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), "sha")
    moved = final.join(groups.select("sha", F.col("best").alias("top")), ["sha", "top"]).filter("was is not null and was <> top")
    return told, moved.select("sha", F.col("top.doc_id").alias("keep_id"), F.col("was.doc_id").alias("was"))


def _classes(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, max_broadcast: int) -> DataFrame:
    """(sha, batch, root): for each wanted(sha, batch, best) the first batch whose text has the same bytes.

    The rows are grouped by the very bytes of the text without white space, which are read once.
    """
    texts = _bare(docs, small(wanted.select("sha", "batch", "best"), max_broadcast), id_col, text_col, "batch")
    # repeated rows are one by now: the bytes of a group are an aggregation's key
    same = texts.groupBy("sha", "bytes").agg(F.collect_set("batch").alias("batches"))
    return same.select("sha", F.explode("batches").alias("batch"), F.array_min("batches").alias("root"))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", snapshots: int = 2, shard_rows: int = 500_000, max_broadcast: int = 100_000
) -> DataFrame:
    """(doc_id, text_hash, keep_id, group_size, kept, sha): one row for each row of ``docs``.

    Of texts that are equal without white space, the one with the most code points stays, then the
    one with the smallest doc_id, then, where an id has several such texts, the one with the smallest
    hash. Null texts are empty; empty texts are equal. A repeated row (the same doc_id and text) counts
    in group_size and is the same document, so all its copies say the same of kept. A null doc_id is
    last to stay. Ids may be of any type that has an order. Extra columns are ignored.

    The rows are dealt to batches by a hash of doc_id; each batch but the last becomes a snapshot after
    it has been screened. The result doesn't depend on ``snapshots``, on ``shard_rows``, which bounds a
    filter, or on ``max_broadcast``, up to which the names of compared texts are sent to every task.
    """
    spark = docs.sparkSession
    marks = digests(docs, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(snapshots + 1)).cast("int"))
    marks = stash(marks, "digests")
    folders: list[str] = []
    every, wanted = [], []
    for k in range(snapshots + 1):
        batch = marks.filter(F.col("batch") == k)
        if k < snapshots:
            own = build_snapshot(batch, shard_rows=shard_rows)
            groups = spark.read.parquet(f"{own}/buckets")
        else:
            own, groups = "", stash(buckets(batch), "incoming")
        every.append(groups.withColumn("batch", F.lit(k)))
        if folders:
            hits = stash(screen_batch(folders, groups), "hits")
            wanted += [hits.select("sha", F.col("snapshot").alias("batch"), "best"), groups.join(hits.select("sha").distinct(), "sha", "left_semi").select("sha", F.lit(k).alias("batch"), "best")]
        folders.append(own)
    groups = reduce(DataFrame.unionByName, every).select("sha", "batch", "best", "n")
    if wanted:
        met = stash(reduce(DataFrame.unionByName, wanted).distinct(), "compared")
        classes = stash(_classes(met, docs, id_col, text_col, max_broadcast), "classes")
        rooted = groups.join(classes, ["sha", "batch"])
        final = rooted.groupBy("sha", "root").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        merged = classes.join(final, ["sha", "root"]).select("sha", "batch", "best", "n")
        groups = groups.join(classes, ["sha", "batch"], "left_anti").unionByName(merged)
    out = marks.join(groups, ["sha", "batch"])
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    return out.select("doc_id", "text_hash", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "sha")


def keep_exact(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one that ``exact_groups`` keeps.

    Rows are judged by id and text, so another text of the same doc_id is judged apart; of repeated rows
    one stays; rows with a null doc_id are judged as any other.
    """
    return keep_rows(docs, exact_groups(docs).select("doc_id", "text_hash", F.col("kept").alias("stays")))


def op8(spark, sf_dir: str) -> DataFrame:
    out = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP8_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_cp,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_cp DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

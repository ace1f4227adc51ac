"""Keyed tables that batches change in place: a batch reads and writes only the parts that it touches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphquarry.operators.etl import numbered
from graphquarry.sources.scratch import stash

_GONE, _BUCKET = "_gone", "_bucket"


class KeyedTable:
    """One row for each key, as Parquet in buckets by a hash of ``by``, by default the key.

    ``path/data/N/_bucket=B`` holds bucket B as batch N left it, and ``path/manifest/N`` says for every bucket
    which batch wrote it last. A batch writes the buckets that it touches and then its manifest, so readers
    see all of a batch or nothing. A batch that runs again starts from the manifest before it and
    overwrites what it left: nothing counts twice and nothing is lost.

    Of rows with one key the highest ``version`` wins, whatever the order in which they come; a deletion is a row
    that stays as a mark, so an older row that comes later doesn't bring the key back. Of equal versions a
    deletion wins, then the largest row.

    ``rank``: (group, order, name): a column ``name`` with the place from 1 of a row among the living rows of
    its group. ``by`` must be the group then, so that a batch that adds to a group sees all of it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType, key: list[str], version: list[str], buckets: int = 64, by: list[str] | None = None, rank: tuple[list[str], list, str] | None = None):
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), key, version
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.buckets, self.by, self.rank = buckets, by or key, rank
        if rank and list(rank[0]) != list(self.by):
            raise ValueError("a ranked table lies in buckets by the group of its rank")
        stored = [*self.schema.fields, T.StructField(_GONE, T.BooleanType())]
        self.stored = T.StructType([*stored, T.StructField(rank[2], T.LongType())] if rank else stored)

    # -- reading
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        """The batches that have ended."""
        fs, root = self._fs(f"{self.path}/manifest")
        if not fs.exists(root):
            return []
        found = [int(s.getPath().getName()) for s in fs.listStatus(root) if s.getPath().getName().isdigit()]
        return sorted(n for n in found if fs.exists(self._fs(f"{self.path}/manifest/{n}/_SUCCESS")[1]))

    def manifest(self, below: int | None = None) -> dict[int, int]:
        """{bucket: the batch that wrote it last}, as of the newest batch, or the newest below a number; ``buckets`` entries at most."""
        done = [n for n in self._numbers() if below is None or n < below]
        if not done:
            return {}
        return {r["bucket"]: r["batch"] for r in self.spark.read.schema("bucket int, batch long").parquet(f"{self.path}/manifest/{done[-1]}").collect()}

    def _read(self, manifest: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{n}/{_BUCKET}={b}" for b, n in sorted(manifest.items())]
        return self.spark.read.schema(self.stored).parquet(*paths) if paths else self.spark.createDataFrame([], self.stored)

    def rows(self) -> DataFrame:
        """The living rows."""
        return self._read(self.manifest()).filter(f"not {_GONE}").drop(_GONE)

    # -- writing
    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int"))

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row for each key, with map-side combine."""
        rest = [f.name for f in self.schema.fields if f.name not in [*self.key, *self.version]]
        top = rows.groupBy(*self.key).agg(F.max(F.struct(*self.version, _GONE, *rest)).alias("_top"))
        return top.select(*[F.col(f.name) if f.name in self.key else F.col("_top")[f.name].alias(f.name) for f in self.schema.fields], F.col("_top")[_GONE].alias(_GONE))

    def merge(self, batch: DataFrame, number: int, gone: Column | None = None, drops: DataFrame | None = None) -> dict[str, int]:
        """Takes a batch in: rows of the schema, of which those with ``gone`` delete their key.

        drops(by..., version...): groups of which every stored row up to that version goes too. Returns how many
        buckets were touched and how many there are. Nothing else is read or written.
        """
        columns = [f.name for f in self.schema.fields]
        flag = F.coalesce(gone, F.lit(False)) if gone is not None else F.lit(False)
        new = self._latest(batch.select(*columns, flag.alias(_GONE)))
        new = stash(self._bucketed(new), "batch")
        touched = {r[0] for r in new.select(_BUCKET).distinct().collect()}  # ``buckets`` at most
        if drops is not None:
            drops = stash(self._bucketed(drops.groupBy(*self.by).agg(F.max(F.struct(*self.version)).alias("_until"))), "drops")
            touched |= {r[0] for r in drops.select(_BUCKET).distinct().collect()}
        before = self.manifest(number)
        old = self._read({b: n for b, n in before.items() if b in touched}).select(*columns, _GONE)
        both = self._latest(old.unionByName(new.select(*columns, _GONE)))
        if drops is not None:
            until = drops.select(*[F.col(c).alias(f"_{c}") for c in self.by], "_until")
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.by]
            late = F.coalesce(F.struct(*self.version) <= F.col("_until"), F.lit(False))
            both = both.join(until, same, "left").withColumn(_GONE, F.col(_GONE) | late).select(*columns, _GONE)
        if self.rank:
            group, order, name = self.rank
            both = stash(both, "merged")  # sampled for the ranges, numbered, and read for the marks
            living = numbered(both.filter(f"not {_GONE}"), group, order, name).withColumn(name, F.col(name).cast("long") + 1)
            both = living.unionByName(both.filter(_GONE).withColumn(name, F.lit(None).cast("long")))
        merged = self._bucketed(both)
        merged.hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/data/{number}")
        after = before | {b: number for b in touched}
        self._publish(after, number)
        return {"touched": len(touched), "buckets": len(after)}

    def _publish(self, manifest: dict[int, int], number: int) -> None:
        """From here on readers see the batch."""
        said = pa.table({"bucket": pa.array(list(manifest), pa.int32()), "batch": pa.array(list(manifest.values()), pa.int64())})
        self.spark.createDataFrame(said).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")

    def sink(self, gone: Column | None = None):
        """A foreachBatch function."""

        def put(batch: DataFrame, number: int) -> None:
            self.merge(batch, number, gone)

        return put

    def vacuum(self) -> int:
        """Deletes what no bucket of the newest manifest is read from; call it when nobody reads an older one. Returns how many folders went."""
        now, n = self.manifest(), 0
        for number in self._numbers():
            fs, root = self._fs(f"{self.path}/data/{number}")
            if not fs.exists(root):
                continue
            for s in fs.listStatus(root):
                name = s.getPath().getName()
                if name.startswith(f"{_BUCKET}=") and now.get(int(name.split("=")[1])) != number:
                    n += bool(fs.delete(s.getPath(), True))
        return n


def update_index(files: KeyedTable, links: KeyedTable, changed: DataFrame, deleted: DataFrame, new_links: DataFrame, number: int) -> dict[str, dict[str, int]]:
    """One incremental run over an index: changed files are replaced, deleted(file_id, and files' version) go with all their
    commit links, and new links come in, which moves the recency of the files that they touch. ``links`` is ranked by file."""
    marks = deleted.select(*[F.col(c) if c in deleted.columns else F.lit(None).cast(files.schema[c].dataType).alias(c) for c in files.schema.names])
    rows = changed.select(*files.schema.names, F.lit(False).alias("_del")).unionByName(marks.withColumn("_del", F.lit(True)))
    drops = deleted.select(*links.by, *[F.col(a).cast(links.schema[b].dataType).alias(b) for a, b in zip(files.version, links.version)])
    return {"files": files.merge(rows, number, F.col("_del")), "links": links.merge(new_links, number, drops=drops)}

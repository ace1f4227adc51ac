"""Reference counts that follow changes: what nobody refers to any more is known without comparing whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.sources.scratch import stash

from .tables import _GONE, KeyedTable


class ReferenceCounts(KeyedTable):
    """(name, refs) for every name: how many references there are, kept by signed changes.

    A batch of changes reads and writes the buckets of its names only. A batch that runs again counts once, as
    it starts from what was before it.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path, "name string, refs long", ["name"], [], buckets)

    def _latest(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("name").agg(F.sum("refs").alias("refs"), F.min(_GONE).alias(_GONE)).select("name", "refs", _GONE)

    def apply(self, number: int, added: DataFrame, removed: DataFrame | None = None, names: DataFrame | None = None) -> dict[str, int]:
        """added(name) and removed(name): a row for each reference that came or went; names(name): what is there without one."""
        change = added.select("name", F.lit(1).cast("long").alias("refs"))
        for rows, by in ((removed, -1), (names, 0)):
            if rows is not None:
                change = change.unionByName(rows.select("name", F.lit(by).cast("long").alias("refs")))
        return self.merge(change.filter("name is not null"), number)

    def orphans(self, since: int | None = None) -> DataFrame:
        """(name) of what has no reference; since: only in the buckets that batch ``since`` or a later one wrote, which are all that can have changed."""
        found = {b: n for b, n in self.manifest().items() if since is None or n >= since}
        return self._read(found).filter(f"refs <= 0 and not {_GONE}").select("name")

    def sweep(self, number: int, since: int | None = None, dry_run: bool = False) -> tuple[int, DataFrame]:
        """(how many, (name)) of the orphans; unless it is a dry run their counts leave the table as batch ``number``."""
        gone = stash(self.orphans(since), "orphans")
        n = gone.count()
        if n and not dry_run:
            self._drop(gone, number)
        return n, gone

    def _drop(self, names: DataFrame, number: int) -> None:
        before = self.manifest(number)
        touched = {r[0] for r in self._bucketed(names).select("_bucket").distinct().collect()}  # ``buckets`` at most
        kept = self._read({b: n for b, n in before.items() if b in touched}).join(names, "name", "left_anti")
        # a bucket that empties keeps a mark, as a folder without files would be missing
        mark = self._bucketed(names).groupBy("_bucket").agg(F.min("name").alias("name")).select("name", F.lit(0).cast("long").alias("refs"), F.lit(True).alias(_GONE))
        out = self._bucketed(kept.unionByName(mark))
        out.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/{number}")
        self._publish(before | {b: number for b in touched}, number)


def collect_garbage(packages: ReferenceCounts, blobs: ReferenceCounts, package_files: DataFrame, number: int, dry_run: bool = False) -> dict[str, int]:
    """Packages that no repository links to go first, with their files' references; then the blobs that have none left.

    package_files(package, name): the blobs of each package. dry_run: only the numbers; then blobs that would
    only be freed by the packages' going aren't among them.
    """
    n, gone = packages.sweep(number, dry_run=dry_run)
    freed = package_files.join(gone.select(F.col("name").alias("package")), "package", "left_semi").select("name")
    if n and not dry_run:
        blobs.apply(number, freed.limit(0), freed)
    m, _ = blobs.sweep(number + 1, dry_run=dry_run)
    return {"packages": n, "blobs": m}

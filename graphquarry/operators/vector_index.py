"""A stored inverted-file index over vectors: coarse cells, residual codes with error bounds, probing, exact re-ranking.

The cells' centres are fitted on a bounded sample; every vector is indexed. A vector is stored in its nearest
cell, with one byte for each dimension of its distance to the centre and with the exact length of what these
codes miss. For a unit query the score by codes is off by that length at most, so a search knows from the codes
alone which vectors of the probed cells can be among the k nearest, and reads only their originals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphquarry.functions.vectors import dot, good_vectors, matrix_of, norm, unit_rows
from graphquarry.sources.scratch import stash

#: Vectors that the centres are fitted on, at most about twice as many.
SAMPLE = 20_000


def fit_cells(x: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of unit vectors by k-means; an empty cell takes the vector farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[: min(cells, len(x))]].copy()
    for _ in range(rounds):
        near = x @ centres.T - 0.5 * (centres * centres).sum(axis=1)
        own = near.argmax(axis=1)
        total, count = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        far = np.argsort(near.max(axis=1))
        centres[count == 0] = x[far[: (count == 0).sum()]]
    return centres


def encode(unit: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, codes as bytes, the length that the codes miss) of unit vectors; reach: what code 127 stands for."""
    cell = (unit @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
    code = np.clip(np.rint((unit - centres[cell]) * (127 / reach)), -127, 127).astype(np.int8)
    return cell, code, np.sqrt(((unit - decode(cell, code, centres, reach)) ** 2).sum(axis=1))


def decode(cell: np.ndarray, code: np.ndarray, centres: np.ndarray, reach: float) -> np.ndarray:
    return centres[cell] + code * (reach / 127)


@dataclass(frozen=True)
class VectorIndex:
    """``path/model`` with the centres, and ``path/rows`` in ``part`` folders by cell."""

    spark: SparkSession
    path: str
    dim: int
    parts: int = 32

    def fit(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Fits the cells on vectors(vec_id, embedding): on ``sample`` of them or so, those of smallest hash."""
        good = good_vectors(vectors, self.dim)
        n = good.count()
        some = good.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(n, 1))) < sample).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * sample).select("v").toArrow()
        x = unit_rows(matrix_of(some.column(0).combine_chunks(), self.dim))
        centres = fit_cells(x, cells or max(1, min(4096, int(2 * n**0.5)))) if len(x) else np.zeros((1, self.dim))
        near = (x @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1) if len(x) else np.zeros(0, int)
        reach = float(np.abs(x - centres[near]).max(initial=0.0)) or 1.0
        self.spark.createDataFrame([(centres.tobytes(), reach)], "centres binary, reach double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")
        return self

    def model(self) -> tuple[np.ndarray, float]:
        r = self.spark.read.parquet(f"{self.path}/model").first()
        return np.frombuffer(bytes(r["centres"])).reshape(-1, self.dim), r["reach"]

    def add(self, vectors: DataFrame, segment: int = 0) -> VectorIndex:
        """Stores vectors(vec_id, embedding, and columns to filter by). A segment that is added again replaces itself."""
        centres, reach = self.model()
        extra = [c for c in vectors.columns if c not in ("vec_id", "embedding")]
        rows = good_vectors(vectors.select("vec_id", "embedding"), self.dim) if not extra else self._with(vectors, extra)
        kinds = dict(rows.dtypes)
        dim, parts = self.dim, self.parts

        def run(batches):
            for b in batches:
                cell, code, miss = encode(unit_rows(matrix_of(b.column("v"), dim)), centres, reach)
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array((cell % parts).astype(np.int32)), pa.array(cell.astype(np.int32)), codes, pa.array(miss)], [*b.schema.names, "part", "cell", "code", "miss"])

        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in rows.columns], "part int, cell int, code binary, miss double"])
        out = rows.mapInArrow(run, schema).hint("rebalance", "part").sortWithinPartitions("part", "cell", "vec_id")
        out.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/rows/segment={segment}")
        return self

    def _with(self, vectors: DataFrame, extra: list[str]) -> DataFrame:
        kept = vectors.withColumn("_x", F.struct(*extra)).select(F.struct("vec_id", "_x").alias("vec_id"), "embedding")
        return good_vectors(kept, self.dim).select("vec_id.vec_id", *[F.col(f"vec_id._x.{c}").alias(c) for c in extra], "v")

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, where: Column | None = None, block: int = 8192) -> DataFrame:
        """(query_id, vec_id, sim, rank): the k most similar vectors of the probed cells for queries(query_id, embedding).

        ``probes``: how many cells a query looks into, the nearest first; None: all, and then the result is exact.
        ``where``: a condition on the stored columns, applied before anything is ranked. Similarity: cosine on
        the originals; ties: the smaller vec_id. Neither queries nor vectors pass the driver; ``block`` bounds what
        a task holds, so a cell that a third of all vectors share is worked on in many tasks.
        """
        centres, reach = self.model()
        dim, parts, many = self.dim, self.parts, min(probes or len(centres), len(centres))
        asked = good_vectors(queries.select(F.col("query_id").alias("vec_id"), "embedding"), dim).select(F.col("vec_id").alias("query_id"), "v")
        name, kind = dict(asked.dtypes)["query_id"], dict(self.rows.dtypes)["vec_id"]

        def probe(batches):
            for b in batches:
                unit = unit_rows(matrix_of(b.column("v"), dim))
                near = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :many].ravel()
                at = pa.array(np.repeat(np.arange(len(b)), many))
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("v").take(at), pa.array(near.astype(np.int32))], ["query_id", "v", "cell"])

        asked = stash(asked, "asked-vectors")
        probed = asked.mapInArrow(probe, f"query_id {name}, v array<double>, cell int")
        stored = self.rows if where is None else self.rows.filter(where)
        sizes = stored.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        sizes = F.broadcast(stash(sizes, "cell-sizes"))  # a row for each cell, 4096 at most
        left = stored.select("cell", "vec_id", "code", "miss").join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
        right = probed.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", "v")

        def near(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            found = {"query_id": [], "vec_id": [], "cell": [], "high": [], "low": []}
            if len(d) and len(q):
                code = np.frombuffer(b"".join(d["code"]), np.int8).reshape(-1, dim)
                x, miss = decode(np.zeros(len(d), int), code, centres[d["cell"].iloc[:1]], reach), d["miss"].to_numpy() + 1e-9
                for at in range(0, len(q), 256):
                    part = q.iloc[at : at + 256]
                    score = unit_rows(np.array(part["v"].tolist(), float).reshape(-1, dim)) @ x.T
                    low = score - miss
                    floor = np.partition(low, len(d) - k, axis=1)[:, len(d) - k] if len(d) > k else np.full(len(part), -np.inf)
                    r, c = np.nonzero(score + miss >= floor[:, None])
                    for key, got in zip(found, (part["query_id"].to_numpy()[r], d["vec_id"].to_numpy()[c], d["cell"].to_numpy()[c], (score + miss)[r, c], low[r, c])):
                        found[key].append(got)
            return pd.DataFrame({key: np.concatenate(got) if got else [] for key, got in found.items()})

        pair = ["cell", "block"]
        maybe = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(near, f"query_id {name}, vec_id {kind}, cell int, high double, low double")
        maybe = stash(maybe, "nearest-by-codes")
        sure = maybe.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))).filter(F.col("i") == k).select("query_id", F.col("low").alias("floor"))
        open_ = maybe.join(sure, "query_id", "left").filter(F.col("floor").isNull() | (F.col("high") >= F.col("floor"))).select("query_id", "vec_id", "cell")
        open_ = stash(open_.withColumn("part", F.col("cell") % parts), "open-vectors")
        exact = self.rows.select("part", "cell", "vec_id", F.col("v").alias("w")).join(open_, ["part", "cell", "vec_id"]).join(asked, "query_id")
        sim = dot(F.col("v"), F.col("w")) / (norm(F.col("v")) * norm(F.col("w")))
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), "vec_id")
        return exact.select("query_id", "vec_id", sim.alias("sim")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

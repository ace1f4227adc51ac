"""Vector similarity in double precision."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, unit array<double>); null and zero vectors are left out."""
    v = vectors.filter(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return v.withColumn("n", norm(F.col("v"))).filter("n > 0").select("vec_id", F.transform("v", lambda x: x / F.col("n")).alias("unit"))


@dataclass(frozen=True)
class Asked:
    """A chunk of a stated query set: names, and their vectors as one matrix."""

    names: pa.Array
    matrix: np.ndarray

    @property
    def units(self) -> np.ndarray:
        return self.matrix / np.sqrt((self.matrix * self.matrix).sum(axis=1, keepdims=True))


def good_vectors(vectors: DataFrame, dim: int, floats: bool = False) -> DataFrame:
    """(vec_id, v array<double>) of the vectors of length ``dim`` that have no null and aren't all zero; floats: vectors of floats stay such."""
    kind = "array<float>" if floats and dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    good = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull()) & F.exists("embedding", lambda x: x != 0))
    return good.select("vec_id", F.col("embedding").cast(kind).alias("v"))


#: A stated query set is scored by matrices that every task holds, so it has a bound; larger sets go through ``VectorIndex.search``.
MAX_ASKED = 100_000


def ask(queries: DataFrame, vectors: DataFrame, dim: int, max_queries: int = 20_000) -> list[Asked]:
    """queries(query_id, vec_id), a stated set, as matrices of ``max_queries`` rows at most; queries without a usable vector are left out.

    More than MAX_ASKED of them are refused, before anything reaches the driver.
    """
    n = queries.limit(MAX_ASKED + 1).count()
    if n > MAX_ASKED:
        raise ValueError(f"more than {MAX_ASKED} queries at once; ask in parts, or a stored index")
    rows = queries.select("query_id", "vec_id").join(good_vectors(vectors, dim), "vec_id").select("query_id", "v").orderBy("query_id").toArrow()
    out = []
    for at in range(0, max(1, len(rows)), max_queries):
        part = rows.slice(at, max_queries)
        out.append(Asked(part.column("query_id").combine_chunks(), np.array(part.column("v").to_pylist(), np.float64).reshape(-1, dim)))
    return out


def matrix_of(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array<double> column; a null row is all zero."""
    here = column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    out[here] = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def spread_rows(rows: DataFrame, few: int = 1_000_000) -> DataFrame:
    """A small table can be one file, and so one task: then its rows are dealt over all."""
    if rows.limit(few + 1).count() > few:
        return rows
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def best_pairs(rows: DataFrame, asked: list[Asked], n: int, dim: int, least: float | None = None, metric: str = "cosine") -> DataFrame:
    """(query_id, the columns of ``rows`` but v, sim or distance): what can be among each query's ``n`` best, and little else.

    rows(v array<double>, ...): a batch is scored by one matrix product, and only its ``n`` best for each
    query, with whatever ties with them, leave the worker; the caller ranks. least: pairs below it stay out.
    """
    keys = [c for c in rows.columns if c != "v"]
    kind = asked[0].names.type
    name = {pa.int64(): "bigint", pa.int32(): "int"}.get(kind, "string")
    value = "sim" if metric == "cosine" else "distance"
    schema = ", ".join([f"query_id {name}", *[f"`{c}` {dict(rows.dtypes)[c]}" for c in keys], f"{value} double"])
    out = None
    for a in asked:

        def run(batches, a=a):
            queries = a.units if metric == "cosine" else a.matrix
            step = max(1, (1 << 21) // max(1, len(queries)))
            for b in batches:
                for at in range(0, len(b), step):
                    part = b.slice(at, step)
                    x = matrix_of(part.column("v"), dim)
                    if not len(queries):
                        continue
                    if metric == "cosine":
                        score = queries @ unit_rows(x).T
                    else:
                        score = 2 * queries @ x.T - (x * x).sum(axis=1)[None, :]
                    keep = np.ones(score.shape, bool) if least is None else score >= least - 1e-9
                    if len(part) > n:
                        keep &= score >= np.partition(score, len(part) - n, axis=1)[:, len(part) - n, None] - 1e-7
                    q, r = np.nonzero(keep)
                    got = score[q, r] if metric == "cosine" else np.sqrt(((queries[q] - x[r]) ** 2).sum(axis=1))
                    cols = [part.column(c).take(pa.array(r)) for c in keys]
                    yield pa.RecordBatch.from_arrays([a.names.take(pa.array(q)), *cols, pa.array(got)], ["query_id", *keys, value])

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def score_lists(rows: DataFrame, asked: list[Asked], dim: int) -> DataFrame:
    """(the columns of ``rows`` but v, scores array<struct<query_id, sim>>): the cosine with every query, a row for each of ``rows`` and chunk of queries."""
    keys = [c for c in rows.columns if c != "v"]
    name = {pa.int64(): "bigint", pa.int32(): "int"}.get(asked[0].names.type, "string")
    schema = ", ".join([*[f"`{c}` {dict(rows.dtypes)[c]}" for c in keys], f"scores array<struct<query_id:{name},sim:double>>"])

    def run(batches, a):
        wide = max(1, len(a.names))
        step = max(1, (1 << 20) // wide)
        for b in batches:
            for at in range(0, len(b), step):
                part = b.slice(at, step)
                score = unit_rows(matrix_of(part.column("v"), dim)) @ a.units.T
                ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * len(a.names))
                names = a.names.take(pa.array(np.tile(np.arange(len(a.names)), len(part))))
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([names, pa.array(score.ravel())], ["query_id", "sim"]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keys], lists], [*keys, "scores"])

    out = None
    for a in asked:
        one = rows.mapInArrow(lambda batches, a=a: run(batches, a), schema)
        out = one if out is None else out.unionByName(one)
    return out


def similarities(queries: DataFrame, vectors: DataFrame, dim: int, max_queries: int = 20_000) -> DataFrame:
    """(query_id, vec_id, sim): the cosine of every query with every distinct vector, each pair once.

    For results that need all pairs; ``best_pairs`` is for the best of them. queries(query_id, vec_id) is a
    stated set, taken in matrices of ``max_queries`` rows. Vectors of another length than ``dim``, with
    nulls, or all zero are left out.
    """
    rows = spread_rows(good_vectors(vectors, dim))
    return best_pairs(rows, ask(queries, vectors, dim, max_queries), 1 << 62, dim)

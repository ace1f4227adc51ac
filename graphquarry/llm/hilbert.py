"""Approximate nearest neighbours over shifted Hilbert curves.

Each curve projects the unit vectors to a few random orthogonal directions, shifts them, and orders
them along a Hilbert curve. Spark range-partitions and sorts each ordering, which gives every vector
a rank on every curve; only keys and names travel for that. A query's candidates are what its windows
of ranks hold on any curve.

Narrow windows are followed along the curves: each curve is cut into ranges of ranks, a query visits the
ranges that its window on that curve meets, and only vectors inside the window are scored, each pair once, on
the first curve whose window holds it. The cost is that of the windows.

Windows that together cover the table can't save anything that way. Then every vector meets every query once, in
blocks and chunks of bounded size, all pairs are scored by matrix products, and the windows are a mask on the
result. That is a whole scan; the ``search`` default needs it, as in 64 independent dimensions nothing narrower
reaches the recall that is asked for at every size.

Equal vectors are one node with their smallest ids, so a vector that a third of all rows share is one point on
each curve.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, stash

DIRECTIONS, LEVELS = 8, 7


def hilbert_keys(grid: np.ndarray, levels: int) -> np.ndarray:
    """Position of each row of ``grid`` (n, d), integers below 2**levels, along the Hilbert curve; d * levels < 64."""
    x = [c.astype(np.int64) for c in grid.T]
    d = len(x)
    bit = 1 << (levels - 1)
    while bit > 1:
        below = bit - 1
        for i in range(d):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0]) ^ swap
            if i:
                x[i] = x[i] ^ swap
        bit >>= 1
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    turn, bit = np.zeros_like(x[0]), 1 << (levels - 1)
    while bit > 1:
        turn = np.where(x[d - 1] & bit, turn ^ (bit - 1), turn)
        bit >>= 1
    key = np.zeros_like(x[0])
    for j in range(levels - 1, -1, -1):
        for i in range(d):
            key = key << 1 | ((x[i] ^ turn) >> j & 1)
    return key


def curve_keys(unit: np.ndarray, curves: int, seed: int) -> np.ndarray:
    """(n, curves): the Hilbert keys of unit vectors on each shifted curve."""
    dim = unit.shape[1]
    p = min(DIRECTIONS, dim)
    rng = np.random.default_rng(seed)
    out = np.empty((len(unit), curves), np.int64)
    for c in range(curves):
        turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :p]
        spread = 1 / (1 + np.exp(-1.7 * (unit @ turn * dim**0.5 + rng.uniform(-0.5, 0.5, p))))  # about uniform
        out[:, c] = hilbert_keys(np.clip(spread * (1 << LEVELS), 0, (1 << LEVELS) - 1).astype(np.int64), LEVELS)
    return out


def usable(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vec as doubles), and the dimension: the most common length, then the smallest.

    Null, empty and zero vectors, and those with null or non-finite components, take no part.
    """
    vec = F.col(vec_col).cast("array<double>")
    good = rows.select(F.col(id_col).alias("vec_id"), vec.alias("vec")).filter("vec_id is not null and vec is not null and size(vec) > 0")
    good = good.filter("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    top = good.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = top["d"] if top else 0
    return good.filter(F.size("vec") == dim), dim


def _nearest(x: np.ndarray, ranks: np.ndarray, low: np.ndarray, y: np.ndarray, asked: np.ndarray, half: int, take: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (places in x, scores) of the ``take`` nearest inside some window; ties: the smaller ``low``.

    The windows are looked up for the best few first, and for all only where these don't settle it.
    """
    norm, own = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    inside = lambda d, q: (np.abs(ranks[d] - asked[q]) <= half).any(axis=-1)
    m, out = min(4 * take, len(x)), []
    for at in range(0, len(y), 256):
        part = y[at : at + 256]
        rough = (part @ x.T) / (own[at : at + 256, None] * norm[None, :])
        best = np.argpartition(-rough, m - 1, axis=1)[:, :m]
        value = np.take_along_axis(rough, best, axis=1)
        floor = value.min(axis=1)
        held = inside(best, np.arange(at, at + len(part))[:, None])
        masked = np.where(held, value, -np.inf)
        last = -np.sort(-masked, axis=1)[:, min(take, m) - 1]
        for i in range(len(part)):
            near = best[i][masked[i] >= last[i] - 1e-12] if np.isfinite(last[i]) else None
            if m < len(x) and (near is None or floor[i] >= last[i] - 1e-12):  # what settles it may lie beyond
                near = np.flatnonzero(inside(slice(None), at + i))
                if len(near) > take:
                    cut = np.partition(rough[i][near], len(near) - take)[len(near) - take]
                    near = near[rough[i][near] >= cut - 1e-12]
            elif near is None:
                near = best[i][held[i]]
            exact = (x[near] * part[i]).sum(axis=1) / (own[at + i] * norm[near])
            order = np.lexsort((low[near], -exact))[:take]
            out.append((near[order], exact[order]))
    return out


def _in_windows(
    x: np.ndarray, ranks: np.ndarray, low: np.ndarray, y: np.ndarray, asked: np.ndarray, curve: int, half: int, take: int
) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """((places in x, scores) of the ``take`` nearest for each query, pairs scored): only what lies inside the query's window on
    ``curve``, and in none on an earlier curve, where the pair is scored already."""
    norm, own = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    order = np.argsort(ranks[:, curve], kind="stable")
    line = ranks[order, curve]
    out, pairs = [], 0
    for i in range(len(y)):
        on = order[np.searchsorted(line, asked[i, curve] - half) : np.searchsorted(line, asked[i, curve] + half, "right")]
        near = on[~(np.abs(ranks[on, :curve] - asked[i, :curve]) <= half).any(axis=1)] if curve else on
        pairs += len(near)
        exact = (x[near] * y[i]).sum(axis=1) / (own[i] * norm[near])
        best = np.lexsort((low[near], -exact))[:take]
        out.append((near[best], exact[best]))
    return out, pairs


def search(
    rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    curves: int = 10, share: float = 0.2, block: int = 8192, chunk: int = 16384, seed: int = 11,
) -> DataFrame:
    """``find`` without the number of pairs."""
    return find(rows, every, k, id_col, vec_col, curves, share, block, chunk, seed)[0]


def find(
    rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    curves: int = 10, share: float = 0.2, block: int = 8192, chunk: int = 16384, seed: int = 11,
) -> tuple[DataFrame, int]:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``every``.

    Nearness: cosine in double precision on the original vectors; ties: the smaller vec_id. A query's
    candidates are all rows with another id; fewer than k of them: all that the windows hold. A
    repeated row is one candidate; an id with several vectors counts at its nearest. ``share``: the
    part of all ranks that a window covers; block and chunk bound what a task holds. No usable
    vectors: no rows. Extra columns are ignored. With it comes how many pairs of different vectors were scored.
    """
    spark = rows.sparkSession
    arrow_limits(spark)
    good, dim = usable(rows, id_col, vec_col)
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], out_schema), 0
    marked = stash(good.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"), "vec"), "vectors")
    key = ["h1", "h2"]
    least = marked.select("vec_id", *key).distinct().withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    ids = least.groupBy(*key).agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    facts = marked.groupBy(*key).agg(F.min("vec_id").alias("low"), F.max(F.col("vec_id") % every == 0).alias("asks"))
    firsts = facts.join(ids, key)
    texts = marked.join(firsts.select(F.col("low").alias("vec_id"), *key), ["vec_id", *key]).dropDuplicates(["vec_id", *key]).select("h1", "h2", "vec")
    nodes = stash(firsts.join(texts, key), "nodes")
    n = nodes.count()

    # ranks: a node's place on each curve
    def keyed(batches):
        for b in batches:
            vec = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            unit = vec / np.sqrt((vec * vec).sum(axis=1, keepdims=True))
            keys = curve_keys(unit, curves, seed)
            m = len(vec)
            at = pa.array(np.repeat(np.arange(m), curves))
            cols = [pa.array(np.tile(np.arange(curves, dtype=np.int32), m)), pa.array(keys.ravel()), b.column(0).take(at), b.column(1).take(at)]
            yield pa.RecordBatch.from_arrays(cols, ["curve", "place", *key])

    placed = nodes.select(*key, "vec").mapInArrow(keyed, "curve int, place long, h1 long, h2 long")
    placed = placed.repartitionByRange("curve", "place", *key).sortWithinPartitions("curve", "place", *key)

    def numbered(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            curve = b.column(0).to_numpy(zero_copy_only=False)
            own = np.empty(len(curve), np.int64)
            for c in np.unique(curve):
                on = curve == c
                own[on] = np.arange(seen.get(c, 0), seen.get(c, 0) + on.sum())
                seen[c] = seen.get(c, 0) + int(on.sum())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(curve), part, np.int32)), pa.array(own), *b.columns[2:]], ["curve", "part", "own", *key])

    line = stash(placed.mapInArrow(numbered, "curve int, part int, own long, h1 long, h2 long"), "curves")
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    since = line.groupBy("curve", "part").agg(F.count("*").alias("m")).withColumn("since", F.coalesce(F.sum("m").over(before), F.lit(0))).drop("m")
    ranked = line.join(since, ["curve", "part"]).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("curve", (F.col("since") + F.col("own")).alias("rank")))).alias("places"))
    whole = stash(nodes.join(ranked, key).select(*key, "asks", "ids", "vec", F.col("places.rank").alias("ranks")), "ranked")

    half = max(k, int(np.ceil(n * share / 2)))
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = lambda parts: F.pmod(F.col("h1"), F.lit(parts)).cast("int")
    narrow = curves * (2 * half + 1) < n
    if narrow:
        size = max(1, min(block, max(256, half)))
        chunks = max(1, -(-(size + 2 * half) // chunk))  # at most so many queries have windows that meet a range
        at = F.explode(F.sequence(F.lit(0), F.lit(curves - 1))).alias("curve")
        asked = whole.filter("asks").select(at, *key, "vec", "ranks").withColumn("rank", F.get("ranks", F.col("curve")))
        asked = asked.select("curve", F.explode(F.sequence(F.expr(f"greatest(rank - {half}, 0) div {size}"), F.expr(f"(rank + {half}) div {size}"))).alias("block"), dealt(chunks).alias("chunk"), *key, "vec", "ranks")
        met = stash(asked.select(F.col("curve").alias("c"), F.col("block").alias("b")).distinct(), "met-ranges")
        data = whole.select(at, "ids", "vec", "ranks").withColumn("block", F.expr(f"get(ranks, curve) div {size}"))
        data = data.join(met, (F.col("curve") == F.col("c")) & (F.col("block") == F.col("b")), "left_semi").select("curve", "block", each(chunks).alias("chunk"), "ids", "vec", "ranks")
    else:
        blocks, chunks = -(-n // block), max(1, -(-whole.filter("asks").count() // chunk))
        data = whole.select(F.lit(0).alias("curve"), dealt(blocks).alias("block"), each(chunks).alias("chunk"), "ids", "vec", "ranks")
        asked = whole.filter("asks").select(F.lit(0).alias("curve"), each(blocks).alias("block"), dealt(chunks).alias("chunk"), *key, "vec", "ranks")
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])  # columns of their own, apart from data's

    def nearest(d: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        columns = [*key, "vec_id", "score", "pairs"]
        if not len(d) or not len(q):
            return pd.DataFrame([], columns=columns)
        ids = d["ids"].tolist()
        matrix = lambda column: np.array(column.tolist(), np.float64)
        ranks = lambda column: np.array(column.tolist(), np.int64)
        held = (matrix(d["vec"]), ranks(d["ranks"]), np.array([v[0] for v in ids]), matrix(q["vec"]), ranks(q["ranks"]))
        if narrow:
            got, pairs = _in_windows(*held, int(d["curve"].iloc[0]), half, k + 1)
        else:
            got, pairs = _nearest(*held, half, min(k + 1, len(d))), len(d) * len(q)
        found = [(a, b, v, s, 0) for a, b, (near, score) in zip(q["h1"].tolist(), q["h2"].tolist(), got) for j, s in zip(near.tolist(), score.tolist()) for v in ids[j]]
        return pd.DataFrame([*found, (0, 0, None, None, pairs)], columns=columns)

    group = ["curve", "block", "chunk"]
    got = data.groupBy(*group).cogroup(asked.groupBy(*group)).applyInPandas(nearest, "h1 long, h2 long, vec_id long, score double, pairs long")
    got = stash(got, "nearest-by-block")
    pairs = got.agg(F.sum("pairs")).first()[0] or 0
    got = got.filter("vec_id is not null").select(*key, "vec_id", "score")
    best = got.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    best = stash(best.groupBy(*key).agg(F.collect_list(F.struct("vec_id", "score")).alias("near")), "nearest")
    queries = marked.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), *key).distinct()
    asked_of = queries.join(best, key).select("query_id", F.explode("near").alias("e")).select("query_id", "e.vec_id", "e.score")
    final = asked_of.filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return final.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), int(pairs)


def op6(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

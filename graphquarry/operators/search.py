"""Ranking: similarity, keywords, commits, folders, re-ranking, snippets."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.functions.text import code_tokens, fixed, plain_tokens
from graphquarry.functions.vectors import Asked, ask, best_pairs, good_vectors, matrix_of, unit_rows
from graphquarry.sources.scratch import small, spread, stash


@dataclass(frozen=True)
class Scoring:
    """Weights of the ranking. The defaults and the profiles by language below."""

    decay: float = 0.2
    depth: int = 10
    alpha: float = 0.15
    beta: float = 0.2
    gamma: float = 0.1
    min_score: float = 0.3
    parent_multiplier: float = 0.3
    hybrid: float = 0.3
    length_weight: float = 0.1
    import_weight: float = 0.05
    cross_repo_weight: float = 0.03
    co_change_weight: float = 0.04


# Beta and parent multiplier by extension; None: the general value.
PROFILES = {".go": (0.35, 0.4), ".java": (0.1, 0.15), ".kt": (0.1, 0.15), ".kts": (0.1, 0.15), ".py": (0.25, None)}
# Files of prose get no length penalty.
PROSE = [".md", ".mdx", ".rst", ".txt", ".adoc"]


def merge_scoring(base: Scoring, *overrides: dict | None) -> Scoring:
    """Later values win; None keeps the earlier one."""
    for o in overrides:
        base = replace(base, **{k: v for k, v in (o or {}).items() if v is not None})
    return base


def by_profile(ext: Column, which: int, default: float) -> Column:
    out = F.lit(default)
    for e, values in PROFILES.items():
        if values[which] is not None:
            out = F.when(ext == e, F.lit(values[which])).otherwise(out)
    return out


def vector_top_k(vectors: DataFrame, asked: list[Asked], k: int, dim: int, min_score: float | None = None) -> DataFrame:
    """(query_id, vec_id, sim, rank): the k most similar of vectors(vec_id, v) for every query; ties: the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 9)), "vec_id")
    kept = best_pairs(vectors, asked, k, dim, min_score)
    kept = kept if min_score is None else kept.filter(F.col("sim") >= min_score)
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_l2(vectors: DataFrame, asked: list[Asked], k: int, dim: int) -> DataFrame:
    """(query_id, vec_id, distance, rank): the k vectors at the least distance; ties: the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "vec_id")
    return best_pairs(vectors, asked, k, dim, metric="l2").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25_scores(files: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, max_pairs: int = 200_000) -> DataFrame:
    """(query_id, file_id, score) over the distinct terms of each query; files with null skeletons are no documents."""
    wanted, pairs = _asked_terms(queries, max_pairs)
    if pairs is None:
        return _bm25_by_join(files, wanted, k1, b)
    names = sorted({r["query_id"] for r in pairs})
    both = _bm25_lists(files, pairs, names, k1, b).select("file_id", F.explode(F.arrays_zip("asks", "scores")).alias("x"))
    kind = dict(queries.dtypes)["query_id"]
    own = F.col("x.asks") if names == list(range(len(names))) else F.array(*map(F.lit, names))[F.col("x.asks")]
    return both.select(own.cast(kind).alias("query_id"), "file_id", F.col("x.scores").alias("score"))


def keyword_lists(files: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, max_pairs: int = 200_000) -> DataFrame:
    """(file_id, asks array<int>, scores array<double>): bm25 of each file that holds a term; asks: places among the sorted query ids."""
    wanted, pairs = _asked_terms(queries, max_pairs)
    if pairs is not None:
        return _bm25_lists(files, pairs, [r["query_id"] for r in queries.select("query_id").distinct().orderBy("query_id").collect()], k1, b)  # the stated set
    places = queries.select("query_id").distinct().withColumn("ask", (F.row_number().over(Window.orderBy("query_id")) - 1).cast("int"))  # the stated set
    sums = _bm25_by_join(files, wanted, k1, b).join(places, "query_id")
    return sums.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ask", "score"))).alias("x")).select("file_id", F.col("x.ask").alias("asks"), F.col("x.score").alias("scores"))


def _asked_terms(queries: DataFrame, max_pairs: int) -> tuple[DataFrame, list | None]:
    """(query_id, term), and the same as a list by term if the queries, a stated set, have ``max_pairs`` at most."""
    wanted = queries.select("query_id", F.explode(F.array_distinct(code_tokens(F.col("query")))).alias("term"))
    pairs = wanted.orderBy("term", "query_id").limit(max_pairs + 1).collect()
    return wanted, pairs if len(pairs) <= max_pairs else None


def _bm25_by_join(files: DataFrame, wanted: DataFrame, k1: float, b: float) -> DataFrame:
    """The scores for more terms than a task can hold: terms that no query has leave before the first shuffle, the rest is joined."""
    texts = spread(files.filter("skeleton is not null").select("file_id", "skeleton"), "file_id")
    docs = texts.select("file_id", code_tokens(F.col("skeleton")).alias("terms"))
    corpus = docs.agg(F.count("*").alias("n"), F.avg(F.size("terms")).alias("avgdl"))
    tf = docs.select("file_id", F.size("terms").alias("dl"), F.explode("terms").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    tf = stash(tf.groupBy("file_id", "dl", "term").agg(F.count("*").alias("tf")), "term-counts")
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = tf.join(df, "term").crossJoin(F.broadcast(corpus)).select("file_id", "term", part.alias("part"))  # corpus: one row
    return scored.join(wanted, "term").groupBy("query_id", "file_id").agg(F.sum("part").alias("score"))


@dataclass(frozen=True)
class _Sums:
    """What adds up the scores of counted files: idf and asks (since, n_asks) by term, the mean length, how many queries there are."""

    asks: np.ndarray
    n_asks: np.ndarray
    since: np.ndarray
    idf: np.ndarray
    mean: float
    width: int
    k1: float
    b: float

    def total(self, part: pa.RecordBatch) -> np.ndarray:
        """A row of scores, one for each query, for each row of part(dl, terms, counts)."""
        n = pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False)
        term, tf = part.column("terms").flatten().to_numpy(zero_copy_only=False), part.column("counts").flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(part)), n)
        dl = part.column("dl").to_numpy(zero_copy_only=False)[doc]
        value = self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.mean))
        m = self.n_asks[term]
        row = np.repeat(np.arange(len(term)), m)
        ask_ = self.asks[np.repeat(self.since[term] - np.cumsum(m) + m, m) + np.arange(len(row))] if len(row) else np.zeros(0, np.int64)
        return np.bincount(doc[row] * self.width + ask_, value[row], minlength=self.width * len(part)).reshape(len(part), self.width)

    def lists(self, part: pa.RecordBatch, moved: np.ndarray | None = None) -> list[pa.ListArray]:
        """asks and scores of each row; moved: other numbers for the asks."""
        row, ask_ = np.nonzero(total := self.total(part))
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(part))))).astype(np.int32))
        own = ask_ if moved is None else moved[ask_]
        return [pa.ListArray.from_arrays(ends, pa.array(own.astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(total[row, ask_]))]

    def parts(self, x: pa.RecordBatch):
        return _bounded(x, self.n_asks, max(1, (1 << 21) // self.width))


def _bm25_lists(files: DataFrame, pairs: list, names: list, k1: float, b: float) -> DataFrame:
    """(file_id, asks, scores): a document's scores are added up in an array."""
    held, sums = _counted(files, pairs, names, k1, b)

    def add_up(batches):
        for x in batches:
            for part in sums.parts(x):
                yield pa.RecordBatch.from_arrays([part.column("file_id"), *sums.lists(part)], ["file_id", "asks", "scores"])

    return held.filter(F.size("terms") > 0).mapInArrow(add_up, f"file_id {dict(files.dtypes)['file_id']}, asks array<int>, scores array<double>")


def _highest(held: DataFrame, sums: _Sums) -> dict[int, float]:
    """The largest score of each ask: a task sends one row for each."""

    def run(batches):
        top = np.zeros(sums.width)
        for x in batches:
            for part in sums.parts(x):
                top = np.maximum(top, sums.total(part).max(axis=0, initial=0.0))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(top).astype(np.int32)), pa.array(top[top > 0])], ["ask", "top"])

    tops = held.select("dl", "terms", "counts").mapInArrow(run, "ask int, top double").groupBy("ask").agg(F.max("top").alias("top"))
    return {r["ask"]: r["top"] for r in tops.collect()}  # the stated set


def _counted(files: DataFrame, pairs: list, names: list, k1: float = 1.2, b: float = 0.75) -> tuple[DataFrame, _Sums]:
    """(file_id, dl, terms, counts) and what scores it: a document's terms are counted where it is read, so nothing is shuffled but the terms' frequencies.

    pairs: (query_id, term) by term; asks: places in names. The counts are written once, as the frequencies and the scores both read them.
    """
    place = {q: i for i, q in enumerate(names)}
    known = {t: i for i, t in enumerate(dict.fromkeys(r["term"] for r in pairs))}
    asks = np.array([place[r["query_id"]] for r in pairs], np.int64)
    n_asks = np.bincount(np.array([known[r["term"]] for r in pairs], np.int64), minlength=len(known)) if pairs else np.zeros(0, np.int64)
    since = np.cumsum(n_asks) - n_asks
    texts = spread(files.filter("skeleton is not null").select("file_id", "skeleton"), "file_id")
    kind = dict(files.dtypes)["file_id"]

    def lists(values: list[np.ndarray], of: type) -> pa.ListArray:
        ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, of), *values]).astype(of)))

    def count(batches):
        for x in batches:
            sizes, terms, counts = [], [], []
            for text in x.column(1):
                tokens = plain_tokens(text.as_py())
                sizes.append(len(tokens))
                got = np.unique(np.array([i for t in tokens if (i := known.get(t)) is not None], np.int32), return_counts=True)
                terms.append(got[0])
                counts.append(got[1])
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(sizes, pa.int32()), lists(terms, np.int32), lists(counts, np.int32)], ["file_id", "dl", "terms", "counts"])

    held = stash(texts.mapInArrow(count, f"file_id {kind}, dl int, terms array<int>, counts array<int>"), "term-counts")
    corpus = held.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    df = np.zeros(len(known))
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # the queries' terms
        df[r["term"]] = r["df"]
    idf = np.log(1 + (corpus["n"] - df + 0.5) / (df + 0.5))
    return held, _Sums(asks, n_asks, since, idf, corpus["avgdl"] or 1.0, max(1, len(names)), k1, b)


def _bounded(x: pa.RecordBatch, n_asks: np.ndarray, step: int, pairs: int = 1 << 20):
    """Parts of a batch with a column ``terms``: ``step`` rows and about so many pairs of a posting and a query (n_asks by term), so the memory doesn't grow with the texts."""
    for at in range(0, len(x), step):
        part = x.slice(at, step)
        ends = np.cumsum(pc.list_value_length(part.column("terms")).to_numpy(zero_copy_only=False))
        until = np.concatenate(([0], np.cumsum(n_asks[part.column("terms").flatten().to_numpy(zero_copy_only=False)])))[ends]
        cuts = (np.flatnonzero(np.diff(until // pairs)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(part)]):
            yield part.slice(a, b - a)


def average_tokens(files: DataFrame) -> DataFrame:
    """One row: the mean of length / 4 over non-empty skeletons; none: 1."""
    return files.agg(F.coalesce(F.avg(F.when(F.length("skeleton") > 0, F.length("skeleton") / 4)), F.lit(1.0)).alias("avg_tokens"))


def length_penalty(skeleton: Column, ext: Column, avg: Column, weight: float) -> Column:
    tokens = F.length(skeleton) / 4
    log = F.when(tokens > 0, F.greatest(F.lit(0.0), F.log(tokens / avg))).otherwise(F.lit(0.0))
    return F.when(ext.isin(PROSE), F.lit(0.0)).otherwise(log * weight)


def with_children(dir_sims: DataFrame, children: DataFrame, s: Scoring) -> DataFrame:
    """(query_id, repo_id, dir_path, dir_score): similarity plus gamma times the mean of two or more children(query_id, repo_id, dir_path, mean, n) that pass min_score."""
    both = dir_sims.join(children, ["query_id", "repo_id", "dir_path"], "left")
    score = F.col("dir_sim") + F.when(F.col("n") >= 2, s.gamma * F.col("mean")).otherwise(F.lit(0.0))
    return both.select("query_id", "repo_id", "dir_path", score.alias("dir_score"))


def top_n(rows: DataFrame, score: str, n: int, *ties: str) -> DataFrame:
    """The n best of each query with their rank; 0: all of them."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(score, 6)), *ties)))
    return ranked if n == 0 else ranked.filter(F.col("rank") <= n)


#: Vectors of this many numbers together (200 MB), or twice as many floats, are sent to every executor; more are joined by shuffle.
MAX_CELLS = 25_000_000


def few_vectors(rows: DataFrame, column: str, dim: int) -> DataFrame:
    """``rows`` marked for a broadcast if their vectors are few enough; dim: numbers in a row."""
    return small(rows, MAX_CELLS * (1 + (dict(rows.dtypes)[column] == "array<float>")) // dim)


def commit_vectors(file_commits: DataFrame, commits: DataFrame, vectors: DataFrame, dim: int, s: Scoring) -> DataFrame:
    """(file_id, boost array<double>): the decayed sum of the unit vectors of each file's recent commits.

    A query's commit boost of a file is the dot product of its unit vector with this sum.
    """
    recent = file_commits.filter(F.col("recency") <= s.depth).join(commits.select("commit_id", "vec_id"), "commit_id").select("file_id", "vec_id", "recency")
    # vectors that are sent meet links that already lie by file, so that no link carries its vector through a shuffle
    rows = recent.repartition("file_id").join(few_vectors(vectors, "v", dim), "vec_id").withColumn("v", F.col("v").cast("array<double>"))
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    w = rows.select("file_id", (F.pow(F.lit(1 - s.decay), F.col("recency") - 1) / n).alias("w"), "v")
    sums = w.groupBy("file_id").agg(*[F.sum(F.col("w") * F.col("v")[i]).alias(f"c{i}") for i in range(dim)])
    return sums.select("file_id", F.array(*[f"c{i}" for i in range(dim)]).alias("boost"))


def commit_scores(file_commits: DataFrame, commits: DataFrame, asked: list[Asked], vectors: DataFrame, dim: int, s: Scoring) -> DataFrame:
    """(query_id, file_id, commit_boost) of every file that has a recent commit with a usable vector."""
    sums = commit_vectors(file_commits, commits, good_vectors(vectors, dim), dim, s)

    def run(batches, a):
        for b in batches:
            got = matrix_of(b.column("boost"), dim) @ a.units.T
            ids, names = b.column("file_id").take(pa.array(np.repeat(np.arange(len(b)), len(a.names)))), a.names.take(pa.array(np.tile(np.arange(len(a.names)), len(b))))
            yield pa.RecordBatch.from_arrays([names, ids, pa.array(got.ravel())], ["query_id", "file_id", "commit_boost"])

    kind = {pa.int64(): "bigint", pa.int32(): "int"}.get(asked[0].names.type, "string")
    out = None
    for a in asked:
        one = sums.mapInArrow(lambda batches, a=a: run(batches, a), f"query_id {kind}, file_id {dict(sums.dtypes)['file_id']}, commit_boost double")
        out = one if out is None else out.unionByName(one)
    return out


def directory_vectors(directories: DataFrame, vectors: DataFrame) -> DataFrame:
    """(repo_id, dir_path, concat, summary): the vectors of each folder whose concat vector is usable."""
    first = directories.join(vectors.select(F.col("vec_id").alias("concat_vec"), F.col("v").alias("concat")), "concat_vec")
    return first.join(vectors.select(F.col("vec_id").alias("summary_vec"), F.col("v").alias("summary")), "summary_vec", "left").select("repo_id", "dir_path", "concat", "summary")


PARTS = ["sim", "commit_boost", "parent_boost", "length_penalty", "keyword"]


@dataclass(frozen=True)
class FileScorer:
    """Scores batches of files for chunks of queries; top: the largest keyword score of each query, in the order of asked.

    sums: batches come with counted terms, and their keyword scores are added up here; moved: the place in asked of each query of sums.
    """

    asked: list[Asked]
    top: list[np.ndarray]
    dim: int
    sums: _Sums | None = None
    moved: np.ndarray | None = None

    def listed(self, b: pa.RecordBatch):
        """``b``, in parts if it must be, with its keyword scores as lists asks and scores."""
        if self.sums is None:
            yield b
            return
        for part in self.sums.parts(b):
            keep = [c for c in part.schema.names if c not in ("dl", "terms", "counts")]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *self.sums.lists(part, self.moved)], [*keep, "asks", "scores"])

    def raw(self, b: pa.RecordBatch, k: int) -> dict[str, np.ndarray]:
        """sim, commit_boost, folder, log_length and keyword as matrices, a row for each file of the batch and a column for each query of chunk k."""
        units, n = self.asked[k].units, len(b)
        dot = lambda c: unit_rows(matrix_of(b.column(c), self.dim)) @ units.T
        keyword = np.zeros((n, len(units)))
        counts = pc.fill_null(pc.list_value_length(b.column("asks")), 0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n), counts)
        ask_, score = b.column("asks").flatten().to_numpy(zero_copy_only=False), b.column("scores").flatten().to_numpy(zero_copy_only=False)
        at = np.cumsum([0, *[len(a.names) for a in self.asked]])
        own = (ask_ >= at[k]) & (ask_ < at[k + 1])
        place = ask_[own] - at[k]
        keyword[row[own], place] = score[own] / self.top[k][place]
        return {
            "sim": dot("v"), "commit_boost": matrix_of(b.column("boost"), self.dim) @ units.T, "folder": np.maximum(np.maximum(dot("concat"), dot("summary")), 0.0),
            "log_length": np.repeat(b.column("log_length").to_numpy(zero_copy_only=False)[:, None], len(units), axis=1), "keyword": keyword,
        }

    @staticmethod
    def parts(b: pa.RecordBatch, raw: dict[str, np.ndarray], s: Scoring) -> dict[str, np.ndarray]:
        """The PARTS of the scores under the weights ``s``."""
        times = profile_values(b.column("file_type").to_numpy(zero_copy_only=False), 1, s.parent_multiplier)
        parent = np.where(raw["folder"] > s.min_score, raw["folder"] * times[:, None], 0.0)
        return {"sim": raw["sim"], "commit_boost": raw["commit_boost"], "parent_boost": parent, "length_penalty": raw["log_length"] * s.length_weight, "keyword": raw["keyword"]}

    @staticmethod
    def final(b: pa.RecordBatch, parts: dict[str, np.ndarray], s: Scoring) -> np.ndarray:
        beta = profile_values(b.column("file_type").to_numpy(zero_copy_only=False), 0, s.beta)
        semantic = parts["sim"] + s.alpha * parts["commit_boost"] + beta[:, None] * parts["parent_boost"] - parts["length_penalty"]
        return (1 - s.hybrid) * semantic + s.hybrid * parts["keyword"] if s.hybrid > 0 else semantic

    @staticmethod
    def weighed(raw: dict[str, np.ndarray], beta: np.ndarray, times: np.ndarray, s: Scoring) -> np.ndarray:
        """``final`` of any raw parts with the profile values of their files."""
        parent = np.where(raw["folder"] > s.min_score, raw["folder"] * times, 0.0)
        semantic = raw["sim"] + s.alpha * raw["commit_boost"] + beta * parent - raw["log_length"] * s.length_weight
        return (1 - s.hybrid) * semantic + s.hybrid * raw["keyword"] if s.hybrid > 0 else semantic

    def scores(self, b: pa.RecordBatch, k: int, s: Scoring) -> tuple[dict[str, np.ndarray], np.ndarray]:
        parts = self.parts(b, self.raw(b, k), s)
        return parts, self.final(b, parts, s)

    def names(self, k: int, at: np.ndarray) -> pa.Array:
        return self.asked[k].names.take(pa.array(at))


@dataclass(frozen=True)
class FileBatches:
    """The rows that a batch search over files scores, one for each file, with all that its scores need.

    rows(file_id, repo_id, dir_path, file_type, v, boost, concat, summary, log_length) with asks and scores, or with dl, terms and
    counts, which take less room than a score for every query, if the scorer has sums.
    """

    rows: DataFrame
    scorer: FileScorer

    @property
    def asked(self) -> list[Asked]:
        return self.scorer.asked

    def _map(self, run, schema: str) -> DataFrame:
        """run(scorer, batch, chunk, kept) over all batches and chunks of queries; kept: what a task knows so far, a dict of its own."""
        scorer, out = self.scorer, None
        kind = {pa.int64(): "bigint", pa.int32(): "int"}.get(self.asked[0].names.type, "string")
        for k, a in enumerate(self.asked):

            def task(batches, k=k, width=len(a.names)):
                kept: dict = {}
                for b in batches:
                    for some in _slices(b, width):
                        for part in scorer.listed(some):
                            yield from run(scorer, part, k, kept)

            one = self.rows.mapInArrow(task, f"query_id {kind}, {schema}")
            out = one if out is None else out.unionByName(one)
        return out

    def best(self, s: Scoring, n: int) -> DataFrame:
        """(query_id, file_id, repo_id, dir_path, file_type, PARTS, final_score): every pair that passes min_score and can be among a query's n best (0: all)."""
        keys = ["file_id", "repo_id", "dir_path", "file_type"]
        kinds = dict(self.rows.dtypes)

        def run(scorer, b, k, kept):
            parts, score = scorer.scores(b, k, s)
            r, q = np.nonzero(_passing(score, s.min_score, n, kept, None))
            cols = [scorer.names(k, q), *[b.column(c).take(pa.array(r)) for c in keys], *[pa.array(parts[p][r, q]) for p in PARTS], pa.array(score[r, q])]
            yield pa.RecordBatch.from_arrays(cols, ["query_id", *keys, *PARTS, "final_score"])

        return self._map(run, ", ".join([*[f"{c} {kinds[c]}" for c in keys], *[f"{p} double" for p in PARTS], "final_score double"]))

    def sweep(self, configs: list[tuple[str, Scoring]], n: int = 10) -> DataFrame:
        """(config, query_id, file_id, rank): the n best of every query under each configuration, a stated list.

        The raw parts are worked out once for a batch, whatever the number of configurations. Bounds over groups of
        configurations leave few rows that can be among a query's best, and only those are scored for each; what can still
        be among the n best of the task leaves the worker. Ties: the smaller file_id.
        """
        kind = dict(self.rows.dtypes)["file_id"]
        names = pa.array([c for c, _ in configs], pa.string())

        def run(scorer, b, k, kept):
            raw, ext = scorer.raw(b, k), b.column("file_type").to_numpy(zero_copy_only=False)
            values = {(j, x): profile_values(ext, j, x) for _, c in configs for j, x in ((0, c.beta), (1, c.parent_multiplier))}
            at = np.arange(len(scorer.asked[k].names))
            for group, rows in _contenders(raw, values, configs, n, kept):
                pick = np.maximum(rows, 0)
                own = {c: x[pick, at] for c, x in raw.items()}
                for i in group:
                    s = configs[i][1]
                    score = scorer.weighed(own, values[0, s.beta][pick], values[1, s.parent_multiplier][pick], s)
                    score[rows < 0] = -np.inf
                    place, q = np.nonzero(_passing(score, s.min_score, n, kept, i))
                    r = rows[place, q]
                    cols = [scorer.names(k, q), names.take(pa.array(np.full(len(r), i))), b.column("file_id").take(pa.array(r)), pa.array(score[place, q])]
                    yield pa.RecordBatch.from_arrays(cols, ["query_id", "config", "file_id", "final_score"])

        found = self._map(run, f"config string, file_id {kind}, final_score double")
        order = Window.partitionBy("config", "query_id").orderBy(F.desc(F.round("final_score", 6)), "file_id")
        return found.select("config", "query_id", "file_id", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= n)

    def children(self, s: Scoring) -> DataFrame:
        """(query_id, repo_id, dir_path, mean, n): over the files of a folder that pass min_score, added up batch by batch."""
        kinds = dict(self.rows.dtypes)

        def run(scorer, b, k, kept):
            _, score = scorer.scores(b, k, s)
            seen: dict = {}
            code = np.array([seen.setdefault(x, len(seen)) for x in zip(b.column("repo_id").to_pylist(), b.column("dir_path").to_pylist())], np.int64)
            passed = score >= s.min_score
            total, count = np.zeros((len(seen), score.shape[1])), np.zeros((len(seen), score.shape[1]), np.int64)
            np.add.at(total, code, np.where(passed, score, 0.0))
            np.add.at(count, code, passed)
            r, q = np.nonzero(count)
            first = np.zeros(len(seen), np.int64)
            first[code[::-1]] = np.arange(len(code))[::-1]
            at = pa.array(first[r])
            cols = [scorer.names(k, q), b.column("repo_id").take(at), b.column("dir_path").take(at), pa.array(total[r, q]), pa.array(count[r, q])]
            yield pa.RecordBatch.from_arrays(cols, ["query_id", "repo_id", "dir_path", "total", "n"])

        parts = self._map(run, f"repo_id {kinds['repo_id']}, dir_path string, total double, n long")
        return parts.groupBy("query_id", "repo_id", "dir_path").agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"))


def _passing(score: np.ndarray, least: float, n: int, kept: dict, key) -> np.ndarray:
    """What is at ``least`` or above and can be among a column's n largest; scores that round alike tie.

    kept[key]: for each column a score that n rows of the task are known to reach.
    """
    keep = score >= least
    if n and len(score) > n:
        now = np.partition(score, len(score) - n, axis=0)[len(score) - n]
        kept[key] = np.maximum(kept[key], now) if key in kept else now
    return keep & (score >= kept[key][None, :] - 2e-6) if n and key in kept else keep


def _contenders(raw: dict[str, np.ndarray], values: dict, configs: list[tuple[str, Scoring]], n: int, kept: dict):
    """(places of configs, rows): for each group of configurations the rows that can be among a query's n best under any of them.

    rows: a column for each query, filled up with -1. A group has one weight of keywords and one of lengths; the other weights
    bound a score from below and above, and n rows reach the n-th largest lower bound under every configuration of the group.
    """
    groups: dict = {}
    for i, (_, s) in enumerate(configs):
        groups.setdefault((s.hybrid, s.length_weight), []).append(i)
    done: dict = {}
    for (hybrid, weight), group in groups.items():
        own = [configs[i][1] for i in group]
        alphas, folders = frozenset(s.alpha for s in own), frozenset((s.beta, s.parent_multiplier, s.min_score) for s in own)
        if (alphas, folders) not in done:
            done.clear()  # one pair of bounds at a time
            boosts = [a * raw["commit_boost"] for a in (min(alphas), max(alphas))]
            low, high = raw["sim"] + np.minimum(*boosts), raw["sim"] + np.maximum(*boosts)
            least = most = None
            for beta, times, bar in folders:
                x = values[0, beta][:, None] * np.where(raw["folder"] > bar, raw["folder"] * values[1, times][:, None], 0.0)
                least, most = (x, x) if least is None else (np.minimum(least, x), np.maximum(most, x))
            done[alphas, folders] = low + least, high + most
        rest = hybrid * raw["keyword"] - (1 - hybrid) * weight * raw["log_length"]
        low, high = [(1 - hybrid) * x + rest for x in done[alphas, folders]][:: 1 if hybrid <= 1 else -1]
        bar = min(s.min_score for s in own)
        known = np.min([kept[i] for i in group], axis=0) if all(i in kept for i in group) else np.full(low.shape[1], -np.inf)
        if not np.isfinite(known).all() and len(low) > n:
            known = np.maximum(known, np.partition(low, len(low) - n, axis=0)[len(low) - n])
        mask = high >= np.maximum(known - 4e-6, bar - 1e-9)[None, :]
        counts = mask.sum(axis=0)
        if counts.any():
            q, r = np.nonzero(mask.T)
            rows = np.full((counts.max(), len(counts)), -1)
            rows[np.arange(len(q)) - np.repeat(np.cumsum(counts) - counts, counts), q] = r
            yield group, rows


def _slices(b: pa.RecordBatch, width: int, cells: int = 1 << 20) -> list[pa.RecordBatch]:
    step = max(1, cells // max(1, width))
    return [b.slice(at, step) for at in range(0, len(b), step)]


def profile_values(ext: np.ndarray, which: int, default: float) -> np.ndarray:
    """``by_profile`` for an array of extensions."""
    return np.array([default if (v := PROFILES.get(e, (None, None))[which]) is None else v for e in ext], float)


def file_batches(files: DataFrame, directories: DataFrame, commits: DataFrame, file_commits: DataFrame, queries: DataFrame, vectors: DataFrame, dim: int, s: Scoring = Scoring(), index=None) -> FileBatches:
    """Brings together, once for each file, what the scores of any query need; written, so that several results can read it.

    index: a stored ``postings.KeywordIndex`` of the files; with it, no text is cut into words.
    """
    asked = ask(queries, vectors, dim)  # at most MAX_ASKED queries, so what is collected below is bounded too
    good = good_vectors(vectors, dim, floats=True)
    names = [x for a in asked for x in a.names.to_pylist()]
    place = {x: i for i, x in enumerate(names)}
    every = [r["query_id"] for r in queries.select("query_id").distinct().orderBy("query_id").collect()]  # the stated set
    pairs = _asked_terms(queries, 200_000)[1] if index is None else None
    if pairs is not None:
        words, sums = _counted(files, pairs, every)
        peak, own = _highest(words, sums), [F.coalesce("dl", F.lit(0)).alias("dl"), *[F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in ("terms", "counts")]]
    else:
        words, sums, own = stash(keyword_lists(files, queries) if index is None else index.lists(queries), "keyword-lists"), None, ["asks", "scores"]
        peak = {r["ask"]: r["top"] for r in words.select(F.explode(F.arrays_zip(F.col("asks").alias("ask"), F.col("scores").alias("score"))).alias("x")).groupBy("x.ask").agg(F.max("x.score").alias("top")).collect()}
    top = np.array([peak.get(i, 1.0) for i, x in enumerate(every) if x in place])
    moved = np.array([place.get(x, -1) for x in every], np.int64)  # a query without a vector finds nothing
    if sums is None and (moved != np.arange(len(every))).any():
        words = words.withColumn("asks", F.transform("asks", lambda i: F.array(*map(F.lit, moved.tolist()))[i]))
    avg = average_tokens(files)
    base = files.crossJoin(F.broadcast(avg)).select(  # avg: one row
        "file_id", "repo_id", "dir_path", "file_type", "vec_id", length_penalty(F.col("skeleton"), F.col("file_type"), F.col("avg_tokens"), 1.0).alias("log_length")
    )
    # what lies by file comes together first; vectors join last, where they are few enough without a shuffle
    rows = base.join(commit_vectors(file_commits, commits, good, dim, s), "file_id", "left").join(words, "file_id", "left")
    folders = stash(directory_vectors(directories, good), "folder-vectors")
    rows = rows.join(few_vectors(good, "v", dim), "vec_id").join(few_vectors(folders, "concat", 4 * dim), ["repo_id", "dir_path"], "left")
    rows = rows.select("file_id", "repo_id", "dir_path", "file_type", "v", "boost", "concat", "summary", "log_length", *own)
    cuts = np.cumsum([0, *[len(a.names) for a in asked]])
    return FileBatches(spread(stash(rows, "file-batches")), FileScorer(asked, [top[a:b] for a, b in zip(cuts, cuts[1:])], dim, sums, moved))


def folder_scores(directories: DataFrame, batches: FileBatches, vectors: DataFrame, s: Scoring) -> DataFrame:
    """(query_id, repo_id, dir_path, dir_score) of every folder and query, from one matrix product for each batch of folders."""
    return with_children(folder_sims(directories, batches.asked, vectors, batches.scorer.dim), batches.children(s), s)


def folder_sims(directories: DataFrame, asked: list[Asked], vectors: DataFrame, dim: int) -> DataFrame:
    """(query_id, repo_id, dir_path, dir_sim): the larger similarity of both vectors; a missing summary counts as 0."""
    both = directory_vectors(directories, good_vectors(vectors, dim))
    sims = best_pairs(both.select("repo_id", "dir_path", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.col("concat").alias("v")), F.struct(F.lit(False).alias("first"), F.col("summary").alias("v")))).alias("x")).select("repo_id", "dir_path", "x.v"), asked, 1 << 62, dim)
    return sims.groupBy("query_id", "repo_id", "dir_path").agg(F.greatest(F.lit(0.0), F.max("sim")).alias("dir_sim"))


def hybrid_file_search(files, directories, commits, file_commits, queries, vectors, dim: int, s: Scoring = Scoring(), n: int = 10, index=None) -> DataFrame:
    """Batch search over files: one matrix product for each batch of files; a batch's n best for each query leave the worker."""
    batches = file_batches(files, directories, commits, file_commits, queries, vectors, dim, s, index)
    return top_n(batches.best(s, n), "final_score", n, "file_id")


def rerank(results: DataFrame, file_imports: DataFrame, cross_edges: DataFrame, file_commits: DataFrame, s: Scoring = Scoring(), seeds: int = 50, exclude_top: bool = True) -> DataFrame:
    """``results`` (query_id, file_id, final_score, rank) with boosts from import, cross-repository and commit neighbours.

    The ``seeds`` best of a query give; the others get. exclude_top=False lets seeds get as well.
    """
    top = results.filter(F.col("rank") <= seeds).select("query_id", F.col("file_id").alias("seed"))

    def neighbours(edges: DataFrame, a: str, b: str) -> DataFrame:
        e = edges.filter(F.col(b).isNotNull()).select(F.col(a).alias("x"), F.col(b).alias("y")).distinct()
        two = e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y")))
        return top.join(two, top.seed == two.x).select("query_id", F.col("y").alias("file_id")).distinct().withColumn("hit", F.lit(1.0))

    imports = neighbours(file_imports, "source_file_id", "resolved_file_id").withColumnRenamed("hit", "import_hit")
    cross = neighbours(cross_edges, "source_file", "target_file").withColumnRenamed("hit", "cross_hit")
    mine = file_commits.select(F.col("file_id").alias("seed"), "commit_id")
    others = file_commits.select("file_id", "commit_id", "recency")
    # a commit meets its files once for each query, however many seeds it has; a file needs a seed other than itself
    seen = top.join(mine, "seed").groupBy("query_id", "commit_id").agg(F.min("seed").alias("lo"), F.max("seed").alias("hi"))
    shared = seen.join(others, "commit_id").filter("lo <> file_id or hi <> file_id").groupBy("query_id", "file_id").agg(F.min("recency").alias("best"))
    keys = ["query_id", "file_id"]
    rows = results.join(imports, keys, "left").join(cross, keys, "left").join(shared, keys, "left")
    boost = (
        F.coalesce("import_hit", F.lit(0.0)) * s.import_weight + F.coalesce("cross_hit", F.lit(0.0)) * s.cross_repo_weight
        + F.coalesce(F.lit(1.0) / (F.col("best") + 1), F.lit(0.0)) * s.co_change_weight
    )
    gets = F.col("rank") > seeds if exclude_top else F.lit(True)
    return rows.select(*keys, (F.col("final_score") + F.when(gets, boost).otherwise(F.lit(0.0))).alias("final_score"))


def best_entry(entries: DataFrame, words: Column, symbol: Column) -> DataFrame:
    """(key, name, start_line, end_line, match) of the entry that fits the query words best.

    entries(key, pos, name, start_line, end_line). A word equal to the name counts 1, and each word
    that holds or is held by the name counts 0.5; the first of equal ones wins.
    """
    name = F.lower(symbol)
    exact = F.when(F.array_contains(words, name), 1.0).otherwise(0.0)
    part = F.aggregate(words, F.lit(0.0), lambda t, w: t + F.when(F.contains(name, w) | F.contains(w, name), 0.5).otherwise(0.0))
    scored = entries.withColumn("match", exact + part).filter("match > 0")
    order = Window.partitionBy("key").orderBy(F.desc("match"), "pos")
    return scored.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def explain(score: Column, sim: Column, commit: Column, parent: Column, penalty: Column, keyword: Column) -> Column:
    parts = {"score": score, "sim": sim, "commit": commit, "parent": parent, "length": penalty, "keyword": keyword}
    return F.concat_ws(" ", *[F.concat(F.lit(f"{name}="), fixed(x, 3)) for name, x in parts.items()])

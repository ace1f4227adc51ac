"""A stored keyword index: postings in blocks with bounds, and exact best-k searches that leave blocks unread.

Files are numbered by length, so a range of numbers holds files of nearly equal length. The postings of a term
in a range are one block, which also says how many files it has, the largest count of the term and the
shortest file. BM25 grows with the count and falls with the length, so these two bound what any file of the
block can score, whatever the mean length of the index has become since.

A search first adds the bounds of a query's terms by range, from the blocks' small columns alone. The ranges
with the highest bounds are scored and give each query a score that its best k reach for certain; of the other
ranges only those whose bound reaches it are read and scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphquarry.functions.text import code_tokens, plain_tokens
from graphquarry.sources.scratch import small, spread, stash

_KEY = ["segment", "range"]


def _ints(column) -> np.ndarray:
    """The values of a column of lists, one after the other."""
    return pc.list_flatten(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False)


def _lists(ends: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), values)


def _count(batches, names: list[str]):
    """(file_id, dl, terms, tfs) of (file_id, skeleton): a text's terms are counted where it is read.

    terms: as one string with spaces between, as a list of short strings takes three times the shuffle; no term: null.
    """
    for x in batches:
        for at in range(0, len(x), 512):
            part = x.slice(at, 512)
            sizes, ends, terms, tfs = [], [], [], []
            for text in part.column(1):
                counts: dict[str, int] = {}
                tokens = plain_tokens(text.as_py())
                for t in tokens:
                    counts[t] = counts.get(t, 0) + 1
                sizes.append(len(tokens))
                terms.append(" ".join(counts) or None)
                tfs.extend(counts.values())
                ends.append(len(tfs))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), pa.array(terms, pa.string()), _lists(np.array(ends, np.int64), pa.array(tfs, pa.int32()))], names)


def _block(part: pa.RecordBatch, number: int, names: list[str]) -> pa.RecordBatch:
    """The blocks of one range of files(file_id, dl, terms, tfs), by term."""
    part = part.take(pc.sort_indices(part.column("file_id")))
    n = pc.list_value_length(part.column("tfs")).to_numpy(zero_copy_only=False)
    coded = pc.list_flatten(pc.split_pattern(part.column("terms"), " ")).dictionary_encode()
    code, file = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(part)), n)
    order = np.argsort(code, kind="stable")  # files stay in order within a term
    counts = np.bincount(code, minlength=len(coded.dictionary))
    starts = np.cumsum(counts) - counts
    tf, dl = _ints(part.column("tfs"))[order], part.column("dl").to_numpy(zero_copy_only=False)[file[order]]
    ends = np.cumsum(counts)
    most, least = (np.maximum.reduceat(tf, starts), np.minimum.reduceat(dl, starts)) if len(counts) else (tf, dl)
    ids = part.column("file_id").take(pa.array(file[order]))
    cols = [coded.dictionary, pa.array(np.full(len(counts), number, np.int64)), pa.array(counts.astype(np.int32)), pa.array(most), pa.array(least), _lists(ends, ids), _lists(ends, pa.array(tf)), _lists(ends, pa.array(dl))]
    return pa.RecordBatch.from_arrays(cols, names)


def _blocks(batches, size: int, names: list[str]):
    """Every ``size`` files that follow one another become a range; its number is made of the task's and its own."""
    number, held = TaskContext.get().partitionId() << 32, None
    for x in batches:
        held = x if held is None else pa.Table.from_batches([held, x]).combine_chunks().to_batches()[0] if len(held) else x
        while len(held) >= size:
            yield _block(held.slice(0, size), number, names)
            number, held = number + 1, held.slice(size)
    if held is not None and len(held):
        yield _block(held, number, names)


@dataclass(frozen=True)
class _Asked:
    """A stated set of queries as arrays: asks by term (since, n_asks), idf by term; codes(part, term, code), places(ask, query_id)."""

    codes: DataFrame
    places: DataFrame
    width: int
    asks: np.ndarray
    n_asks: np.ndarray
    since: np.ndarray
    idf: np.ndarray


@dataclass(frozen=True)
class KeywordIndex:
    """``path/blocks``, in ``part`` folders by a hash of the term, and ``path/sizes``, a row for each segment.

    A segment is what one ``add`` brought: files, each once, that no other segment holds.
    """

    spark: SparkSession
    path: str
    k1: float = 1.2
    b: float = 0.75
    parts: int = 64
    max_pairs: int = 200_000
    pairs_per_task: int = 1 << 21

    def add(self, files: DataFrame, segment: int = 0, files_per_range: int = 256) -> KeywordIndex:
        """Takes files(file_id, skeleton) in; null skeletons are no documents. A segment that is added again replaces itself."""
        texts = spread(files.filter("skeleton is not null").select("file_id", "skeleton"), "file_id")
        kind, size = dict(files.dtypes)["file_id"], files_per_range
        counted = ["file_id", "dl", "terms", "tfs"]
        docs = stash(texts.mapInArrow(lambda batches: _count(batches, counted), f"file_id {kind}, dl int, terms string, tfs array<int>"), "term-counts")
        pairs = docs.agg(F.coalesce(F.sum(F.size("tfs")), F.lit(0))).first()[0]
        tasks = max(1, -(-pairs // self.pairs_per_task), min(self.spark.sparkContext.defaultParallelism, pairs * 8 // self.pairs_per_task))
        placed = docs.repartitionByRange(tasks, "dl", "file_id").sortWithinPartitions("dl", "file_id")  # the one shuffle
        named = ["term", "range", "n", "max_tf", "min_dl", "ids", "tfs", "dls"]
        blocks = placed.mapInArrow(lambda batches: _blocks(batches, size, named), f"term string, range long, n int, max_tf int, min_dl int, ids array<{kind}>, tfs array<int>, dls array<int>")
        blocks = blocks.withColumn("part", self._part(F.col("term")))  # written where they are built, a file for each task and part
        blocks.sortWithinPartitions("part", "term", "range").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/blocks/segment={segment}")
        sizes = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"))
        sizes.write.mode("overwrite").parquet(f"{self.path}/sizes/segment={segment}")
        return self

    def _part(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.parts)).cast("int")

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def corpus(self) -> tuple[int, float]:
        """(files, mean length) over all segments."""
        r = self.spark.read.parquet(f"{self.path}/sizes").agg(F.sum("n").alias("n"), F.sum("dl").alias("dl")).first()
        return r["n"] or 0, (r["dl"] or 0) / r["n"] if r["n"] else 1.0

    def _terms(self, queries: DataFrame) -> DataFrame:
        terms = queries.select("query_id", F.explode(F.array_distinct(code_tokens(F.col("query")))).alias("term"))
        return stash(terms.distinct().withColumn("part", self._part(F.col("term"))), "asked-terms")

    def _weighted(self, terms: DataFrame, meta: DataFrame, n: int) -> DataFrame:
        """(query_id, part, term, idf) of the terms that the index has."""
        df = meta.groupBy("part", "term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return terms.join(df.select("part", "term", idf.alias("idf")), ["part", "term"])

    def _value(self, tf: Column, dl: Column, mean: float) -> Column:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / mean))

    def _scored(self, wanted: DataFrame, mean: float) -> DataFrame:
        """(query_id, file_id, score) of the blocks of wanted(query_id, idf, part, term, segment, range); for more queries than a task can hold."""
        held = wanted.join(self.blocks.select("part", "term", *_KEY, "ids", "tfs", "dls"), ["part", "term", *_KEY])
        rows = held.select("query_id", "idf", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
        return rows.groupBy("query_id", F.col("p.ids").alias("file_id")).agg(F.sum(F.col("idf") * self._value(F.col("p.tfs"), F.col("p.dls"), mean)).alias("score"))

    def _asked(self, terms: DataFrame, n: int, names: list | None = None) -> _Asked | None:
        """terms(query_id, term, part) as arrays, if they are ``max_pairs`` at most; names: all query ids by place, else those of terms."""
        rows = terms.select("term", "part", "query_id").orderBy("term", "query_id").limit(self.max_pairs + 1).collect()
        if len(rows) > self.max_pairs:
            return None
        names = sorted({r["query_id"] for r in rows}) if names is None else names
        place = {q: i for i, q in enumerate(names)}
        known = {t: i for i, t in enumerate(dict.fromkeys((r["part"], r["term"]) for r in rows))}
        n_asks = np.bincount(np.array([known[r["part"], r["term"]] for r in rows], np.int64), minlength=len(known))
        codes = stash(self.spark.createDataFrame([(p, t, i) for (p, t), i in known.items()], "part int, term string, code int"), "asked-codes")
        df = np.zeros(len(known))
        for r in self.blocks.select("part", "term", "n").join(F.broadcast(codes), ["part", "term"]).groupBy("code").agg(F.sum("n").alias("df")).collect():  # the queries' terms
            df[r["code"]] = r["df"]
        places = self.spark.createDataFrame(list(enumerate(names)), f"ask int, query_id {dict(terms.dtypes)['query_id']}")
        return _Asked(codes, places, max(1, len(names)), np.array([place[r["query_id"]] for r in rows], np.int64), n_asks, np.cumsum(n_asks) - n_asks, np.log(1 + (n - df + 0.5) / (df + 0.5)))

    def _sums(self, a: _Asked, mean: float, wanted: DataFrame | None = None, best: int = 0) -> DataFrame:
        """(file_id, asks, scores): the blocks of a range come together once, whatever the number of queries, and its sums are taken there.

        wanted(query_id, segment, range): only these; best: what can be among a query's ``best`` of the range.
        """
        held = self.blocks.select("part", "term", *_KEY, "ids", "tfs", "dls").join(F.broadcast(a.codes), ["part", "term"]).drop("part", "term")
        kind = dict(held.dtypes)["ids"][6:-1]
        if wanted is not None:
            # a range's own row with the queries that want it; the blocks of ranges that none wants stay
            marks = stash(wanted.join(F.broadcast(a.places), "query_id").groupBy(*_KEY).agg(F.collect_list("ask").alias("tfs")), "wanted-ranges")
            held = held.join(small(marks.select(*_KEY), 1_000_000), _KEY, "left_semi")
            held = held.unionByName(marks.select(*_KEY, F.lit(-1).alias("code"), F.lit(None).cast(f"array<{kind}>").alias("ids"), "tfs", F.lit(None).cast("array<int>").alias("dls")))
        k1, b, width, asks, n_asks, since, idf = self.k1, self.b, a.width, a.asks, a.n_asks, a.since, a.idf
        asked_only = wanted is not None

        def run(table: pa.Table) -> pa.Table:
            code, here = table.column("code").to_numpy(), np.ones(width, bool)
            if asked_only:
                here = np.zeros(width, bool)
                here[_ints(table.filter(pc.equal(table.column("code"), -1)).column("tfs"))] = True
                table = table.filter(pc.greater_equal(table.column("code"), 0))
                code = table.column("code").to_numpy()
            coded = pc.list_flatten(table.column("ids").combine_chunks()).dictionary_encode()
            file, files = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            term, tf, dl = np.repeat(code, pc.list_value_length(table.column("ids")).to_numpy()), _ints(table.column("tfs")), _ints(table.column("dls"))
            value = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / mean))
            total = np.zeros(files * width)
            m = n_asks[term]
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(m) // (1 << 20))) + 1).tolist(), len(m)]
            for lo, hi in zip(cuts, cuts[1:]):
                some, t = m[lo:hi], term[lo:hi]
                row = np.repeat(np.arange(hi - lo), some)
                ask = asks[np.repeat(since[t] - np.cumsum(some) + some, some) + np.arange(len(row))]
                own = here[ask]
                row, ask = row[own], ask[own]
                total += np.bincount(file[lo:hi][row] * width + ask, value[lo:hi][row], minlength=len(total))
            keep = total > 0
            if best and files > best:
                score = total.reshape(files, width)
                keep &= (score >= np.partition(score, files - best, axis=0)[files - best][None, :] - 1e-8).ravel()
            hit = np.flatnonzero(keep)
            ends = np.cumsum(np.bincount(hit // width, minlength=files))
            return pa.table([coded.dictionary, _lists(ends, pa.array((hit % width).astype(np.int32))), _lists(ends, pa.array(total[hit]))], ["file_id", "asks", "scores"])

        sums = held.groupBy(*_KEY).applyInArrow(run, f"file_id {kind}, asks array<int>, scores array<double>")
        return sums.filter(F.size("asks") > 0)

    def _pairs(self, a: _Asked, sums: DataFrame) -> DataFrame:
        """(query_id, file_id, score) of such lists."""
        rows = sums.select("file_id", F.explode(F.arrays_zip("asks", "scores")).alias("x")).select(F.col("x.asks").alias("ask"), "file_id", F.col("x.scores").alias("score"))
        return rows.join(F.broadcast(a.places), "ask").select("query_id", "file_id", "score")

    def _meta(self, terms: DataFrame) -> DataFrame:
        few = terms.select("part", "term").distinct()
        return stash(self.blocks.select("part", "term", *_KEY, "n", "max_tf", "min_dl").join(few, ["part", "term"]), "asked-blocks")

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, file_id, score) of every file that holds a term of the query: the texts aren't read again."""
        terms = self._terms(queries)
        n, mean = self.corpus()
        asked = self._asked(terms, n)
        if asked is not None:
            return self._pairs(asked, self._sums(asked, mean))
        meta = self._meta(terms)
        return self._scored(self._weighted(terms, meta, n).join(meta.select("part", "term", *_KEY), ["part", "term"]), mean)

    def lists(self, queries: DataFrame) -> DataFrame:
        """(file_id, asks, scores), as ``search.keyword_lists`` gives them."""
        names = [r["query_id"] for r in queries.select("query_id").distinct().orderBy("query_id").collect()]  # the stated set
        n, mean = self.corpus()
        asked = self._asked(self._terms(queries), n, names)
        if asked is not None:
            return self._sums(asked, mean)
        places = queries.select("query_id").distinct().withColumn("ask", (F.row_number().over(Window.orderBy("query_id")) - 1).cast("int"))  # the stated set
        both = self.scores(queries).join(places, "query_id").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ask", "score"))).alias("x"))
        return both.select("file_id", F.col("x.ask").alias("asks"), F.col("x.score").alias("scores"))

    def search(self, queries: DataFrame, k: int = 10, first_ranges: int = 4) -> tuple[DataFrame, DataFrame]:
        """((query_id, file_id, score, rank) of the k best of queries(query_id, query), (query_id, blocks, unread)).

        Exactly what the k highest scores of all files are; scores that agree in nine places rank by file_id.
        unread: how many blocks of the query's terms weren't needed.
        """
        terms = self._terms(queries)
        meta = self._meta(terms)
        n, mean = self.corpus()
        asked = self._weighted(terms, meta, n).join(meta, ["part", "term"])
        asked = stash(asked.withColumn("bound", F.col("idf") * self._value(F.col("max_tf"), F.col("min_dl"), mean)).drop("max_tf", "min_dl"), "asked-bounds")
        bounds = asked.groupBy("query_id", *_KEY).agg(F.sum("bound").alias("bound"), F.count("*").alias("blocks"), F.max("n").alias("files"))
        best_first = Window.partitionBy("query_id").orderBy(F.desc("bound"), *_KEY)
        bounds = stash(bounds, "range-bounds")
        # a range has at least as many files as its longest block: enough ranges for k scores, if there are so many
        before = F.coalesce(F.sum("files").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = bounds.withColumn("i", F.row_number().over(best_first)).withColumn("before", before).filter((F.col("i") <= first_ranges) | (F.col("before") < k)).select("query_id", *_KEY)
        first = stash(first, "first-ranges")
        few = self._asked(terms, n)
        scored = lambda ranges: self._scored(asked.join(ranges, ["query_id", *_KEY]), mean) if few is None else self._pairs(few, self._sums(few, mean, ranges, k))
        seed = stash(scored(first), "first-scores")
        by_score = Window.partitionBy("query_id").orderBy(F.desc("score"))
        reached = seed.withColumn("i", F.row_number().over(by_score)).filter(F.col("i") == k).select("query_id", F.col("score").alias("reached"))
        rest = bounds.join(first, ["query_id", *_KEY], "left_anti").join(reached, "query_id", "left")
        rest = stash(rest.filter(F.col("reached").isNull() | (F.col("bound") >= F.col("reached") - 1e-8)).select("query_id", *_KEY), "open-ranges")
        every = seed.unionByName(scored(rest))
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "file_id")
        top = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        read = bounds.join(first.unionByName(rest).withColumn("read", F.lit(True)), ["query_id", *_KEY], "left")
        report = read.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.coalesce(F.sum(F.when(F.col("read").isNull(), F.col("blocks"))), F.lit(0)).alias("unread"))
        return top.select("query_id", "file_id", "score", "rank"), report

"""A stored index of three-character grams for substring searches.

A text that holds a pattern holds all of its grams, so a search intersects the posting lists of the pattern's
rarest grams, block by block, and looks only at the texts that remain. Every hit is checked on its text.
Patterns that offer no gram are looked for in all texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphquarry.sources.scratch import spread, stash


def grams(text: Column) -> Column:
    """The distinct grams of a text in lower case; fewer than three characters: none. Linear in the text."""
    c = F.filter(F.split(F.lower(text), ""), lambda x: x != "")
    three = F.zip_with(F.slice(c, 2, F.size(c)), F.slice(c, 3, F.size(c)), lambda y, z: F.concat(y, z))
    return F.array_distinct(F.filter(F.zip_with(c, three, lambda x, yz: F.concat(x, yz)), lambda g: g.isNotNull()))


def sure_grams(pattern: Column, fold: Column) -> Column:
    """The grams that every text with the pattern has. Lower case depends on what surrounds a letter for some letters beyond
    ASCII, so without ``fold``, where the texts are searched as they are, only grams within ASCII count."""
    return F.filter(grams(pattern), lambda g: fold | (F.octet_length(g) == F.length(g)))


def holds(text: Column, pattern: Column, fold: Column) -> Column:
    return F.when(fold, F.contains(F.lower(text), F.lower(pattern))).otherwise(F.contains(text, pattern))


def gram_codes(text: str) -> np.ndarray:
    """The distinct grams of a text that is in lower case, 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    codes.sort()  # np.unique hashes, which takes twice the time here
    return codes[_firsts(codes)]


def _firsts(codes: np.ndarray) -> np.ndarray:
    """Marks the first of equal values of sorted codes."""
    first = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=first[1:])
    return first


def _gram_names(codes: np.ndarray) -> list[str]:
    three = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype("<u4")
    text = three.tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + 3] for i in range(0, len(text), 3)]


def _gram_lists(batches, most: int, names: list[str], chars: int = 1 << 23):
    """(gram, block, n, ids, members) of (id, text in lower case, as bytes): texts that follow one another are a block, ``most`` at most and about so many
    characters. ids: numbers of texts within the block, 2 bytes each; members: all ids of the block, in the row of the empty gram."""
    number = TaskContext.get().partitionId() << 32
    ids, found, size, kind = [], [], 0, None

    def block():
        row = np.repeat(np.arange(len(ids), dtype=np.int16), [len(c) for c in found])
        codes = np.concatenate(found)
        order = np.argsort(codes, kind="stable")
        codes, row = codes[order], row[order]
        starts = np.flatnonzero(_firsts(codes))
        for names_, row_, starts_, members in (([""], np.arange(len(ids), dtype=np.int16), np.zeros(1, np.int64), [ids]), (_gram_names(codes[starts]), row, starts, [None] * len(starts))):
            ends = np.append(starts_, len(row_)).astype(np.int32)
            cols = [pa.array(names_, pa.string()), pa.array(np.full(len(names_), number, np.int64)), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(row_)), pa.array(members, pa.list_(kind))]
            yield pa.RecordBatch.from_arrays(cols, names)

    for x in batches:
        kind = x.column(0).type
        for at in pc.sort_indices(x.column(0)).to_pylist():
            text = x.column(1)[at].as_py().decode("utf-8", "replace")
            ids.append(x.column(0)[at].as_py())
            found.append(gram_codes(text))
            size += len(text)
            if len(ids) >= most or size >= chars:
                yield from block()
                number, size = number + 1, 0
                ids.clear()
                found.clear()
    if ids:
        yield from block()


@dataclass(frozen=True)
class SubstringIndex:
    """``path/postings``, in ``part`` folders by a hash of the gram: the texts that have it, a list for each block of texts that numbers them within the block.
    The empty gram, that of every text, has the ids behind the numbers; its rows are dealt over the folders by block."""

    spark: SparkSession
    path: str
    parts: int = 64

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def add(self, rows: DataFrame, segment: int = 0, ids_per_block: int = 4096) -> SubstringIndex:
        """Takes rows(id, text) in, each id once over all segments; null texts hold nothing. A segment that is added again replaces itself."""
        texts = spread(rows.filter("text is not null").select("id", F.lower("text").cast("binary").alias("text")))
        named, kind = ["gram", "block", "n", "ids", "members"], dict(rows.dtypes)["id"]
        most = min(ids_per_block, 1 << 15)  # numbers of 2 bytes
        lists = texts.mapInArrow(lambda batches: _gram_lists(batches, most, named), f"gram string, block long, n int, ids array<smallint>, members array<{kind}>")
        part = F.when(F.col("gram") == "", self._part(F.col("block"))).otherwise(self._part(F.col("gram")))
        lists = lists.withColumn("part", part).hint("rebalance", "part").sortWithinPartitions("part", "gram", "block")
        lists.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/postings/segment={segment}")
        return self

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def candidates(self, patterns: DataFrame, rarest: int = 4) -> DataFrame:
        """(pattern_id, id) of patterns(pattern_id, pattern, fold) that offer a gram: the texts that have its ``rarest`` grams."""
        asked = patterns.select("pattern_id", F.explode(sure_grams(F.col("pattern"), F.col("fold"))).alias("gram"))
        asked = stash(asked.withColumn("part", self._part(F.col("gram"))), "asked-grams")
        few = asked.select("part", "gram").distinct()
        df = self.postings.select("part", "gram", "n").join(few, ["part", "gram"]).groupBy("part", "gram").agg(F.sum("n").alias("df"))
        rare = Window.partitionBy("pattern_id").orderBy(F.coalesce("df", F.lit(0)), "gram")  # the grams of one pattern
        chosen = asked.join(df, ["part", "gram"], "left").withColumn("i", F.row_number().over(rare)).filter(F.col("i") <= rarest)
        chosen = chosen.withColumn("of", F.count("*").over(Window.partitionBy("pattern_id"))).select("pattern_id", "part", "gram", "of")
        held = self.postings.select("part", "gram", "segment", "block", "ids").join(stash(chosen, "rarest-grams"), ["part", "gram"])
        met = held.groupBy("pattern_id", "of", "segment", "block").agg(F.collect_list("ids").alias("lists")).filter(F.size("lists") == F.col("of"))
        common = F.aggregate(F.slice(F.col("lists"), F.lit(2), F.size("lists")), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
        members = self.postings.filter("gram = ''").select("segment", "block", "members")
        met = met.select("pattern_id", "segment", "block", common.alias("common")).join(members, ["segment", "block"])
        return met.select("pattern_id", F.explode(F.transform("common", lambda i: F.get("members", i.cast("int")))).alias("id"))

    def search(self, rows: DataFrame, patterns: DataFrame) -> DataFrame:
        """(pattern_id, id) of the rows(id, text) that hold patterns(pattern_id, pattern, fold) as they are; fold: in any case.

        ``rows``: what was added. An empty pattern is in every text that isn't null. The patterns are a stated set.
        """
        patterns = stash(patterns.select("pattern_id", "pattern", "fold").filter("pattern is not null"), "patterns")
        found = self.candidates(patterns).join(patterns, "pattern_id")
        checked = rows.select("id", "text").join(found, "id").filter(holds(F.col("text"), F.col("pattern"), F.col("fold"))).select("pattern_id", "id")
        short = patterns.filter(F.size(sure_grams(F.col("pattern"), F.col("fold"))) == 0)
        if short.isEmpty():
            return checked
        # each text meets the patterns that offer no gram, as one list
        whole = short.agg(F.collect_list(F.struct("pattern_id", "pattern", "fold")).alias("asked"))  # one row, of the stated set
        rest = rows.filter("text is not null").crossJoin(F.broadcast(whole)).select("id", F.explode(F.filter("asked", lambda a: holds(F.col("text"), a["pattern"], a["fold"]))).alias("a"))
        return checked.unionByName(rest.select("a.pattern_id", "id"))

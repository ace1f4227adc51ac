"""Minimax contiguous sharding of groups of equal texts.

The groups are ordered by a 63-bit hash of their text, so a range of hashes is a range of groups
and needs no sort. The smallest feasible capacity is found by binary search with a greedy check.
The check doesn't need all groups: the driver holds a summary of bounded size, hash ranges with
their byte sum, largest group and count. The greedy walk over it gives a lower and an upper bound
for each cut; the ranges in which a cut may fall are split further by one aggregation, until the
bounds meet. The cuts then stay within that capacity and share out the room that it leaves: each is
the one next to an even division of the rest that the greedy walk from the other end allows. A group
above the fair share is a shard by itself, at the front of the order, and the others are divided
over the remaining shards.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

KEY_BITS = 63
FIRST_SPLIT = 12
MAX_ROWS = 1 << 16


class Ranges:
    """Consecutive hash ranges (low, bits, sum, largest, groups) in order; empty ones are left out."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        self.rows = sorted(rows)
        self.before = [0, *accumulate(r[2] for r in self.rows)]
        self.total = self.before[-1]

    def walk(self, capacity: int, shards: int, high: bool) -> tuple[list[int], bool]:
        """Bytes before each cut of the greedy walk, and whether all fits.

        high: an upper bound for each cut, else a lower one; both are exact where the cut falls
        into a range of one group. The walk leaves less room than the group that didn't fit.
        """
        at, cuts = 0, []
        for _ in range(shards):
            limit = at + capacity
            if limit >= self.total:
                return cuts, True
            i = bisect.bisect_right(self.before, limit) - 1
            if self.rows[i][4] == 1 or self.before[i] == limit:
                new = self.before[i]
            else:
                new = limit if high else max(self.before[i], limit - self.rows[i][3] + 1)
            if new <= at:
                break
            at = new
            cuts.append(at)
        return cuts, False

    def least(self, shards: int, high: bool) -> int:
        """The smallest capacity with which the walk fits."""
        lo, hi = max(-(-self.total // shards), max(r[3] for r in self.rows)), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            if self.walk(mid, shards, high)[1]:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def undecided(self, shards: int) -> tuple[int, list[int]]:
        """(capacity, ranges that must be split before the cuts are certain)."""
        some, all_ = self.least(shards, True), self.least(shards, False)
        low, high = self.walk(some, shards, False)[0], self.walk(all_, shards, True)[0]
        found: set[int] = set()
        for k in range(max(len(low), len(high))):
            a = low[k] if k < len(low) else low[-1] if low else 0
            b = high[k] if k < len(high) else self.total
            first = bisect.bisect_right(self.before, min(a, b)) - 1
            last = bisect.bisect_left(self.before, b)
            found.update(j for j in range(first, min(last, len(self.rows))) if self.rows[j][4] > 1 and self.before[j] < b)
        if some == all_ and set(high) <= set(self.before):
            return some, []
        return some, sorted(found)

    def earliest(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """The smallest place that each cut can have if all shards after it are to fit, and ranges that must be split to be sure."""
        at, cuts, split = self.total, [], set()
        for _ in range(shards - 1):
            limit = max(0, at - capacity)
            i = bisect.bisect_left(self.before, limit)
            if self.before[i] == limit or self.rows[i - 1][4] == 1:
                at = self.before[i]
            else:
                split.add(i - 1)
                at = limit
            cuts.append(at)
        return cuts[::-1], split

    def even(self, capacity: int, shards: int, earliest: list[int]) -> tuple[list[int], set[int]]:
        """Cuts near an even division of what is left, none before ``earliest`` or beyond the capacity; and ranges to split first."""
        at, cuts, split = 0, [], set()
        for k in range(shards - 1):
            goal = at - (at - self.total) // (shards - k)
            if goal >= self.total:
                break
            i = bisect.bisect_right(self.before, goal) - 1
            if self.rows[i][4] == 1 or self.before[i] == goal:
                low, high = self.before[i], self.before[i + 1] if self.before[i] < goal else goal
                near = low if low > at and (goal - low <= high - goal or high - at > capacity) else high
                at = max(near, earliest[k])
            else:
                split.add(i)
                at = max(goal, earliest[k])
            if at >= self.total:
                break
            cuts.append(at)
        return cuts, split


def _summary(atoms: DataFrame, bits: int) -> list[tuple[int, int, int, int, int]]:
    """The non-empty ranges of 2**bits hashes."""
    got = atoms.groupBy(F.shiftright("key", bits).alias("at")).agg(F.sum("w").alias("w"), F.max("w").alias("m"), F.count("*").alias("n"))
    return [(r["at"] << bits, bits, r["w"], r["m"], r["n"]) for r in got.collect()]


def _split(atoms: DataFrame, rows: list) -> list:
    """``rows`` in parts, MAX_ROWS in all at most: by one join and aggregation for each width among them."""
    parts = max(1, (MAX_ROWS // len(rows)).bit_length() - 1)
    out = []
    for bits in sorted({r[1] for r in rows}):
        lows = ",".join(f"{r[0] >> bits}L" for r in rows if r[1] == bits)
        some = F.broadcast(atoms.sparkSession.sql(f"SELECT explode(array({lows})) AS at"))  # MAX_ROWS / 2 numbers at most
        out += _summary(atoms.join(some, F.shiftright("key", bits) == F.col("at")).select("key", "w"), max(0, bits - parts))
    return out


def minimax_cuts(atoms: DataFrame, shards: int) -> list[int]:
    """The lowest key of every shard after the first; atoms(key, w): distinct keys of KEY_BITS bits, w > 0."""
    rows = _summary(atoms, KEY_BITS - FIRST_SPLIT)
    if not rows or shards <= 1:
        return []
    capacity = 0
    while True:
        ranges = Ranges(rows)
        if not capacity:
            found, split = ranges.undecided(shards)
            capacity = 0 if split else found
        if capacity:
            first, split = ranges.earliest(capacity, shards)
            if not split:
                cuts, split = ranges.even(capacity, shards, first)
            if not split:
                at = {b: r[0] for b, r in zip(ranges.before, ranges.rows)}
                return [at[b] for b in cuts]
        split = sorted(split)[: MAX_ROWS // 2]
        gone = set(split)
        rows = [r for j, r in enumerate(ranges.rows) if j not in gone] + _split(atoms, [ranges.rows[j] for j in split])


def giants(largest: list[tuple[int, int]], total: int, shards: int) -> list[int]:
    """Keys of the groups above the fair share of what is left; largest: (key, w) by falling w."""
    out = []
    for key, w in largest:
        if shards - len(out) < 2 or w * (shards - len(out)) <= total:
            break
        out.append(key)
        total -= w
    return out


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text", piece_rows: int = 50_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row for each row of ``docs``.

    Law: bytes. size: the UTF-8 bytes of the text (null: none) plus ``overhead``. Equal texts share
    a shard (null texts with empty ones), so no shard is larger than the larger of the minimax
    capacity and the largest group. slot: 0, 1, ... within each shard, by a hash of the row's place, so a
    hot group's rows, repeated ones too, are numbered in many tasks, about ``piece_rows`` rows each. Repeated rows and
    null doc_ids are rows as any other; extra columns are ignored; an empty table gives no rows;
    shards beyond the number of groups stay empty. Two texts whose 63-bit hashes collide count as
    one group.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64(text), 1).alias("key"), F.monotonically_increasing_id().alias("_row"),
    )
    facts = stash(facts, "sizes")
    atoms = stash(facts.groupBy("key").agg(F.sum("size").alias("w")), "atoms")
    total = atoms.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    largest = [(r["key"], r["w"]) for r in atoms.orderBy(F.desc("w"), "key").limit(shards).collect()]
    alone = giants(largest, total, shards)
    cuts = minimax_cuts(atoms.filter(~F.col("key").isin(alone)) if alone else atoms, shards - len(alone))
    shard = F.lit(len(alone))
    for c in cuts:
        shard = shard + (F.col("key") >= F.lit(c)).cast("int")
    for k, key in enumerate(alone):
        shard = F.when(F.col("key") == F.lit(key), F.lit(k)).otherwise(shard)
    placed = facts.withColumn("shard", shard.cast("int"))
    pieces = max(32, -(-facts.count() // (shards * piece_rows)))
    placed = placed.withColumn("_piece", F.pmod(F.xxhash64("_row"), F.lit(pieces)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    units = placed.groupBy("shard", "_piece").agg(F.count("*").alias("_n"))
    units = units.withColumn("_since", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy("shard", "_piece").orderBy("doc_id", "_row")
    numbered = placed.join(units, ["shard", "_piece"]).withColumn("slot", F.col("_since") + F.row_number().over(own) - 1)
    return numbered.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op2(spark, sf_dir: str) -> DataFrame:
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

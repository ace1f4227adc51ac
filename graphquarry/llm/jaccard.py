"""Near copies of documents: SimHash pivot tables, widened to a similarity of five-word shingles.

Two documents are linked if the Jaccard similarity of their sets of shingles is 0.8 or more. The
pivot tables of ``simhash`` give the pairs whose fingerprints differ in two bits or fewer. Pairs at
0.8 differ in 9 bits of 64 on average and in 18 at most here; pivot tables for so wide a radius have
keys too short to tell documents apart. So what lies beyond the radius is sought by MinHash: BANDS
bands of ROWS minima, and a pair at similarity s shares a band with probability
1 - (1 - s^ROWS)^BANDS, which is 0.999997 at 0.8 and more above. Every candidate is verified on its
whole set, so nothing below 0.8 is linked.

Equal sets are one node, so copies never pair up. In a bucket all are first compared with one member,
the one with the fewest shingles that no other set has, so a large group of near copies is joined in
linear time. What is left are buckets that hold several components; pairs across these are sought by
an exact prefix join: with a set's shingles in order of their rarity, two sets can share ``least`` of
them only if they share one among the first ``size - least + 1`` of both. Sets that lack a link
mostly have their own rare shingles there and meet nobody. Sets with the same shared shingles and the
same size, as texts that are put together from the same paragraphs have, are as similar to any third
set as each other, so one stands for all of them there: what it is linked to, they are. A shingle that
more than SPLIT of these sets have is split by bucket: two sets meet in it only if they share a bucket
too, as every pair that is sought does. No bucket and no pair is left out.

What is aggregated for a key is written before it is joined back: a small table can then be sent to
every task, and a join of two plain exchanges can split a key that many sets share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import MAX_NAMES, arrow_limits, keep_rows, settle, small, spread, stash, text_hash
from .components import connected_components
from .simhash import groups_for, majority, pivot_links, shingle_hashes

SHINGLE, BANDS, ROWS = 5, 24, 4
#: A shingle that more sets have in their prefixes is split by their buckets.
SPLIT = 32
_rng = np.random.default_rng(42)
_MULTIPLY = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def band_keys(hashes: np.ndarray) -> list[int]:
    """The bucket of a set in each band, as signed longs."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for at in range(0, len(h), 2048):
        part = h[at : at + 2048]
        np.minimum(least, (part[None, :] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=least)
    bands = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(bands, np.uint64).view(np.int64).tolist()


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, check, fp, size, keys): one row for each row of ``docs``; node names the set of shingles, with check by 128 bits."""
    arrow_limits(docs.sparkSession)
    fields = [
        ("doc_id", docs.schema["doc_id"].dataType), ("text_hash", T.LongType()), ("node", T.LongType()), ("check", T.LongType()), ("fp", T.LongType()),
        ("size", T.IntegerType()), ("keys", T.ArrayType(T.LongType())),
    ]

    def run(batches):
        for b in batches:
            node, check, fp, size, keys = [], [], [], [], []
            for t in b.column(2).to_pylist():
                every = shingle_hashes(t, SHINGLE)
                own = np.unique(every)
                node.append(xxhash.xxh64_intdigest(own.tobytes(), 7))
                check.append(xxhash.xxh3_64_intdigest(own.tobytes(), 8))
                fp.append(majority(every))
                size.append(len(own))
                keys.append(band_keys(own) if len(own) else [])
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            cols = [b.column(0), b.column(1), long(node), long(check), long(fp), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, [f for f, _ in fields])
        settle()

    return spread(docs.select("doc_id", text_hash().alias("text_hash"), "text"), "doc_id").mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes array<long>) of wanted(node, rep struct<none, doc_id, text_hash>): one row for each."""
    arrow_limits(docs.sparkSession)
    asked = wanted.select("node", F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_hash"))
    asked = small(asked, MAX_NAMES)
    rows = docs.select("doc_id", text_hash().alias("text_hash"), "text")
    rows = rows.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("node", "text").dropDuplicates(["node"])

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, SHINGLE)) for t in b.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64))).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["node", "hashes"])
        settle()

    return rows.mapInArrow(run, "node long, hashes array<long>")


def _pairs(a, b):
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def _may_reach(n, m):
    """Sets of such sizes can reach 0.8."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs(u, v) whose sets reach a similarity of 0.8."""
    left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", shared.alias("n"), (F.size("a") + F.size("b")).alias("total"))
    return both.filter(5 * F.col("n") >= 4 * (F.col("total") - F.col("n"))).select("u", "v")


def _seeds(nodes: DataFrame) -> DataFrame:
    """(u, v): nodes whose fingerprints are equal or linked by the pivot tables."""
    of = stash(nodes.groupBy("fp").agg(F.min("node").alias("m")), "prints-of-nodes")
    near = pivot_links(of.select("fp"), groups_for(of.count()))
    a, b = of.select(F.col("fp").alias("u"), F.col("m").alias("x")), of.select(F.col("fp").alias("v"), F.col("m").alias("y"))
    across = near.distinct().join(a, "u").join(b, "v").select(*_pairs(F.col("x"), F.col("y")))
    equal = nodes.join(of, "fp").filter("node <> m").select(*_pairs(F.col("m"), F.col("node")))
    return across.unionByName(equal).filter("u <> v").distinct()


def _prefixes(sets: DataFrame) -> DataFrame:
    """(node, size, core, h1, h2, at, token): the shingles by which a set can still be found, in order of their rarity.

    core: how many of its shingles another set has too, and h1 and h2 name these by 128 bits; a set with fewer than four fifths
    of its shingles there can't be linked and has no row. at: the place in the order, in which those that no other set has
    come first.
    """
    tokens = sets.select("node", F.size("hashes").alias("size"), F.explode("hashes").alias("token"))
    many = stash(tokens.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1"), "shared-shingles")
    own = Window.partitionBy("node")
    placed = tokens.join(many, "token").withColumn("core", F.count("*").over(own)).withColumn("i", F.row_number().over(own.orderBy("n", "token")))
    placed = placed.withColumn("h1", F.bit_xor(F.xxhash64("token")).over(own)).withColumn("h2", F.bit_xor(F.xxhash64(F.lit(1), "token")).over(own))
    placed = placed.select("node", "size", F.col("core").cast("int").alias("core"), "h1", "h2", (F.col("size") - F.col("core") + F.col("i") - 1).cast("int").alias("at"), "token")
    return placed.filter(F.expr("at <= size div 5"))


def _twins(alive: DataFrame) -> DataFrame:
    """(node, rep, alike) of alive(node, size, core, h1, h2): sets that agree in all but the node, but for the smallest, which stands for
    them; alike: whether they are linked among themselves."""
    same = ["size", "core", "h1", "h2"]
    reps = stash(alive.groupBy(*same).agg(F.min("node").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n"), "like-sets")
    return alive.join(reps, same).filter("node <> rep").select("node", "rep", F.expr("9 * core >= 8 * size").alias("alike"))


def _heads(rest: DataFrame, buckets: DataFrame, prefixes: DataFrame, split: int = SPLIT) -> DataFrame:
    """(node, root, size, at, token): the prefixes of rest(node, root); a token that more than ``split`` of these have is one for each
    of a node's buckets(node, key) instead."""
    heads = stash(prefixes.join(rest, "node").select("node", "root", "size", "at", "token"), "open-prefixes")
    many = stash(heads.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > split).select("token"), "frequent-prefixes")
    if many.isEmpty():
        return heads
    few = heads.join(many, "token", "left_anti").select("node", "root", "size", "at", "token")
    parts = heads.join(many, "token").join(buckets, "node").select("node", "root", "size", "at", F.xxhash64("token", "key").alias("token"))
    return stash(few.unionByName(parts), "split-prefixes")


def _across(rest: DataFrame, buckets: DataFrame, prefixes: DataFrame, split: int = SPLIT) -> DataFrame:
    """(u, v): the pairs of rest(node, root) in different components that the prefix join leaves."""
    heads = _heads(rest, buckets, prefixes, split)
    counts = heads.groupBy("token", "root").agg(F.count("*").alias("n"))
    major = stash(counts.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.count("*").alias("roots")).filter("roots > 1"), "mixed-shingles")
    few = heads.join(major, "token").filter("root <> major")
    few = few.select(F.col("token").alias("tok"), F.col("node").alias("w"), F.col("root").alias("other"), F.col("size").alias("m"), F.col("at").alias("place"))
    least = F.expr("(4 * (size + m) + 8) div 9")
    meet = (F.col("root") != F.col("other")) & _may_reach(F.col("size"), F.col("m")) & (F.col("at") <= F.col("size") - least) & (F.col("place") <= F.col("m") - least)
    both = heads.join(few, (F.col("token") == F.col("tok")) & meet)
    return both.select(*_pairs(F.col("node"), F.col("w"))).distinct()


def components(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root): the components of linked nodes; single nodes and roots may be missing. nodes: written, one row for each set."""
    seeds = stash(_seeds(nodes), "seeds")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = stash(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared-buckets")
    held = stash(keyed.join(shared, "key"), "buckets-of-sets")
    met = held.select("node").union(seeds.select("u")).union(seeds.select("v")).distinct()
    sets = stash(sets_of(docs, nodes.select("node", "rep").join(met, "node", "left_semi")), "sets")
    prefixes = stash(_prefixes(sets), "prefixes")
    alive = stash(prefixes.select("node", "size", "core", "h1", "h2").distinct(), "open-nodes")
    held = stash(held.join(alive.select("node", "size", "core"), "node"), "open-buckets")
    order = F.struct((F.col("size") - F.col("core")) / F.col("size"), F.xxhash64("node"))
    first = stash(held.groupBy("key").agg(F.min_by(F.struct("node", "size", "core"), order).alias("c")), "centres")
    may = _may_reach(F.col("c.size"), F.col("size")) & (9 * F.least(F.col("c.core"), F.col("core")) >= 4 * (F.col("c.size") + F.col("size")))
    stars = held.join(first, "key").filter((F.col("c.node") != F.col("node")) & may).select(*_pairs(F.col("c.node"), F.col("node")))
    found = stash(_similar(seeds.unionByName(stars).distinct(), sets), "similar")
    roots = stash(connected_components(found), "roots")
    rooted = held.select("node", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    mixed = stash(mixed, "mixed-buckets")
    twins = stash(_twins(alive), "twins")
    standing = twins.select(F.col("node").alias("_node"), "rep")
    rest = rooted.join(mixed, "key", "left_semi").join(standing, F.col("node") == F.col("_node"), "left")
    rest = stash(rest.select(F.coalesce("rep", "node").alias("node"), "key").distinct(), "open-sets")
    open_nodes = rest.select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    more = stash(_similar(_across(open_nodes, rest, prefixes), sets), "similar-across")
    # sets that agree are one component if they are alike, or if any of them is linked to something else
    linked = found.unionByName(more).select(F.explode(F.array("u", "v")).alias("node")).distinct()
    of = twins.select("node", "rep").unionByName(twins.select(F.col("rep").alias("node"), "rep")).distinct()
    held_by = of.join(linked, "node", "left_semi").select("rep").distinct().withColumn("linked", F.lit(True))
    joined = stash(twins.join(held_by, "rep", "left").filter("alike or linked").select(*_pairs(F.col("node"), F.col("rep"))), "linked-twins")
    if more.isEmpty() and joined.isEmpty():
        return roots
    return connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more).unionByName(joined))


def _nodes(found: DataFrame) -> DataFrame:
    """(node, rep, fp, size, keys, lo, hi): one row for each name of a set; lo < hi: different sets have that name."""
    rep = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    return found.groupBy("node").agg(
        F.min(rep).alias("rep"), F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.min("check").alias("lo"), F.max("check").alias("hi")
    )


def _named(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``found``, as ``prints`` gives it, and its nodes, with names that no two sets share: where 64 bits agree and the other 64 don't, one set is renamed."""
    while True:
        nodes = stash(_nodes(found), "nodes-of-sets")
        clash = nodes.filter("lo <> hi").select(F.col("node").alias("_node"), "lo")
        if clash.isEmpty():
            return found, nodes
        both = found.join(small(clash, MAX_NAMES), F.col("node") == F.col("_node"), "left")
        node = F.when(F.col("check") != F.col("lo"), F.xxhash64("node", "check")).otherwise(F.col("node"))
        found = stash(both.withColumn("node", node).select(*found.columns), "shingle-prints")


def _rooted(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """prints(docs), and (node, best) with the row that stands for the node's component."""
    found, nodes = _named(stash(prints(docs), "shingle-prints"))
    linked = nodes.select("node", "rep").join(components(docs, nodes), "node", "left")
    linked = stash(linked.select("node", "rep", F.coalesce("root", "node").alias("root")), "set-roots")
    best = linked.groupBy("root").agg(F.min("rep").alias("best"))
    return found, linked.join(best, "root").select("node", "best")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id): one row for each row of ``docs``; component_id: the smallest doc_id reachable over links.

    Null and empty texts and texts of white space have the same, empty set. Rows with a null doc_id
    keep it and name a component only if all its ids are null.
    """
    found, best = _rooted(docs)
    return found.select("doc_id", "node").join(best, "node").select("doc_id", F.col("best.doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id.

    A null doc_id comes after all others. Of different texts that share the smallest doc_id, one stays;
    so does one of rows that are repeated. Texts that share a doc_id but no component are judged apart.
    """
    found, best = _rooted(docs)
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    return keep_rows(docs, found.select("doc_id", "text_hash", "node").join(best, "node").select("doc_id", "text_hash", same.alias("stays")))

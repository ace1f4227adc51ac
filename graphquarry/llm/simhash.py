"""SimHash near-duplicates with pivot distance tables.

Every distinct fingerprint gets a row of Hamming distances to reference fingerprints (pivots).
One pivot is the base; each other table pivot is the base with a block of two adjacent bits
flipped, so (d(x, base) - d(x, pivot) + 2) / 2 is how far x is from the base inside that block.
The blocks are disjoint: fingerprints at distance r or less differ in r of these coordinates at
most. With the blocks dealt to g groups, some g - r groups hold no difference at all, so pairs
are sought among fingerprints whose coordinates have maximum difference zero over g - r groups.
Inside such a bucket further pivots, scattered at random, discard pairs whose maximum coordinate
difference exceeds r (the triangle inequality), and the survivors are verified bit by bit.

Equal fingerprints are one node, so copies never pair up. A bucket above ``bucket_cap`` takes an
exact way without pairs: two fingerprints are at distance 2 or less if and only if a common
fingerprint is at distance 1 or less from both, so each emits itself and its 64 neighbours, and
groups of equal values (65 members at most) are linked as stars.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, settle, shuffle_parts, spread, stash
from .components import connected_components

BITS, BLOCK, RADIUS = 64, 2, 2
_LOWER = bytes(range(256)).lower()


def _mix(i: int) -> int:
    """The i-th pivot: a splitmix64 step."""
    z = (i * 0x9E3779B97F4A7C15 + 0x1F83D9ABFB41BD6B) & (2**64 - 1)
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return z ^ (z >> 31)


BASE = _mix(0)
TABLE_PIVOTS = [BASE ^ (((1 << BLOCK) - 1) << (BLOCK * j)) for j in range(BITS // BLOCK)]
SPREAD_PIVOTS = [_mix(i) for i in range(1, 17)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """The unsigned 64-bit hash of every shingle of one text, repeats included, in their order.

    Words are A-Z in lower case, split at ASCII white space. Fewer words than a shingle: one shingle of
    them all; no words: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)), "<u8", n)


def majority(hashes: np.ndarray) -> int:
    """The unsigned fingerprint: a bit is 1 if set in over half the hashes; no hashes: 0."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a very long text is counted in pieces
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text; no words: 0."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp as a signed long; one row for each row of ``docs``. Null text: 0, as empty."""
    arrow_limits(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])
        settle()

    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType())])
    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id").mapInArrow(run, schema)


def groups_for(n: int) -> int:
    """Groups of blocks for n fingerprints: more, and so longer keys, as the table grows. Exact at any value."""
    return 4 if n <= 20_000_000 else 6 if n <= 2_000_000_000 else 8


def bucket_keys(nodes: DataFrame, groups: int, radius: int = RADIUS) -> DataFrame:
    """(key, fp): each fingerprint once for each choice of ``groups - radius`` groups, keyed by its coordinates there."""
    base = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(BASE)))).cast("int")
    table = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("int") for p in TABLE_PIVOTS]
    n = len(TABLE_PIVOTS)
    coords = nodes.select("fp", F.array(*[((base - d + BLOCK) / 2).cast("int") for d in table]).alias("c"))
    shares = [range(g * n // groups, (g + 1) * n // groups) for g in range(groups)]
    packed = []
    for share in shares:
        x = F.lit(0).cast("long")
        for j in share:
            x = x * 3 + F.col("c")[j]
        packed.append(x)
    coords = coords.select("fp", F.array(*packed).alias("g"))
    keys = [
        F.xxhash64(F.lit(k), *[F.col("g")[i] for i in chosen])
        for k, chosen in enumerate(combinations(range(groups), groups - radius))
    ]
    return coords.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span each bucket's linked sets. keys: sorted; fps: uint64."""
    spread = np.array(SPREAD_PIVOTS, dtype=np.uint64)
    table = _popcount(fps[:, None] ^ spread[None, :]).astype(np.int8)
    parent: dict[tuple[int, int], tuple[int, int]] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    at, step = np.arange(len(keys) - 1), 1
    while len(at):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        for lo in range(0, len(at), 1 << 15):
            i = at[lo : lo + (1 << 15)]
            j = i + step
            near = np.abs(table[i] - table[j]).max(axis=1, initial=0) <= radius  # pairs beyond are discarded unseen
            i, j = i[near], j[near]
            true = _popcount(fps[i] ^ fps[j]) <= radius
            for k, a, b in zip(keys[i[true]].tolist(), fps[i[true]].tolist(), fps[j[true]].tolist()):
                ra, rb = find((k, a)), find((k, b))
                if ra != rb:
                    parent[ra] = rb
                    links.append((a, b))
        step += 1
    return links


def pivot_links(nodes: DataFrame, groups: int, bucket_cap: int = 512, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between fingerprints at ``radius`` or fewer differing bits, enough to span every linked set.

    nodes(fp): distinct fingerprints.
    """
    spark = nodes.sparkSession
    if radius != RADIUS:
        raise ValueError("the way for large buckets is exact for a radius of 2")
    keyed = bucket_keys(nodes, groups, radius)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    held = stash(keyed.join(shared, "key"), "buckets")

    def run(batches):
        k, f = [], []

        def flush(keys, fps):
            got = _bucket_links(keys, fps.view(np.uint64), radius)
            u = np.array([a for a, _ in got], dtype=np.uint64).view(np.int64)
            v = np.array([b for _, b in got], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            k.append(b.column(0).to_numpy(zero_copy_only=False))
            f.append(b.column(1).to_numpy(zero_copy_only=False))
            if sum(map(len, k)) >= 1 << 16:
                keys, fps = np.concatenate(k), np.concatenate(f)
                cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
                if cut:
                    yield flush(keys[:cut], fps[:cut])
                k, f = [keys[cut:]], [fps[cut:]]
        if k:
            yield flush(np.concatenate(k), np.concatenate(f))

    normal = (
        held.filter(F.col("n") <= bucket_cap).select("key", "fp")
        .repartition(shuffle_parts(spark), "key").sortWithinPartitions("key", "fp")
        .mapInArrow(run, "u long, v long")
    )
    large = held.filter(F.col("n") > bucket_cap).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    mids = large.select("fp", F.explode(flips).alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("mid"), "fp")
    stars = mids.groupBy("mid").agg(F.collect_list("fp").alias("all")).filter(F.size("all") > 1)
    stars = stars.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).filter("u <> v")
    return normal.unionByName(stars)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket_cap: int = 512
) -> DataFrame:
    """(doc_id, fp, component_id, distinct_prints): one row for each row of ``docs``.

    distinct_prints: how many different fingerprints the component holds. component_id: the smallest doc_id reachable over links of RADIUS or fewer differing bits, the
    row's own included. Null and empty texts, and texts of white space, have fingerprint 0 and are
    linked like any other. Rows with a null doc_id keep it; they never name a component (null only
    if the whole component has null ids). Repeated rows each return. Extra columns are ignored.
    """
    prints = stash(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = stash(prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "nodes")
    links = pivot_links(nodes.select("fp"), groups_for(nodes.count()), bucket_cap)
    stars = connected_components(links)
    rooted = nodes.join(stars, nodes.fp == stars.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    rooted = stash(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("distinct_prints"))
    named = rooted.join(least, "root").select("fp", "component_id", "distinct_prints")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", "distinct_prints")


def op1(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

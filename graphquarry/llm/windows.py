"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Every window of ``size`` words of every document is hashed. A task packs its windows by hash bucket: for
each bucket the documents, the gaps between the places of their windows, and hashes cut to as many bytes as
the number of windows asks for. A window that a task meets again is settled there, so a frequent one
travels once for each task. Each bucket is sorted by hash: of equal windows the first in order of document
and place stays, all others are repeated, and that goes back packed by document and is merged into runs of
places.

Cut hashes could make two different windows look equal. So each occurrence is checked when the texts are
read again: a second, independent 64-bit hash of the window, times a factor drawn from the first hash, is
added for every repeated window and taken off for the first one as often. Over all documents this comes
to zero if each repeated window has the words of its first; if it doesn't, the pass is repeated with other
hashes and more buckets, which widens them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, settle, small, spread, stash, text_hash

#: Bytes of text that a task packs at once, and of all texts for each bucket (about a sixth as many windows).
PACK_BYTES, BUCKET_BYTES = 6 << 20, 12 << 20
#: Up to so many documents with repeated windows, and so many runs of them, are sent to every task; beyond that the texts are shuffled. Same result.
MAX_SENT, MAX_RUNS = 250_000, 1_000_000
#: Marks of a window: repeated, and sure of it; repeated by its cut hash; a number above zero: the first of so many repeated ones.
SURE, REPEATED = 0, -1


# -- hashes ---------------------------------------------------------------------------------------
def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(values: np.ndarray, size: int, factor: int) -> np.ndarray:
    """The polynomial hash of every ``size`` consecutive values: the sum of value * factor**place, modulo 2**64, by doubling."""
    if len(values) < size:
        return values[:0]
    out, have, block, span, power = None, 0, values, 1, factor  # power: factor**span
    while True:
        if size & span:  # the block goes behind what there is
            lift = np.uint64(pow(factor, have, 1 << 64))
            out = block if out is None else out[: len(block) - have] + block[have:] * lift
            have += span
        if have == size:
            return out
        block, span, power = block[:-span] + block[span:] * np.uint64(power), 2 * span, power * power % (1 << 64)


def windows_of(words: list[list[bytes]], size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, text, place) of every window that lies in one text, in order."""
    offsets = np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    text = np.repeat(np.arange(len(words)), counts)
    place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), text, place
    coded = pa.chunked_array([pa.array(w, pa.binary()) for w in words]).combine_chunks().dictionary_encode()
    digests = b"".join([xxhash.xxh3_128_digest(w, seed) for w in coded.dictionary.to_pylist()])
    values = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)[coded.indices.to_numpy()]
    at, factor = offsets[text] + place, xxhash.xxh64_intdigest(b"factor", seed) | 1
    first, second = (mixed(rolling(np.ascontiguousarray(values[:, k]), size, factor + 2 * k)[at]) for k in (0, 1))
    return first, second, text, place


# -- packing --------------------------------------------------------------------------------------
def planes(a: np.ndarray) -> bytes:
    """Integers as eight planes of bytes: those of small ones are zero but for one or two, which compresses well."""
    return np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<i8").ravel()


class Docs:
    """Names of documents as arrays: whether there is no doc_id, doc_id, and the hash of the text where ids are shared."""

    def __init__(self, none: np.ndarray, ids: np.ndarray, parts: np.ndarray):
        self.none, self.ids, self.parts = none.astype(np.int64), ids, parts

    def take(self, at: np.ndarray) -> Docs:
        return Docs(self.none[at], self.ids[at], self.parts[at])

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """(rank, where the first of each rank is): by no id, id and part; equal names share a rank."""
        by = np.lexsort((self.parts, self.ids, self.none))
        o = self.take(by)
        new = np.ones(len(by), bool)
        new[1:] = (o.none[1:] != o.none[:-1]) | (o.ids[1:] != o.ids[:-1]) | (o.parts[1:] != o.parts[:-1])
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(new) - 1
        return rank, by[new]

    @staticmethod
    def joined(every: list[Docs]) -> Docs:
        return Docs(*(np.concatenate([getattr(d, k) for d in every]) for k in ("none", "ids", "parts")))


def pack(names: Docs, doc: np.ndarray, place: np.ndarray, **more: bytes) -> dict:
    """Windows in order of doc, an index into names, and place, as one row."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    gap = np.diff(place, prepend=0)
    gap[starts] = place[starts]
    own = names.take(doc[starts])
    return {
        "none": planes(own.none), "ids": planes(np.diff(own.ids, prepend=0)), "parts": planes(own.parts),
        "counts": planes(np.diff(np.append(starts, len(doc)))), "gaps": planes(gap), **more,
    }


def unpack(rows: list[dict]) -> tuple[Docs, np.ndarray, np.ndarray]:
    """(names, doc, place) of packed rows one after the other; a document has a name for each row that it is in."""
    names, doc, place, since = [], [], [], 0
    for r in rows:
        counts, gap = unplanes(r["counts"]), unplanes(r["gaps"])
        total = np.cumsum(gap)
        starts = np.cumsum(counts) - counts
        place.append(total - np.repeat(total[starts] - gap[starts], counts))
        doc.append(np.repeat(np.arange(len(counts)) + since, counts))
        names.append(Docs(unplanes(r["none"]), np.cumsum(unplanes(r["ids"])), unplanes(r["parts"])))
        since += len(counts)
    return Docs.joined(names), np.concatenate(doc), np.concatenate(place)


_NAMES = ["none", "ids", "parts", "counts", "gaps"]
_COLUMNS = ", ".join(f"{c} binary" for c in _NAMES)


def _packed(ids: list, parts: list, texts: list, size: int, seed: int, buckets: int, width: int, turn: int) -> Iterator[dict]:
    """The windows of some documents, a row for each bucket; those that come again among them, in one more row."""
    none = np.array([i is None for i in ids])
    names = Docs(none, np.array([i or 0 for i in ids], np.int64), np.array(parts, np.int64))
    _, firsts = names.ranks()
    names = names.take(firsts)  # in order, repeated rows once
    first, second, doc, place = windows_of([(texts[i] or "").encode().split() for i in firsts.tolist()], size, seed)
    by = np.argsort(first, kind="stable")  # of equal ones, the first document and place leads
    new = np.ones(len(by), bool)
    new[1:] = (first[by[1:]] != first[by[:-1]]) | (second[by[1:]] != second[by[:-1]])
    again = np.sort(by[~new])
    by = np.sort(by[new])
    if len(again):
        yield {"bucket": turn % buckets} | pack(names, doc[again], place[again], hashes=b"")
    if not len(by):
        return
    bucket = ((second[by] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    to = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    by, bucket = by[to], bucket[to]
    cut = np.searchsorted(bucket, np.arange(buckets + 1))
    raw = np.ascontiguousarray(first[by].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    for k in np.flatnonzero(np.diff(cut)).tolist():
        on = slice(cut[k], cut[k + 1])
        yield {"bucket": k} | pack(names, doc[by[on]], place[by[on]], hashes=raw[on].tobytes())


def _judged(rows: list[dict], width: int) -> tuple[Docs, np.ndarray, np.ndarray, np.ndarray]:
    """(names, doc, place, mark) of the windows of a bucket that are repeated or the first of repeated ones."""
    sent, sure = [r for r in rows if r["hashes"]], [r for r in rows if not r["hashes"]]
    names, doc, place, mark = [], [], [], []
    if sent:
        raw = np.zeros((sum(len(r["hashes"]) for r in sent) // width, 8), np.uint8)
        raw[:, :width] = np.frombuffer(b"".join(r["hashes"] for r in sent), np.uint8).reshape(-1, width)
        h = raw.view("<u8").ravel()
        found, d, p = unpack(sent)
        by = np.argsort(h, kind="stable")
        equal = h[by[1:]] == h[by[:-1]]
        held = np.zeros(len(by), bool)
        held[1:] |= equal
        held[:-1] |= equal
        on = by[held]
        rank, _ = found.ranks()
        by = np.lexsort((p[on], rank[d[on]], h[on]))
        on, r = on[by], rank[d[on[by]]]
        one = np.ones(len(on), bool)  # the same place of repeated rows counts once
        one[1:] = (h[on[1:]] != h[on[:-1]]) | (r[1:] != r[:-1]) | (p[on[1:]] != p[on[:-1]])
        on = on[one]
        new = np.ones(len(on), bool)
        new[1:] = h[on[1:]] != h[on[:-1]]
        marks = np.full(len(on), REPEATED)
        marks[new] = np.diff(np.append(np.flatnonzero(new), len(on))) - 1
        on, marks = on[marks != 0], marks[marks != 0]
        names, doc, place, mark = [found], [d[on]], [p[on]], [marks]
    if sure:
        found, d, p = unpack(sure)
        since = len(names[0].ids) if names else 0
        names, doc, place, mark = [*names, found], [*doc, d + since], [*place, p], [*mark, np.full(len(d), SURE)]
    return Docs.joined(names), np.concatenate(doc), np.concatenate(place), np.concatenate(mark)


def _by_document(rows: list[dict], width: int, shards: int) -> Iterator[dict]:
    """What a bucket says, a row for each shard of documents."""
    names, doc, place, mark = _judged(rows, width)
    rank, firsts = names.ranks()
    names, doc = names.take(firsts), rank[doc]
    key = mixed(names.ids.view(np.uint64) ^ mixed(names.parts.view(np.uint64) + names.none.view(np.uint64)))
    shard = ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)[doc]
    by = np.lexsort((place, doc, shard))
    doc, place, mark, shard = doc[by], place[by], mark[by], shard[by]
    cut = np.searchsorted(shard, np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        on = slice(cut[k], cut[k + 1])
        yield {"shard": k} | pack(names, doc[on], place[on], marks=planes(mark[on]))


def _runs(rows: list[dict]) -> pa.Table:
    """(doc_id, part, runs) of a shard: consecutive places with the same mark."""
    names, doc, place = unpack(rows)
    mark = np.concatenate([unplanes(r["marks"]) for r in rows])
    rank, firsts = names.ranks()
    names, doc = names.take(firsts), rank[doc]
    by = np.lexsort((mark, place, doc))  # of two marks of a place the one that is checked comes first
    doc, place, mark = doc[by], place[by], mark[by]
    one = np.ones(len(doc), bool)
    one[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
    doc, place, mark = doc[one], place[one], mark[one]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1) | (mark[1:] != mark[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(doc)))
    of = np.flatnonzero(np.diff(doc[at], prepend=-1))
    run = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (place[at], length, mark[at])], ["start", "length", "mark"])
    held = names.take(doc[at][of])
    offsets = pa.array(np.append(of, len(at)).astype(np.int32))
    return pa.table({"doc_id": pa.array(held.ids, mask=held.none.astype(bool)), "part": held.parts, "runs": pa.ListArray.from_arrays(offsets, run)})


# -- the operator ---------------------------------------------------------------------------------
def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, part, text): part tells rows apart that have no doc_id, or share one and differ in their text; else it is 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    twice = stash(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    part = F.when(F.col("doc_id").isNull(), text_hash())
    if not twice.isEmpty():
        texts = rows.join(small(twice, MAX_SENT), "doc_id", "left_semi").select("doc_id", text_hash().alias("h")).distinct()
        shared = texts.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("_shared"))
        shared = stash(shared, "shared-ids")
        rows = rows.join(small(shared, MAX_SENT), F.col("doc_id") == F.col("_shared"), "left")
        part = F.when(F.col("doc_id").isNull() | F.col("_shared").isNotNull(), text_hash())
    return rows.select("doc_id", F.coalesce(part, F.lit(0)).cast("long").alias("part"), "text")


def repeated_runs(rows: DataFrame, size: int, seed: int, buckets: int, width: int, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(doc_id, part, runs array<struct<start, length, mark>>) of named rows: one row for each document that has any."""

    def packed(batches):
        ids, parts, texts, held, turn = [], [], [], 0, 0

        def out():
            found = list(_packed(ids, parts, texts, size, seed, buckets, width, turn))
            return pa.RecordBatch.from_pylist(found, pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in [*_NAMES, "hashes"])]))

        for b in batches:
            for i, part, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ids.append(i), parts.append(part), texts.append(t)
                held += len(t or "")
                if held >= pack_bytes:
                    yield out()
                    ids, parts, texts, held, turn = [], [], [], 0, turn + 1
        yield out()
        ids, parts, texts = [], [], []
        settle()

    def judged(table: pa.Table) -> pa.Table:
        found = list(_by_document(table.to_pylist(), width, buckets))
        return pa.Table.from_pylist(found, pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in [*_NAMES, "marks"])]))

    def merged(table: pa.Table) -> pa.Table:
        out = _runs(table.to_pylist())
        settle()
        return out

    sent = rows.mapInArrow(packed, f"bucket int, {_COLUMNS}, hashes binary")
    back = sent.groupBy("bucket").applyInArrow(judged, f"shard int, {_COLUMNS}, marks binary")
    return back.groupBy("shard").applyInArrow(merged, "doc_id long, part long, runs array<struct<start:int,length:int,mark:int>>")


def _merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches in order of their start, those that touch or overlap made one."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.append(True, starts[1:] > reach[:-1])
    return starts[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]


def _check(words: list[bytes], runs: list[dict], size: int, seed: int) -> int:
    """The document's share of the sum that comes to zero."""
    first, second, _, _ = windows_of([words], size, seed)
    total = 0
    with np.errstate(over="ignore"):
        value = mixed(first + np.uint64(seed + 1)) * second
        for r in runs:
            if r["mark"] != SURE:
                total += -r["mark"] * int(value[r["start"] : r["start"] + r["length"]].sum(dtype=np.uint64))
    return total % (1 << 64)


def dedup_windows(
    docs: DataFrame, size: int = 20, id_col: str = "doc_id", text_col: str = "text",
    seed: int = 1, width: int | None = None, buckets: int | None = None, pack_bytes: int = PACK_BYTES, max_sent: int = MAX_SENT, tries: int = 4,
) -> DataFrame:
    """(doc_id, n_words, n_removed, spans array<struct<start, length>>, kept_text): one row for each row of ``docs``.

    Words are what ASCII white space separates. A word goes if it lies in a window of ``size`` words whose
    words also start at an earlier place: in a smaller doc_id, or earlier in the same document. spans: the
    maximal stretches of words that go; kept_text: the other words, joined by one space. Documents with
    fewer words than ``size`` lose none; null text: no words. A null doc_id comes after all others. Rows
    that share a doc_id, or have none, are told apart by the hash of their text, which orders them; repeated
    rows are one document and lose the same words. Extra columns are ignored; an empty table gives no rows.

    ``width`` and ``buckets``: bytes of a hash that travel and how many buckets there are; by default from the
    size of all texts, so that a false match in the whole table is rare. If there is one, the pass is repeated.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    rows = spread(named(docs, id_col, text_col))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(1, ceil(chars / BUCKET_BYTES))
    for k in range(tries):
        salt, wide = seed + 1000 * k, width or min(8, max(3, ceil((2 * log2(max(chars / 2, 2)) + 2 - log2(buckets)) / 8)))
        runs = stash(repeated_runs(rows, size, salt, buckets, wide, pack_bytes), "repeated-windows")
        out = stash(_kept(rows, _sendable(runs, max_sent), size, salt), "kept-words", "zstd")
        one = out.filter("check <> 0").select("doc_id", "part", "check").distinct()  # repeated rows once
        if int(one.agg(F.sum(F.col("check").cast("decimal(20,0)"))).first()[0] or 0) % (1 << 64) == 0:
            return out.select("doc_id", "n_words", "n_removed", "spans", "kept_text")
        width, buckets = None, 4 * buckets
    raise RuntimeError(f"different windows still had equal hashes after {tries} passes")


def _sendable(runs: DataFrame, max_sent: int) -> DataFrame:
    """``runs`` with a broadcast hint if there are few enough, counted."""
    n = runs.agg(F.count("*"), F.sum(F.size("runs"))).first()
    return F.broadcast(runs) if n[0] <= max_sent and (n[1] or 0) <= MAX_RUNS else runs


def _kept(rows: DataFrame, runs: DataFrame, size: int, seed: int) -> DataFrame:
    """(doc_id, part, n_words, n_removed, spans, kept_text, check) of named rows and their runs."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    fields = {"doc_id": pa.int64(), "part": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "spans": span, "kept_text": pa.string(), "check": pa.int64()}

    def removed(batches):
        for b in batches:
            n, gone, spans, kept, check = [], [], [], [], []
            for t, runs in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                words = (t or "").encode().split()
                hit = [(r["start"], r["start"] + r["length"] + size - 1) for r in runs or [] if r["mark"] <= 0]
                start, end = _merged_spans(*(np.array(x, np.int64) for x in zip(*sorted(hit)))) if hit else ([], [])
                cuts = list(zip([0, *end], [*start, len(words)]))
                n.append(len(words))
                gone.append(len(words) - sum(z - a for a, z in cuts))
                spans.append([{"start": s, "length": e - s} for s, e in zip(start, end)])
                kept.append(b" ".join([w for a, z in cuts for w in words[a:z]]).decode())
                check.append(_check(words, runs, size, seed) if any(r["mark"] != SURE for r in runs or []) else 0)
            own = [b.column(0), b.column(1), n, gone, spans, kept, np.array(check, np.uint64).view(np.int64)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(own, fields.values())], list(fields))
        settle()

    found = runs.select(F.col("doc_id").alias("_id"), F.col("part").alias("_part"), "runs")
    both = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part")), "left").select("doc_id", "part", "text", "runs")
    return both.mapInArrow(removed, "doc_id long, part long, n_words long, n_removed long, spans array<struct<start:long,length:long>>, kept_text string, check long")


def op11(spark, sf_dir: str) -> DataFrame:
    out = dedup_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS words
  FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM d WHERE len(w) >= 20)),
rep AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM rep),
o AS (SELECT doc_id, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS words FROM o ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

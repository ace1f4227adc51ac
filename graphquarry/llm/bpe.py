"""Byte-level BPE encoding and decoding over padded numpy matrices.

Pieces of like length form one matrix of token ids, padded at the right. Each round finds every
row's leftmost pair of minimum rank, merges it and drops one column from every live row, so the
matrix compacts as it shrinks; rows without a mergeable pair leave it. Pair ranks come from an
open-addressing hash table that is probed with whole arrays. A piece above LONG bytes (no white
space for so long) takes the same merges through a heap, whose work isn't quadratic.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, settle, spread

LONG = 512
NONE = np.int32(2**31 - 1)
_SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


class PairRanks:
    """(left id, right id) -> rank of the joined bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = [
            (ranks[t[:i]] << 32 | ranks[t[i:]], r)
            for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        self.as_dict = dict(pairs)
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        keys, vals = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True  # one key for each free slot and round
            put = free & first
            self.keys[at[put]], self.ranks[at[put]] = keys[put], vals[put]
            keys, vals, at = keys[~put], vals[~put], (at + ~free)[~put] & self.mask
        self.n = len(pairs)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where there is no such pair or a side is padding (-1)."""
        out = np.full(left.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left[todo].astype(np.int64) << 32 | right[todo].astype(np.int64)
        at = self._slot(keys)
        while len(todo):
            there = self.keys[at]
            hit = there == keys
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (there != -1)
            todo, keys, at = todo[on], keys[on], (at[on] + 1) & self.mask
        return out


class ByteBPE:
    """Encodes as the public ranks file says; a file of base64 bytes and rank in each line."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache_size: int = 300_000):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.pairs = PairRanks(ranks)
        # \s as the Unicode property White_Space, which leaves out the four separator controls
        held = pattern.replace(r"[^\s", f"[^{_SPACES}")
        self.pattern = regex.compile(held.replace(r"\S", f"[^{_SPACES}]").replace(r"\s", f"[{_SPACES}]"))
        self.cache: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.cache_size = cache_size
        self.blank_run = re.compile(r"\s ")
        self.cut = re.compile(r"(?<=\S)(?= )")

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    # -- pieces ---------------------------------------------------------------------------
    def _matrix(self, rows: list[bytes], width: int) -> list[bytes]:
        n = len(rows)
        flat = np.frombuffer(b"".join(rows), np.uint8)
        sizes = np.fromiter(map(len, rows), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width)[None, :] < sizes[:, None]] = self.byte_ids[flat]
        ranks = self.pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        live = np.arange(n)
        done: list[bytes] = [b""] * n

        def finish(which, mat):
            held = mat >= 0
            data, ends = mat[held].astype("<u4").tobytes(), np.cumsum(held.sum(axis=1)) * 4
            a = 0
            for r, b in zip(which.tolist(), ends.tolist()):
                done[r] = data[a:b]
                a = b

        while len(live):
            w = ids.shape[1]
            if w == 1:
                finish(live, ids)
                break
            at = ranks.argmin(axis=1)  # the leftmost of equal minima
            low = ranks[np.arange(len(live)), at]
            over = low == NONE
            if over.any():
                finish(live[over], ids[over])
                on = ~over
                live, ids, ranks, at, low = live[on], ids[on], ranks[on], at[on], low[on]
                if not len(live):
                    break
            k, rows_ = len(live), np.arange(len(live))
            ids[rows_, at] = low
            ids = ids[np.arange(w)[None, :] != (at + 1)[:, None]].reshape(k, w - 1)
            ranks = ranks[np.arange(w - 1)[None, :] != at[:, None]].reshape(k, w - 2)
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.pairs.get(ids[has, at[has] - 1], low[has])
            has = np.flatnonzero(at < w - 2)
            ranks[has, at[has]] = self.pairs.get(low[has], ids[has, at[has] + 1])
        return done

    def _heap(self, piece: bytes) -> bytes:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, rank = len(ids), self.pairs.as_dict
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(rank[k], i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := ids[i] << 32 | ids[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = r, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y < n and (k := ids[x] << 32 | ids[y]) in rank:
                    heapq.heappush(heap, (rank[k], x, ids[x], ids[y]))
        return np.array([x for x, ok in zip(ids, alive) if ok], "<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = r.to_bytes(4, "little")
            elif len(p) > LONG:
                out[i] = self._heap(p)
            elif p:
                n = len(p)
                buckets.setdefault(-(-n // 4) * 4 if n <= 32 else 1 << (n - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, (1 << 19) // width)
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                for i, ids in zip(part, self._matrix([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    # -- texts ----------------------------------------------------------------------------
    def _fill(self, cache: dict[str, bytes], wanted: set[str], lead: str) -> None:
        if len(cache) + len(wanted) > self.cache_size and cache:
            cache.clear()
        missing = [w for w in wanted if w not in cache]
        pieces: list[bytes] = []
        spans = []
        for w in missing:
            got = self.pattern.findall(lead + w)
            spans.append((len(pieces), len(pieces) + len(got)))
            pieces += [p.encode("utf-8", "surrogatepass") for p in got]
        ids = self.encode_pieces(pieces)
        for w, (a, b) in zip(missing, spans):
            cache[w] = ids[a] if b == a + 1 else b"".join(ids[a:b])

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. A cut before a space after a non-space never splits a match of the pattern."""
        split = []
        plain: set[str] = set()
        spaced: set[str] = set()
        for t in texts:
            if self.blank_run.search(t):
                words = self.cut.split(t)
                plain.update(words)
                split.append((words, None))
            else:
                words = t.split(" ")
                plain.add(words[0])
                first = words[0]
                del words[0]
                spaced.update(words)
                split.append(([first], words))
        self._fill(self.cache, plain, "")
        self._fill(self.spaced, spaced, " ")
        a, b = self.cache.__getitem__, self.spaced.__getitem__
        return [b"".join(map(a, p)) + (b"".join(map(b, s)) if s else b"") for p, s in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], ByteBPE] = {}


def _tokenizer(path: str, pattern: str) -> ByteBPE:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBPE.from_file(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, ids binary, decoded binary), or their digests.

    ids: little-endian unsigned 32-bit integers; decoded: the bytes that decoding the ids gives.
    With digests: (doc_id, n_tokens, ids_sha256, decoded_sha256), so that ids never leave the
    worker. Null text: as empty, no ids. One row for each row of ``docs``; extra columns are
    ignored, repeated rows and null doc_ids return as they come. path: on every executor.
    """
    arrow_limits(docs.sparkSession)
    key = T.StructField("doc_id", docs.schema[id_col].dataType)
    if digests:
        schema = T.StructType([key, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    else:
        schema = T.StructType([key, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        bpe = _tokenizer(path, pattern)
        for b in batches:
            ids = bpe.encode_texts([t or "" for t in b.column(1).to_pylist()])
            if digests:
                sha = lambda x: hashlib.sha256(x).hexdigest()
                cols = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x) for x in ids], pa.string()), pa.array([sha(bpe.decode(x)) for x in ids], pa.string())]
            else:
                cols = [pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], schema.names)
        settle()

    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id").mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) of ids as ``encode`` returns them; null ids: null."""
    schema = T.StructType([T.StructField("doc_id", rows.schema[id_col].dataType), T.StructField("decoded", T.BinaryType())])

    def run(batches):
        bpe = _tokenizer(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x and bpe.decode(x) if x else x for x in b.column(1).to_pylist()], pa.binary())], schema.names)

    return rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema)


def op10(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, digests=True)

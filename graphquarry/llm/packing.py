"""Best-fit packing with swap-based local search.

Documents become token pieces of ``capacity`` at most. Pieces that fill a sequence stand alone. The
rest is dealt at random into blocks of bounded size; a block is packed by best fit over falling
lengths and then improved: between underfull bins, a document moves, or one is exchanged for one or
two others, whenever that increases the sum of squared fills, so fuller bins fill up while emptier
ones shrink until they are gone. Bins that remain underfull give their pieces to another round over
fewer blocks, until one block holds them all or a round leaves no fewer bins open.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, settle, spread, stash


#: The normaliser and the pattern of the files whose texts may be cut into words.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters and digits after which a text may be cut before a mark, if the file's own rules agree: Latin, Greek, Cyrillic.
CUT_AFTER = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x386, 0x482), *range(0x48A, 0x530)]
CUT_BEFORE = ".,;:!?|$%&*#"


class WordTokenizer:
    """Ids from a tokenizers file, with a bounded cache by word.

    Files with NORMALISERS and WORD_PATTERN have no token that crosses white space or the line between
    a letter or digit and a mark after it, and they drop case. Their texts are lower-cased (A-Z) and cut
    at both, and only the distinct words of a batch become Python objects. A cut before a mark is made
    only after those characters for which the file itself gives the same ids with and without it
    (``I`` with a dot becomes a letter and a combining mark, which joins the mark after it). Texts for
    any other file are encoded whole.
    """

    def __init__(self, path: str, cache_size: int = 300_000):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size
        added = self.model.get_added_tokens_decoder()
        self.words = self._cuts_words(path) and any(t.content.startswith("<|") for t in added.values()) and all("<|" in t.content for t in added.values())
        if not self.words:
            return
        self.mark_id, self.mark = next((i, t.content) for i, t in sorted(added.items()) if t.content.startswith("<|"))
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        letters = [chr(c) for c in CUT_AFTER]
        ids = lambda texts: [e.ids for e in self.model.encode_batch(texts, add_special_tokens=False)]
        dots = ids(list(CUT_BEFORE))
        alone, safe = ids(letters), set(letters)
        for mark, dot in zip(CUT_BEFORE, dots):
            safe &= {c for c, own, both in zip(letters, alone, ids([c + mark for c in letters])) if own + dot == both}
        self.cut = f"([{''.join(sorted(safe))}])([{''.join(chr(92) + m for m in CUT_BEFORE)}])"

    @staticmethod
    def _cuts_words(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        split = {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True}
        steps = (rules["pre_tokenizer"] or {}).get("pretokenizers") or []
        return (
            (rules["normalizer"] or {}).get("normalizers") == NORMALISERS and len(steps) == 2 and steps[0] == split
            and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
            and rules["model"].get("end_of_word_suffix") == "</w>" and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in rules["added_tokens"])
        )

    def _fill(self, words: list[str], between: str, per_text: int = 1000) -> None:
        """Encodes many words in one text: set apart by a special token, or by spaces if each is one run of letters."""
        texts = [between.join(words[a : a + per_text]) for a in range(0, len(words), per_text)]
        gap = 0 if between == " " else 4
        for k, e in enumerate(e for a in range(0, len(texts), 8) for e in self.model.encode_batch_fast(texts[a : a + 8], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            data, a = ids.tobytes(), 0
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4 if not gap else np.append(np.flatnonzero(ids == self.mark_id) * 4, len(data))
            part = words[k * per_text : (k + 1) * per_text]
            if len(ends) != len(part):
                raise ValueError("the tokenizer's word ends don't match the words")
            for w, b in zip(part, ends.tolist()):
                self.cache[w] = data[a:b]
                a = b + gap

    def _ids_of(self, words: list[str]) -> list[bytes]:
        missing = [w for w in words if w not in self.cache]
        if len(self.cache) + len(missing) > self.cache_size:
            self.cache.clear()
            missing = words
        runs, rest, odd = [], [], []
        for w in missing:
            (odd if "<|" in w else runs if w.isalpha() and max(w) <= "\xff" else rest).append(w)
        for w, e in zip(odd, self.model.encode_batch(odd, add_special_tokens=False)):  # could hold a special token's own text
            self.cache[w] = np.array(e.ids, "<u4").tobytes()
        self._fill(runs, " ")
        self._fill(rest, self.mark)
        return list(map(self.cache.__getitem__, words))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers; null: none."""
        if not self.words:
            whole = [t or "" for t in texts.to_pylist()]
            return [np.array(e.ids, np.uint32) for e in self.model.encode_batch_fast(whole, add_special_tokens=False)]
        texts = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
        cut = pc.replace_substring_regex(pc.ascii_lower(texts), self.cut, r"\1 \2")
        words = pc.split_pattern(pc.if_else(pc.match_substring(texts, "<|"), texts, cut), " ")
        coded = words.flatten().dictionary_encode()
        known = self._ids_of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, known), np.int32, len(known)) // 4
        flat, since = np.frombuffer(b"".join(known), "<u4"), np.cumsum(sizes, dtype=np.int32) - sizes
        which = coded.indices.to_numpy(zero_copy_only=False)
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            w = which[a:b]
            n = sizes[w]
            total = np.cumsum(n, dtype=np.int32)
            out.append(flat[np.repeat(since[w] - total + n, n) + np.arange(total[-1] if len(total) else 0, dtype=np.int32)])
        return out


_loaded: dict[str, WordTokenizer] = {}
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core


def _larger(batches, enough: int = 2 << 20):
    """Batches joined to about ``enough`` bytes, so that more of a batch's words are repeats."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= enough:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and end_id, cut where longer than capacity."""
    arrow_limits(docs.sparkSession)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def run(batches):
        if path not in _loaded:
            _loaded[path] = WordTokenizer(path)
        for b in _larger(batches):
            at, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(_loaded[path].encode(b.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    at.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols, schema.names)
            settle()
        _loaded[path].cache.clear()  # an idle worker holds no words
        settle()

    return spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id").mapInArrow(run, schema)


class _BySize:
    """A multiset of items by size, with the largest size up to a bound in one step."""

    def __init__(self):
        self.mask, self.of = 0, {}

    def add(self, item: int, size: int) -> None:
        self.of.setdefault(size, set()).add(item)
        self.mask |= 1 << size

    def remove(self, item: int, size: int) -> None:
        own = self.of[size]
        own.discard(item)
        if not own:
            del self.of[size]
            self.mask &= ~(1 << size)

    def most(self, bound: int) -> int:
        """The largest size <= bound, or 0."""
        return (self.mask & ((1 << (bound + 1)) - 1)).bit_length() - 1 if bound > 0 and self.mask & ((1 << (bound + 1)) - 1) else 0

    def least(self, bound: int) -> int:
        """The smallest size >= bound, or 0."""
        m = self.mask >> bound
        return bound + (m & -m).bit_length() - 1 if m else 0

    def any(self, size: int) -> int:
        return next(iter(self.of[size]))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: falling sizes, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    room = _BySize()
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        r = room.least(sizes[i]) if sizes[i] else 0
        if r:
            b = room.any(r)
            room.remove(b, r)
            bins[b].append(i)
        else:
            b, r = len(bins), capacity
            bins.append([i])
        if r - sizes[i]:
            room.add(b, r - sizes[i])
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search: every step raises the sum of squared fills; bins that end empty go. Passes go on while they gain.

    Bins are taken by falling fill. A bin with room gains from emptier ones: it takes a document
    (move), swaps one of its own for a larger one, two of its own for one larger than both, or one
    of its own for two of one bin that are larger together. Documents of one size are alike, so a
    bin's choices are as many as its different sizes, which are about a hundred at most.
    """
    bins = [list(b) for b in bins]
    while True:
        fill = [sum(sizes[i] for i in b) for b in bins]
        before = sum(f * f for f in fill)
        order = sorted((k for k in range(len(bins)) if 0 < fill[k] < capacity), key=lambda k: -fill[k])
        home: dict[int, int] = {}
        index, held = _BySize(), {k: _BySize() for k in order}
        for k in order:
            for i in bins[k]:
                home[i] = k
                index.add(i, sizes[i])
                held[k].add(i, sizes[i])
        for k in order:
            own = held[k]
            for size, some in own.of.items():
                for i in some:
                    index.remove(i, size)
            while own.mask and index.mask and (room := capacity - fill[k]) > 0:
                out, taken, gain = _best_step(own, index, held, home, sizes, room, capacity)
                if not taken:
                    break
                donor = home[taken[0]]
                for i in taken:
                    index.remove(i, sizes[i])
                    held[donor].remove(i, sizes[i])
                    own.add(i, sizes[i])
                    home[i] = k
                for i in out:
                    own.remove(i, sizes[i])
                    held[donor].add(i, sizes[i])
                    home[i] = donor
                    index.add(i, sizes[i])
                fill[k] += gain
                fill[donor] -= gain
        for k in order:
            bins[k] = [i for some in held[k].of.values() for i in some]
        bins = [b for b in bins if b]
        if sum(sum(sizes[i] for i in b) ** 2 for b in bins) <= before:
            return bins


def _best_step(own: _BySize, index: _BySize, held: dict[int, _BySize], home: dict[int, int], sizes: list[int], room: int, capacity: int) -> tuple[tuple, tuple, int]:
    """(own items out, items in, gain) of the step that fills the most of the room."""
    gain, out, size = index.most(room), (), 0
    kinds = sorted(own.of)
    for x, s1 in enumerate(kinds):
        if gain == room:
            break
        s = index.most(s1 + room)
        if s - s1 > gain:
            gain, out, size = s - s1, (s1,), s
        for s2 in kinds[x + (len(own.of[s1]) < 2) :]:
            s = index.most(min(s1 + s2 + room, capacity))
            if s - s1 - s2 > gain:
                gain, out, size = s - s1 - s2, (s1, s2), s
    if gain < room:
        for s1 in kinds:
            first = index.most(s1 + room - 1)
            if not first:
                continue
            b1 = index.any(first)
            other = held[home[b1]]
            other.remove(b1, first)
            second = other.most(s1 + room - first)
            b2 = other.any(second) if second else None
            other.add(b1, first)
            if second and first + second - s1 > gain:
                return (own.any(s1),), (b1, b2), first + second - s1
    if not gain:
        return (), (), 0
    leave = () if not out else (own.any(out[0]),) if len(out) == 1 else tuple(list(own.of[out[0]])[:2]) if out[0] == out[1] else (own.any(out[0]), own.any(out[1]))
    return leave, (index.any(size or gain),), gain


def pack_block(sizes: list[int], capacity: int) -> list[list[int]]:
    return improve(best_fit(sizes, capacity), sizes, capacity)


def pack(items: DataFrame, capacity: int, block: int = 4096) -> DataFrame:
    """``items`` (with a long column length of 1 to capacity) plus sequence_id and offset (offsets gapless from 0).

    Row for row: repeated rows are packed each. ``block`` bounds the rows that one task holds. A round
    deals the rows of bins that are still open to fewer blocks; the last is the one with one block, or
    the one that ends with no fewer open bins than the round before. A bin that lacks a 512th of the capacity
    or less (8 tokens of 4096) is closed and leaves the search; no sum of short pieces would fill it for less
    than it costs. ``items`` has no columns named _row, _block, _fill, sequence_id or offset.
    """
    spark = items.sparkSession
    items = stash(items.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    full = items.filter(F.col("length") >= capacity).withColumn("sequence_id", F.shiftleft(F.col("_row"), 1)).withColumn("offset", F.lit(0).cast("long"))
    rest = items.filter(F.col("length") < capacity)
    out_schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_fill", T.LongType())])
    done, names = [full], items.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="_block").sort_values("_row").reset_index(drop=True)
        sizes = pdf["length"].astype(int).tolist()
        rows = pdf["_row"].astype("int64").to_numpy()
        seq, off, fill = (np.zeros(len(pdf), np.int64) for _ in range(3))
        for b in pack_block(sizes, capacity):
            at = 0
            name = 2 * int(min(rows[i] for i in b)) + 1  # a row is in one bin: no two names are equal
            for i in b:
                seq[i], off[i] = name, at
                at += sizes[i]
            fill[b] = at
        return pdf.assign(sequence_id=seq, offset=off, _fill=fill)

    n, k, before = rest.count(), 0, None
    while n:
        blocks = -(-n // block)
        dealt = rest.withColumn("_block", F.pmod(F.xxhash64(F.lit(k), "_row"), F.lit(blocks)).cast("int"))
        packed = stash(dealt.groupBy("_block").applyInPandas(run, out_schema), "packed")
        closed = F.col("_fill") >= capacity - capacity // 512
        n, bins = packed.filter(~closed).agg(F.count("*"), F.count(F.when(F.col("offset") == 0, 1))).first()
        if blocks == 1 or (before is not None and bins >= before):
            done.append(packed.drop("_fill"))
            break
        done.append(packed.filter(closed).drop("_fill"))
        rest = packed.filter(~closed).select(*names)
        k, before = k + 1, bins
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("_row")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece of each row of ``docs``.

    Null and empty texts hold end_id alone. Only documents longer than capacity are cut; their last
    piece may be shorter. Repeated rows and null doc_ids are packed as any other; extra columns are
    ignored; an empty table gives no rows.
    """
    return pack(pieces(docs, path, capacity, end_id, id_col, text_col), capacity)


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("word_bpe_49k.json"))

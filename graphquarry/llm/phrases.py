"""Phrase collocation mining with weighted n-grams.

Texts are cut into pieces, and identical pieces of a language become one with a multiplicity. Each task
turns its pieces into n-grams, adds up the multiplicities of equal ones by integer keys of its own word
list, and packs the n-grams of a hash bucket and a language as one compressed text. A bucket's texts are read
one after the other and added up by duckdb, which goes to disk beyond its memory limit. Only n-grams that
are frequent enough come back: a phrase's parts occur wherever it does, so they are among them.

A candidate then asks for its parts, one request for each part of each cut. The requests are shuffled to
the counts, and the answers back together by phrase. The score is exact, in decimals of 38 digits.
"""

from __future__ import annotations

import tempfile

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, settle, shuffle_parts, spread, stash

#: Characters of pieces that a task turns into n-grams at once, and of all pieces for each bucket.
PACK_CHARS, BUCKET_CHARS = 4 << 20, 4 << 20
DUCK_MEMORY = "256MB"
_GRAMS = pa.schema([("lang", pa.string()), ("n", pa.int8()), ("gram", pa.string()), ("weight", pa.int64())])


def pieces(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece, times): the pieces of all texts, A-Z in lower case, each once for a language; pieces without words are left out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    every = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.explode(F.split(low, "[.,;:!?\\x0A-\\x0D]")).alias("piece"))
    every = every.select("lang", F.btrim("piece", F.lit(" \t")).alias("piece")).filter("piece <> ''")
    return every.groupBy("lang", "piece").agg(F.count("*").alias("times"))


def grams(lang: pa.Array, piece: pa.Array, times: np.ndarray, most: int) -> tuple[pa.Table, np.ndarray]:
    """(the n-grams up to ``most`` words of some pieces, each once for a language, a hash of each)."""
    split = pc.split_pattern_regex(piece, "[ \t]+")
    words = split.flatten().dictionary_encode()
    at = words.indices.to_numpy().astype(np.int64)
    vocabulary = words.dictionary
    value = np.array([xxhash.xxh64_intdigest(w) for w in vocabulary.cast(pa.binary()).to_pylist()], np.uint64)
    langs = lang.dictionary_encode()
    size = pc.list_value_length(split).to_numpy().astype(np.int64)
    of = np.repeat(np.arange(len(size)), size)
    tongue, weight, end = langs.indices.to_numpy().astype(np.int64)[of], times[of], np.cumsum(size)[of]
    salt = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in langs.dictionary.to_pylist()], np.uint64)
    place, key, base = np.arange(len(at)), tongue, len(vocabulary)
    out, hashes = [], []
    for n in range(1, most + 1):
        ok = place + n <= end
        key, place, end, weight = key[ok], place[ok], end[ok], weight[ok]
        # a key for each distinct n-gram so far and the word that follows
        _, first, inverse = np.unique(key * base + at[place + n - 1], return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, inverse, weight)
        start = place[first]
        gram = vocabulary.take(pa.array(at[start]))
        h = salt[tongue[start]] ^ value[at[start]]
        for k in range(1, n):
            gram = pc.binary_join_element_wise(gram, vocabulary.take(pa.array(at[start + k])), " ")
            h = h * np.uint64(0x9E3779B97F4A7C15) + value[at[start + k]]
        out.append(pa.table([langs.dictionary.take(pa.array(tongue[start])), pa.array(np.full(len(start), n, np.int8)), gram, pa.array(total)], schema=_GRAMS))
        hashes.append((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
        key = inverse
    return pa.concat_tables(out), np.concatenate(hashes)


def _planes(a: np.ndarray) -> bytes:
    """Integers as eight planes of bytes; most weights are 1, so this compresses to little."""
    return np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def pack(table: pa.Table) -> tuple[bytes, bytes]:
    """(n-grams, weights) of a part of one language, compressed; no n-gram holds a line end, which ends a piece."""
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column("gram").combine_chunks()), "\n")
    return zstandard.compress(text[0].as_py().encode(), 3), zstandard.compress(_planes(table.column("weight").to_numpy()), 3)


def unpack(lang: str, text: bytes, weights: bytes) -> pa.RecordBatch:
    gram = pc.split_pattern(pa.array([zstandard.decompress(text).decode()]), "\n").flatten()
    n = pc.cast(pc.add(pc.count_substring(gram, " "), 1), pa.int8())
    weight = np.ascontiguousarray(np.frombuffer(zstandard.decompress(weights), np.uint8).reshape(8, -1).T).view("<i8").ravel()
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(gram)), n, gram, pa.array(weight)], schema=_GRAMS)


def frequent(found: DataFrame, most: int, least: int, buckets: int, pack_chars: int = PACK_CHARS) -> DataFrame:
    """(lang, n, gram, f) of pieces(lang, piece, times): n-grams up to ``most`` words that occur ``least`` times; for each
    language also rows with n = 0, whose f add up to the number of all its words."""

    def packed(batches):
        held, size = [], 0

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            lang, piece, times = (t.column(k).combine_chunks() for k in range(3))
            table, h = grams(lang, piece, times.to_numpy(), most)
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            tongue = table.column("lang").combine_chunks().dictionary_encode()
            place = bucket * len(tongue.dictionary) + tongue.indices.to_numpy()
            by = np.argsort(place, kind="stable")  # otherwise as they were sorted by key, so like ones are neighbours
            table, place = table.take(pa.array(by)), place[by]
            start = np.flatnonzero(np.diff(place, prepend=-1))
            for at, end in zip(start.tolist(), [*start[1:].tolist(), len(place)]):
                row = [int(bucket[by[at]]), table.column("lang")[at].as_py(), *pack(table.slice(at, end - at))]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["bucket", "lang", "grams", "weights"])

        for b in batches:
            held.append(b)
            size += pc.sum(pc.binary_length(b.column(1))).as_py() or 0
            if size >= pack_chars:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()
        settle()

    def counted(batches):
        parts = (unpack(*row) for b in batches for row in zip(*(b.column(k).to_pylist() for k in (1, 2, 3))))
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"memory_limit": DUCK_MEMORY, "threads": 1, "temp_directory": spill}) as con:
            con.execute("SET preserve_insertion_order = false")
            reader = pa.RecordBatchReader.from_batches(_GRAMS, parts)  # noqa: F841  read by name
            con.execute("CREATE TEMP TABLE counts AS SELECT lang, n, gram, sum(weight)::BIGINT AS f FROM reader GROUP BY ALL")
            yield from con.sql(f"SELECT lang, n::INT AS n, gram, f FROM counts WHERE f >= {least:d}").to_arrow_reader(4096)
            yield from con.sql("SELECT lang, 0 AS n, '' AS gram, sum(f)::BIGINT AS f FROM counts WHERE n = 1 GROUP BY lang").to_arrow_reader(4096)
        settle()

    sent = found.mapInArrow(packed, "bucket int, lang string, grams binary, weights binary")
    parts = max(shuffle_parts(found.sparkSession), buckets)
    return sent.repartition(parts, "bucket").mapInArrow(counted, "lang string, n int, gram string, f long")


def scored(counts: DataFrame, most: int = 3) -> DataFrame:
    """(lang, phrase, n, a, l, r, score): the candidates of 2 to ``most`` words with the cut that scores lowest.

    a: how often the phrase occurs; l and r: its two parts; score: floor(1000000 a a / (l r)). Of cuts with
    the same score the first counts.
    """
    cands = counts.filter("n >= 2").select("lang", "n", F.col("gram").alias("phrase"), F.col("f").alias("a"))
    cuts = cands.select("lang", "n", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    words = F.split("phrase", " ")
    join = lambda at, many: F.array_join(F.slice(words, at, many), " ")
    sides = F.array(F.struct(F.lit("l").alias("side"), join(F.lit(1), F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), join(F.col("k") + 1, F.col("n") - F.col("k")).alias("part")))
    requests = cuts.select("lang", "n", "phrase", "a", "k", F.explode(sides).alias("s")).select("lang", "n", "phrase", "a", "k", "s.side", "s.part")
    known = counts.filter(F.col("n").between(1, most - 1)).select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), "f")
    answers = requests.join(known, (F.col("lang") == F.col("_lang")) & (F.col("part") == F.col("_gram")))
    one = answers.groupBy("lang", "phrase", "k").agg(
        F.first("n").alias("n"), F.first("a").alias("a"), F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r")
    )
    big = lambda c: f"cast({c} as decimal(15, 0))"
    one = one.withColumn("score", F.expr(f"({big('a')} * {big('a')} * 1000000BD) div ({big('l')} * {big('r')})"))
    best = one.groupBy("lang", "phrase").agg(F.first("n").alias("n"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "n", "a", "m.l", "m.r", "m.score")


def whole(found: DataFrame, counts: DataFrame, most: int = 3, percent: int = 50) -> DataFrame:
    """``found`` without the phrases that lie inside a longer candidate which occurs at least ``percent`` % as often."""
    longer = counts.filter("n > 2").select("lang", "n", F.split("gram", " ").alias("w"), F.col("f").alias("b"))
    inside = None
    for m in range(2, most):
        of = longer.filter(F.col("n") > m).select("lang", "b", F.explode(F.expr(f"transform(sequence(1, n - {m - 1}), i -> array_join(slice(w, i, {m}), ' '))")).alias("phrase"))
        inside = of if inside is None else inside.unionByName(of)
    if inside is None:
        return found
    top = stash(inside.groupBy("lang", "phrase").agg(F.max("b").alias("b")), "longer-phrases")
    both = found.join(top.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), "b"), (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    return both.filter(F.col("b").isNull() | (100 * F.col("b") < percent * F.col("a"))).select(*found.columns)


def collocations(docs: DataFrame, top: int = 2000, most: int = 3, least: int = 10, percent: int = 50, text_col: str = "text", lang_col: str = "lang", buckets: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``most`` words.

    Words are what blanks and tabs separate within pieces, which end at . , ; : ! ? and line ends. Everything is
    counted for each language by itself; a null one is und. a: occurrences of the phrase, at least ``least``;
    l, r: of its two parts at the cut with the lowest score; n: of all words. By score, then a, both from
    the highest, then phrase in the order of its UTF-8 bytes. Null and empty texts have no words; repeated
    rows count as often as they are there. Extra columns are ignored; an empty table gives no rows.
    """
    arrow_limits(docs.sparkSession)
    rows = spread(docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")))
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(1, -(-chars // BUCKET_CHARS))
    counts = stash(frequent(pieces(rows), most, least, buckets), "frequent-grams", "zstd")
    totals = F.broadcast(counts.filter("n = 0").groupBy("lang").agg(F.sum("f").alias("n")))  # one row for each language
    kept = stash(whole(scored(counts, most), counts, most, percent).drop("n"), "scored-phrases")
    order = [F.desc("score"), F.desc("a"), F.encode("phrase", "utf-8")]
    near = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # a language is cut in two steps
    near = near.withColumn("i", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("i") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
m AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w, count(*) AS times FROM p GROUP BY ALL),
g AS (
  SELECT lang, k, array_to_string(w[i + 1 : i + k], ' ') AS gram, sum(times) AS f
  FROM (SELECT lang, w, times, k, unnest(range(len(w) - k + 1)) AS i FROM m, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k)
  GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, gram, f::BIGINT AS a, string_split(gram, ' ') AS w FROM g WHERE k >= 2 AND f >= 10),
cut AS (SELECT lang, gram, a, j, array_to_string(w[1:j], ' ') AS one, array_to_string(w[j + 1 : k], ' ') AS two FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (
  SELECT cut.lang, cut.gram, a, j, x.f::BIGINT AS l, y.f::BIGINT AS r, (a::HUGEINT * a * 1000000 // (x.f::HUGEINT * y.f::HUGEINT))::BIGINT AS score
  FROM cut JOIN g AS x ON x.lang = cut.lang AND x.gram = one JOIN g AS y ON y.lang = cut.lang AND y.gram = two),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, j) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS b FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM c WHERE k = 3)
  GROUP BY ALL),
e AS (SELECT b.* FROM b LEFT JOIN longer ON longer.lang = b.lang AND longer.phrase = b.gram WHERE longer.b IS NULL OR 100 * longer.b < 50 * a)
SELECT e.lang, row_number() OVER (PARTITION BY e.lang ORDER BY score DESC, a DESC, encode(gram)) AS rank, gram AS phrase, a, l, r, n, score
FROM e JOIN total USING (lang) QUALIFY rank <= 2000
"""

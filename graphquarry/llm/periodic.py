"""Periodic runs of words in documents, found by heavy and light lag counting.

A run of period q and length n >= 4 q holds n - q pairs of equal words q apart, so only lags with that
many matches are worth a look. The matches of every lag are counted exactly, in two parts: words that
are frequent in the document by autocorrelation, with one forward FFT for each, their powers added up and
one inverse FFT for all; rare words by the differences of their own positions. Lags that reach their
threshold are scanned for islands of consecutive matches, which are the maximal runs.

A document is worked on by itself, in the task that reads it; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, settle, spread

LEAST, TIMES = 6, 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Small integers that are equal where the words are."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)


def lag_matches(ids: np.ndarray, most: int, heavy: int | None = None) -> np.ndarray:
    """matches[q], q up to ``most``: at how many places the word q further on is the same. heavy: counts above it go to the FFT."""
    n = len(ids)
    out = np.zeros(most + 1, np.int64)
    order = np.argsort(ids, kind="stable")
    at, word = order.astype(np.int64), ids[order]
    counts = np.bincount(ids)
    # light words: the k-th next place of the same word, for k below the largest light count
    heavy = max(32, int(n**0.5)) if heavy is None else heavy
    light = counts[word] <= heavy
    a, w = at[light], word[light]
    for k in range(1, int(counts[w].max(initial=0))):
        gap = (a[k:] - a[:-k])[w[k:] == w[:-k]]
        out += np.bincount(gap[gap <= most], minlength=most + 1)
    often = np.flatnonzero(counts > heavy)
    if len(often):
        size = 1 << int(n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        for x in often:
            f = np.fft.rfft((ids == x).astype(np.float64), size)
            power += f.real * f.real + f.imag * f.imag
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    return out


def runs_of(ids: np.ndarray, heavy: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start, then period.

    A stretch of period q that also has a smaller period has one that divides q (both fit in it twice), is as
    long for that, and so was found at the smaller lag.
    """
    n, found = len(ids), {}
    if n < LEAST:
        return []
    most = n // TIMES
    lags = np.arange(most + 1)
    need = np.maximum(LEAST, TIMES * lags) - lags
    for q in np.flatnonzero(lag_matches(ids, most, heavy)[1:] >= need[1:]) + 1:
        same = np.zeros(n - q + 2, np.int8)
        same[1:-1] = ids[:-q] == ids[q:]
        edges = np.flatnonzero(same[1:] != same[:-1])
        begin, size = edges[::2], edges[1::2] - edges[::2]
        long = size >= need[q]
        for s, m in zip(begin[long].tolist(), size[long].tolist()):
            found.setdefault((s, m + int(q)), int(q))
    return sorted((s, m, q) for (s, m), q in found.items())


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, m, q in runs:
        edge[s + q] += 1
        edge[s + m] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed): one row for each row of ``docs``.

    Words are what ASCII white space separates. A run is a stretch of consecutive words with smallest period q
    and a length of max(6, 4 q) or more that can't grow; runs come by start, then period. collapsed: the
    words that no run holds after its first q words, joined by one space. Null text: no words; a null
    doc_id stays null; repeated rows and ids are judged row by row. Extra columns are ignored; an empty table
    gives no rows. The memory of a task grows with its longest document alone.
    """
    arrow_limits(docs.sparkSession)

    def run(batches):
        for b in batches:
            n, found, kept = [], [], []
            for t in b.column(1).to_pylist():
                words = (t or "").encode().split()
                runs = runs_of(word_ids(words))
                n.append(len(words))
                found.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                kept.append(b" ".join(collapse(words, runs)).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])
        settle()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(rows).mapInArrow(run, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) whose texts are words joined by one space; those with crc32(doc_id) % 10 = 0 repeat from some word on.

    With g = crc32 div 10 and n words, the words from a = g % n on repeat with a period of 1 + (n - a) div (3 + g % 8).
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = rows.select("doc_id", "text", F.when(F.col("h") % 10 == 0, words).alias("w"), F.expr("h div 10").alias("g"))
    n = F.size("w")
    at = chosen.withColumn("a", F.when(n > 0, F.expr("cast(g % size(w) as int)")))
    at = at.withColumn("p", F.expr("cast(1 + (size(w) - a) div (3 + g % 8) as int)"))
    text = F.when(F.col("a").isNotNull(), F.array_join(F.expr("transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)]))"), " ")).otherwise(F.col("text"))
    return at.select("doc_id", text.alias("text"))


def op12(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out = periodic_runs(planted(docs))
    best = F.expr("aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), try_element_at(runs, 1), (b, x) -> if(x.length * b.period > b.length * x.period, x, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    out = out.withColumn("b", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = """
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
h AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                                 lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT DISTINCT doc_id FROM documents), crc_table),
d AS (
  SELECT doc_id, h.h % 10 AS turn, h.h // 10 AS g,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents LEFT JOIN h USING (doc_id)),
e AS (SELECT *, len(w) AS n, CASE WHEN turn = 0 AND len(w) > 0 THEN g % len(w) END AS a FROM d),
f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
t AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(w, lambda x, i: CASE WHEN i - 1 < a THEN x ELSE w[a + (i - 1 - a) % p + 1] END) END AS w
  FROM f),
o AS (SELECT doc_id, n, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS x FROM t),
pairs AS (
  SELECT o.doc_id, o.n, o.i, r.i - o.i AS q FROM o JOIN o AS r ON o.doc_id = r.doc_id AND o.x = r.x AND r.i > o.i AND 4 * (r.i - o.i) <= o.n),
lags AS (SELECT doc_id, q FROM pairs GROUP BY doc_id, q HAVING count(*) >= greatest(6, 4 * q) - q),
isl AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs SEMI JOIN lags USING (doc_id, q)),
stretch AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q FROM isl GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length),
best AS (
  SELECT doc_id, start, length, period FROM runs r
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DECIMAL(38, 9) / period DESC, start, period) = 1),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS words FROM o ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

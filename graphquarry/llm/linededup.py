"""Line dedup over range-partitioned hashes.

Line hashes are range-partitioned and sorted by hash, document and position, the largest document
first. Each partition streams over its rows: the first row of a hash is in the document that keeps
the line, and the documents are counted as they go by. A hash with more rows than a partition should
hold is found by a sketch beforehand, and its documents are dealt to several ranges, whose firsts and
counts are merged. The verdicts go back as one compressed bitmap for each document: only the 64-line
words that lose a line are stored.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_parts, stash

_STRIP = " \t\n\x0b\x0c\r"


def line_key(line):
    """The line stripped of ASCII white space, A-Z in lower case, other letters as they are."""
    bare = F.btrim(line, F.lit(_STRIP))
    plain = F.octet_length(bare) == F.length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hot(lines: DataFrame, limit: float) -> DataFrame:
    """(hot, pieces): the hashes with more than ``limit`` rows, a thousand at most, and into how many pieces each goes.

    By a sketch of bounded size, which can't miss a hash with a five-thousandth of all rows.
    """
    spark = lines.sparkSession
    found = lines.selectExpr("approx_top_k(h1, 1000, 10000) AS top").first()["top"] or []
    hot = [(r["item"], int(-(-r["count"] // limit))) for r in found if r["count"] > limit]
    values = ", ".join(f"named_struct('hot', {h}L, 'pieces', {n})" for h, n in hot if h != -(2**63))
    return spark.sql(f"SELECT inline(array({values}))" if values else "SELECT 0L AS hot, 1 AS pieces WHERE false")


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, part_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, text_hash, n_dropped, words map<int,bigint>): one row for each document that loses lines.

    Bit i of words[w] set: line 64 w + i goes; a word that isn't there loses none. A line's key of
    ``min_chars`` code points or more that ``min_docs`` documents or more hold loses all its lines,
    but for those in the largest doc_id that holds it. Null text: one empty line. Rows that share a
    doc_id are one document in the counts; null doc_ids are one more document, never the largest.
    ``part_rows``: about as many lines go to a task at most.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
    keyed = rows.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    lines = stash(keyed.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "lines")
    n = lines.count()
    parts = max(shuffle_parts(spark), -(-n // part_rows))
    hot = F.broadcast(_hot(lines, max(1000, n / parts)))  # a thousand rows at most
    ranges = 8 * parts  # of hashes; several make up a partition
    pieces = F.coalesce("pieces", F.lit(1))
    dealt = lines.join(hot, F.col("h1") == F.col("hot"), "left").select(
        F.floor(F.shiftrightunsigned("h1", 32) * ranges / 2**32).cast("int").alias("slot"), F.pmod(F.xxhash64("doc_id"), pieces).cast("int").alias("piece"),
        (pieces > 1).alias("split"), "h1", "h2", "doc_id", "text_hash", "pos",
    )
    own = Window.partitionBy("slot", "piece", "h1", "h2")
    order = own.orderBy(F.desc_nulls_last("doc_id"), "pos")
    placed = dealt.repartitionByRange(parts, "slot", "piece")
    streamed = placed.withColumn("place", F.row_number().over(order)).withColumn("holder", F.first("doc_id").over(order))
    streamed = streamed.withColumn("nth", F.dense_rank().over(own.orderBy(F.desc_nulls_last("doc_id"))))
    shared = streamed.withColumn("held_by", F.max("nth").over(own)).filter((F.col("held_by") >= min_docs) | F.col("split"))
    shared = stash(shared.select("h1", "h2", "doc_id", "text_hash", "pos", "split", "place", "holder", "held_by"), "shared-lines")
    whole = shared.filter(~F.col("split")).select("doc_id", "text_hash", "pos", "holder")
    merged = shared.filter(F.col("split") & (F.col("place") == 1)).groupBy("h1", "h2").agg(F.max("holder").alias("most"), F.sum("held_by").alias("docs"))
    merged = merged.filter(F.col("docs") >= min_docs).select(F.col("h1").alias("a"), F.col("h2").alias("b"), "most")
    split = shared.filter("split").join(merged, (F.col("h1") == F.col("a")) & (F.col("h2") == F.col("b")))
    every = whole.unionByName(split.select("doc_id", "text_hash", "pos", F.col("most").alias("holder")))
    gone = every.filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
    bit = F.expr("shiftleft(1L, pos % 64)")
    words = gone.groupBy("doc_id", "text_hash", F.expr("cast(pos div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words")
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, max_broadcast: int = 200_000) -> DataFrame:
    """(doc_id, text, kept_text, n_lines, n_dropped): one row for each row of ``docs``.

    ``max_broadcast``: up to so many words of bitmaps are sent to every task, beyond it the join
    shuffles; the result is the same. Null text: one empty line. Repeated rows lose the same lines;
    texts that share a doc_id have bitmaps of their own. Extra columns are ignored; an empty table
    gives no rows.
    """
    maps = stash(drop_bitmaps(docs, id_col, text_col, min_chars, min_docs), "bitmaps")
    if (maps.agg(F.sum(F.size("words"))).first()[0] or 0) <= max_broadcast:
        maps = F.broadcast(maps)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    maps = maps.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "n_dropped", "words")
    both = rows.join(maps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> (shiftright(coalesce(try_element_at(words, cast(i div 64 as int)), 0L), i % 64) & 1L) = 0), '\\n')")
    return both.select(
        "doc_id", "text", F.when(F.col("words").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
        F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def op9(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
v AS (SELECT k.*, coalesce(k.doc_id <> c.holder, false) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM v GROUP BY doc_id
"""

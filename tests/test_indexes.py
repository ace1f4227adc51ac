"""Stored indexes and keyed tables: equal to a full rebuild or a full search, and only what is needed is read and written."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphquarry.functions.text import plain_tokens
from graphquarry.operators import graph as g
from graphquarry.operators import search as s
from graphquarry.operators.postings import KeywordIndex
from graphquarry.operators.statistics import percentiles
from graphquarry.operators.substrings import SubstringIndex, grams
from graphquarry.operators.vector_index import VectorIndex
from graphquarry.streaming.references import ReferenceCounts, collect_garbage
from graphquarry.streaming.tables import KeyedTable, update_index

ROW = "k long, at long, v string, del boolean"


# -- keyed tables ---------------------------------------------------------------------------------
def rebuilt(batches):
    """{key: value} after all rows, by version; a deletion wins among equal versions, then the larger value."""
    top = {}
    for k, at, v, gone in sorted((r for b in batches for r in b), key=lambda r: (r[1], r[3], r[2])):
        top[k] = None if gone else v
    return {k: v for k, v in top.items() if v is not None}


def random_batches(rng, n=3, size=60):
    return [[(rng.randrange(40), rng.randrange(50), f"v{rng.randrange(1000)}", rng.random() < 0.25) for _ in range(size)] for _ in range(n)]


def keyed(spark, path, buckets=16):
    return KeyedTable(spark, str(path), "k long, at long, v string", ["k"], ["at"], buckets)


def test_merged_batches_equal_a_rebuild(spark, tmp_path):
    batches = random_batches(random.Random(1))
    t = keyed(spark, tmp_path)
    assert t.rows().collect() == []
    for n, b in enumerate([batches[0], batches[2], batches[2], batches[1]]):
        t.merge(spark.createDataFrame(b, ROW), n, F.col("del"))
    assert {r["k"]: r["v"] for r in t.rows().collect()} == rebuilt(batches)
    before = rebuilt(batches)
    assert t.vacuum() > 0
    assert {r["k"]: r["v"] for r in t.rows().collect()} == before


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = keyed(spark, tmp_path, 64)
    t.merge(spark.range(5000).selectExpr("id AS k", "1L AS at", "'a' AS v"), 0)
    said = t.merge(spark.createDataFrame([(7, 2, "b", False), (9, 2, "c", True)], ROW), 1, F.col("del"))
    assert said["touched"] <= 2 and said["buckets"] == 64
    assert len([d for d in os.listdir(tmp_path / "data" / "1") if d.startswith("_bucket=")]) == said["touched"]
    assert t.rows().count() == 4999 and t.rows().filter("k = 7").first()["v"] == "b"


def test_a_batch_that_broke_off_runs_again(spark, tmp_path):
    t = keyed(spark, tmp_path)
    one, two = random_batches(random.Random(5), 2)
    t.merge(spark.createDataFrame(one, ROW), 0, F.col("del"))
    t.merge(spark.createDataFrame(two, ROW), 1, F.col("del"))
    os.remove(tmp_path / "manifest" / "1" / "_SUCCESS")  # its data are there, but it never ended
    assert {r["k"]: r["v"] for r in t.rows().collect()} == rebuilt([one])
    t.merge(spark.createDataFrame(two, ROW), 1, F.col("del"))
    assert {r["k"]: r["v"] for r in t.rows().collect()} == rebuilt([one, two])


def test_a_stream_fills_the_table(spark, tmp_path):
    batches = random_batches(random.Random(8))
    for n, b in enumerate(batches):
        spark.createDataFrame(b, ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = keyed(spark, tmp_path / "table")
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        q = stream.writeStream.foreachBatch(t.sink(F.col("del"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r["k"]: r["v"] for r in t.rows().collect()} == rebuilt(batches)


def test_update_moves_recency_and_drops_links(spark, tmp_path):
    files = KeyedTable(spark, str(tmp_path / "f"), "file_id long, hash string, at long", ["file_id"], ["at"], 4)
    links = KeyedTable(spark, str(tmp_path / "l"), "file_id long, commit_id long, day long, at long", ["file_id", "commit_id"], ["at"], 4, ["file_id"], (["file_id"], [F.desc("day"), "commit_id"], "recency"))
    f = lambda rows: spark.createDataFrame(rows, "file_id long, hash string, at long")
    c = lambda rows: spark.createDataFrame(rows, "file_id long, commit_id long, day long, at long")
    d = lambda rows: spark.createDataFrame(rows, "file_id long, at long")
    update_index(files, links, f([(1, "a", 1), (2, "b", 1), (3, "c", 1)]), d([]), c([(1, 10, 5, 1), (1, 11, 6, 1), (2, 10, 5, 1)]), 0)
    assert sorted(tuple(r) for r in links.rows().select("file_id", "commit_id", "recency").collect()) == [(1, 10, 2), (1, 11, 1), (2, 10, 1)]
    update_index(files, links, f([(3, "c2", 2)]), d([(2, 2)]), c([(1, 12, 7, 2), (1, 9, 5, 2), (3, 12, 7, 2)]), 1)
    assert sorted(tuple(r) for r in links.rows().select("file_id", "commit_id", "recency").collect()) == [(1, 9, 3), (1, 10, 4), (1, 11, 2), (1, 12, 1), (3, 12, 1)]
    assert sorted(tuple(r) for r in files.rows().select("file_id", "hash").collect()) == [(1, "a"), (3, "c2")]


# -- keyword index --------------------------------------------------------------------------------
def words(rng, n):
    return " ".join(f"w{min(rng.randrange(300), rng.randrange(300))}" for _ in range(n))


def test_keyword_index(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([3, 10, 50, 200]))) for i in range(600)] + [(900, None), (901, ""), (902, "camelCase HTTPServer w1")]
    rows += [(1000 + i, "rare w3 w3 w3") for i in range(3)] + [(2000 + i, "w1 w299 " * 12) for i in range(12)]
    files = spark.createDataFrame(rows, "file_id long, skeleton string")
    queries = spark.createDataFrame([(0, "w1 w299"), (1, "rare"), (2, "rare w5"), (3, "nothing-of_it"), (4, "camel"), (5, "w0 w0 w1 w2 w3 w4")], "query_id long, query string")
    index = KeywordIndex(spark, str(tmp_path), parts=4)
    index.add(files.filter("file_id % 3 = 0"), 0, 8).add(files.filter("file_id % 3 > 0"), 1, 8)
    index.add(files.filter("file_id % 3 > 0"), 1, 8)  # again: the segment replaces itself
    want = {(r["query_id"], r["file_id"]): r["score"] for r in s.bm25_scores(files, queries).collect()}
    got = {(r["query_id"], r["file_id"]): r["score"] for r in index.scores(queries).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    for k in (1, 10):
        top, report = index.search(queries, k, 2)
        best = {}
        for (q, f), score in want.items():
            best.setdefault(q, []).append((-round(score, 9), f))
        assert sorted((r["query_id"], r["rank"], r["file_id"]) for r in top.collect()) == sorted((q, i + 1, f) for q, x in best.items() for i, (_, f) in enumerate(sorted(x)[:k]))
        said = {r["query_id"]: (r["blocks"], r["unread"]) for r in report.collect()}
        assert 1 <= said[1][0] <= 3 and all(0 <= unread < blocks for blocks, unread in said.values())
        assert said[0][1] > 0.5 * said[0][0]  # no other file comes near those that repeat both words


def test_both_tokenizers_agree(spark):
    texts = ["camelCaseHTTP2Server x_y", "ÀÉ éA aÉb", "İstanbul ẞ K ſ", "a1B2c3", "", " ", "日本A語b", "ΑΣ σας", "\x00Ab\ncD", "ǅx ﬁA", "1A a١b"]
    from graphquarry.functions.text import code_tokens

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", code_tokens(F.col("t")).alias("x")).collect()
    assert {r["i"]: list(r["x"]) for r in rows} == {i: plain_tokens(t) for i, t in enumerate(texts)}


# -- vector index ---------------------------------------------------------------------------------
def clustered(n, dim, groups, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dim))
    return centre[rng.integers(0, groups, n)] + 0.25 * rng.normal(size=(n, dim))


def brute(x, ids, q, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ (q / np.linalg.norm(q))
    return [ids[i] for i in sorted(range(len(ids)), key=lambda i: (-round(float(sim[i]), 9), ids[i]))[:k]]


def test_vector_index(spark, tmp_path):
    x = clustered(3000, 16, 40, 1)
    x[1000:2000] = x[1000]  # a third of all are equal: one hot cell, and ties
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(x)]
    frame = spark.createDataFrame([*rows, (9001, None, 0), (9002, [0.0] * 16, 0), (9003, [1.0], 0)], "vec_id long, embedding array<double>, kind int")
    index = VectorIndex(spark, str(tmp_path), 16, parts=4).fit(frame, cells=40).add(frame.filter("vec_id < 1500"), 0).add(frame.filter("vec_id >= 1500"), 1)
    asked = [(q, x[q].tolist()) for q in (0, 5, 1000, 2500, 2999)] + [(77, [0.0] * 16)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    ids = list(range(3000))

    def run(**o):
        out = {}
        for r in index.search(queries, 10, block=256, **o).collect():
            out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        return {q: [v for _, v in sorted(found)] for q, found in out.items()}

    assert run() == {q: brute(x, ids, x[q], 10) for q, v in asked[:-1]}
    some = [i for i in ids if i % 4 == 2]
    assert run(where=F.col("kind") == 2) == {q: brute(x[some], some, x[q], 10) for q, v in asked[:-1]}
    narrow = run(probes=3)
    hits = [len(set(narrow[q]) & set(brute(x, ids, x[q], 10))) for q, _ in asked[:-1]]
    assert sum(hits) >= 0.9 * 50


def test_narrow_probing_keeps_recall_and_reads_few_originals(spark, tmp_path):
    x = clustered(4000, 32, 64, 2)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = VectorIndex(spark, str(tmp_path), 32, parts=4).fit(frame, cells=64).add(frame)
    asked = list(range(0, 4000, 40))
    queries = frame.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = {}
    for r in index.search(queries, 10, probes=6).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = sum(len(found[q] & set(brute(x, list(range(4000)), x[q], 10))) for q in asked)
    assert hit / (10 * len(asked)) >= 0.9


# -- substring index ------------------------------------------------------------------------------
def test_grams(spark):
    rows = [(0, "abcabc"), (1, "ab"), (2, ""), (3, "AbÇd"), (4, None)]
    got = {r["i"]: r["g"] for r in spark.createDataFrame(rows, "i int, t string").select("i", grams(F.col("t")).alias("g")).collect()}
    assert got == {0: ["abc", "bca", "cab"], 1: [], 2: [], 3: ["abç", "bçd"], 4: None}


def test_substring_index(spark, tmp_path):
    texts = ["class Foo extends my_base", "mybase", "MY_BASE", "ΟΔΟΣ ΑΣΤΡΑ", "οδος", "İstanbul", "Kelvin K", "aaaa", "", None, "100% sure", "x" * 50_000 + "needle", "étÉ été", "a\nb\nc"]
    patterns = ["my_base", "base", "ΟΔΟΣ", "ΑΣ", "İst", "kelvin", "aa", "aaa", "", "%", "needle", "été", "a\nb", "none of these", "xxxxneedle"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = [(2 * i + f, p, bool(f)) for i, p in enumerate(patterns) for f in (0, 1)]
    index = SubstringIndex(spark, str(tmp_path), parts=4).add(rows.filter("id % 2 = 0"), 0, 2).add(rows.filter("id % 2 = 1"), 1)
    queries = spark.createDataFrame(asked, "pattern_id int, pattern string, fold boolean")
    got = sorted(map(tuple, index.search(rows, queries).collect()))
    plain = rows.crossJoin(queries).filter("text is not null and if(fold, contains(lower(text), lower(pattern)), contains(text, pattern))")
    assert got == sorted(map(tuple, plain.select("pattern_id", "id").collect()))
    few = index.candidates(queries.filter("pattern = 'needle'"))
    assert {r["id"] for r in few.collect()} == {11}


# -- reference counts -----------------------------------------------------------------------------
def test_reference_counts_follow_changes(spark, tmp_path):
    rng = random.Random(4)
    t = ReferenceCounts(spark, str(tmp_path), 8)
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "name string")
    names = [f"h{i}" for i in range(40)]
    have = [rng.choice(names) for _ in range(60)]
    t.apply(0, frame(have), names=frame(names))
    for n in (1, 2):
        go = [have.pop(rng.randrange(len(have))) for _ in range(15)]
        come = [rng.choice(names) for _ in range(5)]
        have += come
        t.apply(n, frame(come), frame(go))
        t.apply(n, frame(come), frame(go))  # again, after a failure
        assert {r["name"] for r in t.orphans().collect()} == set(names) - set(have)
    want = set(names) - set(have)
    assert t.sweep(4, dry_run=True)[0] == len(want) and t.sweep(4)[0] == len(want) and t.sweep(5)[0] == 0
    back = sorted(want)[0]
    t.apply(6, frame([back]))
    assert {r["name"]: r["refs"] for r in t.rows().collect()} == {x: have.count(x) for x in set(have)} | {back: 1}
    touched = t.apply(7, frame([]), frame([back]))
    assert touched["touched"] == 1 and [r["name"] for r in t.orphans(since=7).collect()] == [back]


def test_collected_packages_free_their_blobs(spark, tmp_path):
    blobs, packages = ReferenceCounts(spark, str(tmp_path / "b"), 4), ReferenceCounts(spark, str(tmp_path / "p"), 4)
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "name string")
    held = spark.createDataFrame([("p1", "a"), ("p1", "b"), ("p2", "b")], "package string, name string")
    blobs.apply(0, frame(["a", "b", "b", "c"]), names=frame(["d"]))
    packages.apply(0, frame(["p2"]), names=frame(["p1"]))
    assert collect_garbage(packages, blobs, held, 1, dry_run=True) == {"packages": 1, "blobs": 1}
    assert collect_garbage(packages, blobs, held, 1) == {"packages": 1, "blobs": 2}
    assert {r["name"]: r["refs"] for r in blobs.rows().collect()} == {"b": 1, "c": 1}


# -- order statistics -----------------------------------------------------------------------------
def test_percentiles_narrow_down(spark):
    rng = np.random.default_rng(1)
    groups = {"hot": np.exp(rng.normal(size=12_000) * 8), "ties": np.repeat([1.0, 2.0, 3.0], [9000, 1, 4000]), "one": np.array([5.0]), None: np.arange(50.0), "flat": np.full(3000, 7.0)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("one", None), ("one", float("nan")), ("none", None)]
    frame = spark.createDataFrame(rows, "k string, x double")
    shares = [0.0, 0.5, 0.69, 0.999, 1.0]
    want = sorted((str(k), s, float(np.sort(v)[min(int(len(v) * s), len(v) - 1)]), len(v)) for k, v in groups.items() for s in shares)
    for few in (10_000, 50):
        got = sorted((str(r["k"]), r["share"], r["value"], r["n"]) for r in percentiles(frame, ["k"], "x", shares, few).collect())
        assert got == want


# -- walks and candidate paths --------------------------------------------------------------------
@pytest.mark.parametrize("inward", [False, True])
def test_scoped_walk_of_many_seeds(spark, inward):
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(260)] + [(1, None)]
    scope = {i for i in range(120) if i % 4}
    out = {}
    for a, b in edges:
        if b is not None:
            out.setdefault(b if inward else a, set()).add(a if inward else b)
    want = set()
    for seed in range(0, 120):  # more seeds than bits in a word
        seen, level = {seed}, {seed}
        for depth in range(1, 6):
            level = {y for x in level for y in out.get(x, ()) if y in scope} - seen
            seen |= level
            want |= {(seed, y, depth) for y in level}
    e = spark.createDataFrame(edges, "source_file_id long, resolved_file_id long")
    ids = spark.range(120).withColumnRenamed("id", "file_id")
    got = g.trace_imports(e, ids, 5, inward=inward, scope=ids.filter("file_id % 4 > 0"))
    assert {tuple(r) for r in got.select("seed", "file_id", "depth").collect()} == want
    assert got.count() == len(want)


def test_a_path_that_many_repositories_have(spark):
    files = spark.range(1, 400).selectExpr("id AS repo_id", "'src/utils/index.ts' AS file_path").unionByName(spark.createDataFrame([(500, "lib/own.ts")], "repo_id long, file_path string"))
    packages = spark.createDataFrame([(i, "utils", "x.ts") for i in range(1, 20)] + [(30, "other", "y.ts")], "repo_id long, package string, entry string")
    asked = spark.createDataFrame([(r, r, "utils/index" if r % 2 else "utils") for r in (1, 2, 3, 50, 600)] + [(700, 700, "lib/own")], "repo_id long, source_file long, imported_module string")
    got = sorted(tuple(r) for r in g.cross_repo_edges(asked, packages, files).select("source_repo", "target_repo", "target_file").collect())
    # the module names the packages of 1 to 19, where only the package counts; 20 is the lowest other repository with the path
    assert got == [(1, 20, "src/utils/index.ts"), (2, 20, "src/utils/index.ts"), (3, 20, "src/utils/index.ts"), (50, 20, "src/utils/index.ts"), (600, 20, "src/utils/index.ts"), (700, 500, "lib/own.ts")]

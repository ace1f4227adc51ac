"""What a step takes must not grow faster than its input: bounds on parts, shuffles and pairs that are scored."""

import numpy as np
import pyarrow as pa
import pytest

from graphquarry.functions import vectors as vx
from graphquarry.operators import evaluation as e
from graphquarry.operators import search as s
from graphquarry.plans import registry
from graphquarry.sources.projection import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    """Table sizes at which Spark broadcasts nothing by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_drift_does_not_group_files_by_their_folders_vector(spark, no_broadcast):
    assert "hashpartitioning(summary_vec" not in plan(registry.QUERIES["drift"](spark, SF))


def test_files_are_not_shuffled_by_repository(spark, no_broadcast):
    assert "hashpartitioning(source" not in plan(Views(spark, SF).files)


def test_links_of_a_file_carry_no_vector_through_a_shuffle(spark, no_broadcast):
    v = Views(spark, SF)
    sums = s.commit_vectors(v.file_commits, v.commits, vx.good_vectors(v.table("embeddings"), 64), 64, s.Scoring())
    assert "hashpartitioning(vec_id" not in plan(sums) and plan(v.file_commits).count("Exchange hashpartitioning(commit_id") == 2


def test_keyword_sums_are_taken_in_bounded_parts():
    rng = np.random.default_rng(1)
    n_asks = rng.integers(0, 9, 50)
    lists = [rng.choice(50, rng.integers(1, 40), replace=False).tolist() for _ in range(500)]
    x = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(lists, pa.list_(pa.int32()))], ["file_id", "terms"])
    parts = list(s._bounded(x, n_asks, 200, 1000))
    assert [i for p in parts for i in p.column("file_id").to_pylist()] == list(range(500))
    pairs = [sum(n_asks[t].sum() for t in p.column("terms").to_pylist()) for p in parts]
    assert max(pairs) <= 1000 + 9 * 40 and len(parts) > 30
    assert not len(list(s._bounded(x.slice(0, 0), n_asks, 200)))


def test_a_sweep_scores_few_pairs_and_finds_the_best(spark):
    rng = np.random.default_rng(3)
    n, m = 3000, 7
    ext = np.array([".py", ".go", ".ts", ".java"])[rng.integers(0, 4, n)]
    raw = {"sim": rng.normal(0, 0.15, (n, m)), "commit_boost": rng.normal(0, 0.3, (n, m)), "folder": np.maximum(rng.normal(0.1, 0.2, (n, m)), 0), "log_length": np.repeat(rng.exponential(0.4, (n, 1)), m, axis=1), "keyword": rng.random((n, m)) ** 6}
    configs = [(name, s.merge_scoring(s.Scoring(), c)) for name, c in e.grid().items()]
    values = {(j, x): s.profile_values(ext, j, x) for _, c in configs for j, x in ((0, c.beta), (1, c.parent_multiplier))}
    kept, scored, found = {}, 0, {}
    for at in (0, 1500):
        half = {c: x[at : at + 1500] for c, x in raw.items()}
        own = {k: x[at : at + 1500] for k, x in values.items()}
        for group, rows in s._contenders(half, own, configs, 10, kept):
            pick = np.maximum(rows, 0)
            mine = {c: x[pick, np.arange(m)] for c, x in half.items()}
            for i in group:
                c = configs[i][1]
                score = s.FileScorer.weighed(mine, own[0, c.beta][pick], own[1, c.parent_multiplier][pick], c)
                score[rows < 0] = -np.inf
                scored += score.size
                place, q = np.nonzero(s._passing(score, c.min_score, 10, kept, i))
                for r, y, x in zip(rows[place, q] + at, q, score[place, q]):
                    found.setdefault((i, y), []).append((-x, r))
    for i, (_, c) in enumerate(configs):
        score = s.FileScorer.weighed(raw, values[0, c.beta][:, None], values[1, c.parent_multiplier][:, None], c)
        for q in range(m):
            want = [(-score[r, q], r) for r in np.argsort(-score[:, q], kind="stable")[:10] if score[r, q] >= c.min_score]
            assert sorted(found.get((i, q), []))[:10] == want
    assert scored < n * m * len(configs) / 5


def shuffled(spark, run, what="shuffleWriteBytes"):
    """Bytes, or records, that the stages of ``run`` shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        stages = store.stageList(None, False, False, none, None)
        return sum(getattr(stages.apply(i), what)() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_file_batches_carry_counts_and_floats_and_score_as_lists_do(spark, monkeypatch):
    from pyspark.sql import functions as F

    v = Views(spark, SF)
    vectors, files = v.table("embeddings"), v.files.withColumn("skeleton", F.when(F.col("file_id") % 7 == 0, None).when(F.col("file_id") % 7 == 1, "").otherwise(F.col("skeleton")))
    queries = v.queries.withColumn("vec_id", F.when(F.col("query_id") % 3 == 0, -1).otherwise(F.col("vec_id")))  # a query without a vector finds nothing
    build = lambda: s.file_batches(files, v.directories, v.commits, v.file_commits, queries, vectors, 64, s.Scoring(min_score=0.0))
    counted = build()
    kinds = dict(counted.rows.dtypes)
    assert "scores" not in kinds and kinds["terms"] == "array<int>"  # before: a score for every query and file, written and shuffled
    assert kinds["v"] == kinds["concat"] == kinds["summary"] == "array<float>" and kinds["boost"] == "array<double>"
    asked_terms = s._asked_terms
    monkeypatch.setattr(s, "_asked_terms", lambda q, most: (asked_terms(q, most)[0], None))  # more terms than a task can hold
    listed = build()
    assert "scores" in dict(listed.rows.dtypes)
    a, b = [{(r["query_id"], r["file_id"]): (r["keyword"], r["final_score"]) for r in x.best(s.Scoring(min_score=0.0), 0).collect()} for x in (counted, listed)]
    assert a.keys() == b.keys() and len(a) > 1000 and not any(q % 3 == 0 for q, _ in a)
    assert all(np.allclose(a[k], b[k], rtol=0, atol=1e-9) for k in a) and max(x[0] for x in a.values()) > 0.9


def test_keyword_index_shuffles_counts_and_blocks_once(spark, tmp_path):
    from graphquarry.operators.postings import KeywordIndex

    v = Views(spark, "/root/testdata/sf0.01")
    files = v.files.select("file_id", "skeleton")
    text = files.selectExpr("sum(octet_length(skeleton))").first()[0]
    index = KeywordIndex(spark, str(tmp_path), parts=4)
    assert shuffled(spark, lambda: index.add(files)) < 4 * text  # 6.2 before, with a row for each count
    got = {(r["query_id"], r["file_id"]): r["score"] for r in index.scores(v.queries).collect()}
    one_by_one = KeywordIndex(spark, str(tmp_path), parts=4, max_pairs=0)  # more queries than a task can hold
    want = {(r["query_id"], r["file_id"]): r["score"] for r in one_by_one.scores(v.queries).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    best = [{(r["query_id"], r["rank"]): r["file_id"] for r in i.search(v.queries, 10)[0].collect()} for i in (index, one_by_one)]
    assert best[0] == best[1]


def test_keyword_index_shuffles_no_blocks(spark, tmp_path):
    from pyspark.sql import functions as F

    from graphquarry.operators.postings import KeywordIndex

    v = Views(spark, "/root/testdata/sf0.01")
    files = v.files.select("file_id", "skeleton").unionByName(spark.createDataFrame([(-1, ""), (-2, "..."), (-3, None), (-4, "a a b")], "file_id long, skeleton string"))
    text = files.selectExpr("sum(octet_length(skeleton))").first()[0]
    index = KeywordIndex(spark, str(tmp_path), parts=4, pairs_per_task=50_000)  # several tasks
    assert shuffled(spark, lambda: index.add(files)) < 1.6 * text  # also the texts, as they are one file; blocks stay where they are built
    rows = index.blocks.select("term", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p")).select("term", "p.ids", "p.tfs", "p.dls")
    tokens = files.select("file_id", s.code_tokens(F.col("skeleton")).alias("t")).select("file_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    want = tokens.groupBy("term", F.col("file_id").alias("ids"), "dl").agg(F.count("*").alias("tf")).select("term", "ids", F.col("tf").cast("int").alias("tfs"), F.col("dl").alias("dls"))
    assert rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty() and index.blocks.filter("n <> size(ids)").isEmpty()
    assert index.corpus()[0] == files.filter("skeleton is not null").count() and index.blocks.select("range").distinct().count() > 4


def test_grams_of_python_and_spark_agree_and_arent_shuffled_one_by_one(spark, tmp_path):
    from pyspark.sql import functions as F

    from graphquarry.operators import substrings as sub

    texts = ["", "ab", "abc", "ABCabc", "İé\U0001f600x\U0001f600xΣ ΑΣ", "a\0b\0c", "aaaaaa"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in df.select("id", F.lower("text").alias("low"), sub.grams(F.col("text")).alias("g")).collect():
        assert sorted(sub._gram_names(sub.gram_codes(r["low"]))) == sorted(r["g"]), texts[r["id"]]
    index = sub.SubstringIndex(spark, str(tmp_path), parts=2)
    rows = Views(spark, "/root/testdata/sf0.01").files.selectExpr("file_id AS id", "skeleton AS text")
    assert shuffled(spark, lambda: index.add(rows, ids_per_block=100)) < 2.5 * rows.selectExpr("sum(octet_length(text))").first()[0]
    blocks = index.postings.groupBy("gram", "block").count().filter("count > 1").count()
    assert blocks == 0 and index.postings.filter("n <> size(ids) or n > 100").count() == 0


def test_substring_index_takes_as_much_for_each_text_of_more_texts(spark, tmp_path):
    from graphquarry.operators.substrings import SubstringIndex

    took = []
    for n in (20_000, 200_000):
        rows = spark.range(0, n, 1, 10).selectExpr("xxhash64(id) AS id", "substr(sha2(cast(id AS string), 256), 1, 20) AS text")
        rows.write.parquet(f"{tmp_path}/rows-{n}")
        rows = spark.read.parquet(f"{tmp_path}/rows-{n}")
        index = SubstringIndex(spark, f"{tmp_path}/index-{n}", parts=2)
        moved = shuffled(spark, lambda: index.add(rows, ids_per_block=1000))  # noqa: B023
        took.append((moved, sum(x.stat().st_size for x in (tmp_path / f"index-{n}").rglob("*.parquet"))))
        found = index.search(rows, spark.createDataFrame([(0, "abcd", False)], "pattern_id int, pattern string, fold boolean"))
        assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in rows.filter("contains(text, 'abcd')").collect())
    assert took[1][0] < 11 * took[0][0] and took[1][1] < 11 * took[0][1]  # before: ids of 8 bytes, which only a small table's dictionary shortened


def test_substring_index_numbers_texts_within_blocks(spark, tmp_path):
    from graphquarry.operators.substrings import SubstringIndex

    rows = spark.range(0, 300_000, 1, 8).selectExpr("concat('k', id) AS id", "concat(id, ' xyz') AS text")  # more in a file than 2 bytes number, and ids that are text
    rows.write.parquet(f"{tmp_path}/rows")
    index = SubstringIndex(spark, f"{tmp_path}/index", parts=3).add(spark.read.parquet(f"{tmp_path}/rows"), ids_per_block=1 << 20)
    asked = spark.createDataFrame([(0, "9999 xyz", False), (1, "777", True), (2, "zyx", False)], "pattern_id int, pattern string, fold boolean")
    want = rows.crossJoin(asked).filter("contains(text, pattern)").select("pattern_id", "id")
    assert sorted(map(tuple, index.search(rows, asked).collect())) == sorted(map(tuple, want.collect()))
    assert index.postings.agg({"n": "max"}).first()[0] == 1 << 15 and index.postings.filter("n <> size(ids) or (gram = '') <> (members is not null)").isEmpty()


def test_numbering_shuffles_a_row_once(spark, no_broadcast):
    from graphquarry.operators import etl

    df = spark.range(20_000).selectExpr("id % 500 AS k", "id AS x")
    out = []
    assert shuffled(spark, lambda: out.extend(etl.numbered(df, ["k"], ["x"], "n").collect()), "shuffleWriteRecords") < 1.2 * 20_000
    assert sorted((r["k"], r["x"], r["n"]) for r in out) == [(k, k + 500 * i, i) for k in range(500) for i in range(40)]

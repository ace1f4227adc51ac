"""Small hand-made cases, among them the edges that shape each rule."""

from datetime import datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphquarry.functions import text as tx
from graphquarry.functions import vectors
from graphquarry.operators import access, etl, evaluation, filters, graph, search, skeleton
from graphquarry.streaming import jobs, limits


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_since_dates():
    now = datetime(2024, 3, 31, 12)
    assert filters.since_date("1m", now) == datetime(2024, 2, 29, 12)
    assert filters.since_date("1m", now, clamp=False) == datetime(2024, 3, 2, 12)
    assert filters.since_date("2w", now) == datetime(2024, 3, 17, 12)
    assert filters.since_date("2024-01-05T00:00:00Z", now) == datetime(2024, 1, 5)
    with pytest.raises(ValueError):
        filters.since_date("soon", now)


def test_extensions():
    assert filters.extensions(["TypeScript", "py", "foo", "python"]) == [".ts", ".tsx", ".py", ".foo"]


def test_ignore_rules(spark):
    paths = ["a/b.ts", "node_modules/x.ts", "src/gen/a.ts", "src/gen/keep.ts", "deep/node_modules/y.ts", "top.log", "x/top.log", "build/z.ts", "x/build/z.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    out = df.filter(filters.ignored(F.col("p"), ["node_modules/"], ["/src/gen/", "!src/gen/keep.ts", "*.log", "/build/"]))
    assert rows(out, "p") == sorted([(p,) for p in ("node_modules/x.ts", "deep/node_modules/y.ts", "src/gen/a.ts", "top.log", "x/top.log", "build/z.ts")])


def test_url_and_paths(spark):
    df = spark.createDataFrame([("git@Host.com:A/b.git",), ("https://host.com/A/b/",), ("ssh://git@host.com/A/b.git",)], "u string")
    assert {r[0] for r in df.select(tx.normal_url(F.col("u"))).collect()} == {"https://host.com/a/b"}
    p = spark.createDataFrame([("a/b/c.ts",), ("root.md",)], "p string")
    assert [r[0] for r in p.select(tx.ancestors(F.col("p"))).collect()] == [["a/b", "a", "."], ["."]]
    e = spark.createDataFrame([("a/B.TS",), ("a.b/Makefile",), ("x.tar.gz",)], "p string")
    assert [r[0] for r in e.select(tx.file_extension(F.col("p"))).collect()] == [".ts", ".txt", ".gz"]


def scored(s, exts, **raw):
    """(parts, final scores) of files with such extensions for one query."""
    b = pa.record_batch({"file_type": exts})
    column = {"sim": 0.0, "commit_boost": 0.0, "folder": 0.0, "log_length": 0.0, "keyword": 0.0} | raw
    parts = search.FileScorer.parts(b, {k: np.array(v if isinstance(v, list) else [v] * len(exts), float)[:, None] for k, v in column.items()}, s)
    return parts, search.FileScorer.final(b, parts, s)[:, 0]


def test_parent_boost_is_strict_and_children_need_two(spark):
    s = search.Scoring(min_score=0.3, hybrid=0.0)
    parts, final = scored(s, [".ts"] * 3, sim=0.5, folder=[0.3, 0.31, 0.31])
    assert parts["parent_boost"][:, 0].tolist() == [0.0, pytest.approx(0.093), pytest.approx(0.093)]
    dirs = spark.createDataFrame([(7, 1, "d", 0.3), (7, 1, "e", 0.31)], "query_id long, repo_id long, dir_path string, dir_sim double")
    children = spark.createDataFrame([(7, 1, "d", float(final[0]), 1), (7, 1, "e", float(final[1:].mean()), 2)], "query_id long, repo_id long, dir_path string, mean double, n long")
    d = dict(rows(search.with_children(dirs, children, s), "dir_path", "dir_score"))
    assert d["d"] == pytest.approx(0.3) and d["e"] == pytest.approx(0.31 + 0.1 * (0.5 + 0.2 * 0.093))


def test_score_grows_with_weights():
    f = lambda **k: scored(search.Scoring(**k), [".go"], sim=0.5, folder=0.6, commit_boost=0.4, keyword=1.0)[1][0]
    assert f(alpha=0.1) < f(alpha=0.2) < f(alpha=0.4)
    assert f(hybrid=0.0) < f(hybrid=0.5)
    assert f(length_weight=0.0) == f(length_weight=0.1)


def test_a_null_or_empty_skeleton_has_no_length_penalty(spark):
    files = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 4000), (4, "x" * 40)], "i int, skeleton string")
    avg = search.average_tokens(files).first()["avg_tokens"]
    got = dict(rows(files.select("i", search.length_penalty(F.col("skeleton"), F.lit(".ts"), F.lit(avg), 0.1).alias("p")), "i", "p"))
    assert avg == pytest.approx(505) and got == {1: 0.0, 2: 0.0, 3: pytest.approx(0.1 * np.log(1000 / 505)), 4: 0.0}


def test_a_query_set_beyond_its_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MAX_ASKED", 3)
    v = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    q = spark.range(4).selectExpr("id AS query_id", "1L AS vec_id")
    with pytest.raises(ValueError, match="more than 3"):
        vectors.ask(q, v, 1)
    assert len(vectors.ask(q.filter("query_id < 3"), v, 1)[0].names) == 3


def test_rerank_modes(spark):
    r = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 2), (1, 3, 0.7, 3)], "query_id long, file_id long, final_score double, rank int")
    imports = spark.createDataFrame([(1, 3), (2, 1)], "source_file_id long, resolved_file_id long")
    none = spark.createDataFrame([], "source_file long, target_file long")
    fc = spark.createDataFrame([(1, 5, 1), (3, 5, 3)], "file_id long, commit_id long, recency long")
    a = dict(rows(search.rerank(r, imports, none, fc, seeds=2), "file_id", "final_score"))
    assert a == {1: 0.9, 2: 0.8, 3: pytest.approx(0.7 + 0.05 + 0.04 / 4)}
    b = dict(rows(search.rerank(r, imports, none, fc, seeds=2, exclude_top=False), "file_id", "final_score"))
    assert b[1] == pytest.approx(0.95) and b[2] == pytest.approx(0.85)


def test_top_n_zero_is_all(spark):
    r = spark.createDataFrame([(1, i, 0.1 * i) for i in range(5)], "query_id long, file_id long, s double")
    assert search.top_n(r, "s", 0, "file_id").count() == 5


def test_trace_handles_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3), (3, None)], "source_file_id long, resolved_file_id long")
    s = spark.createDataFrame([(1,)], "file_id long")
    assert rows(graph.trace_imports(e, s, 10), "file_id", "depth") == [(2, 1), (3, 2)]
    assert rows(graph.trace_imports(e, s, 3, all_depths=True), "file_id", "depth") == [(1, 3), (2, 1), (3, 2), (3, 3)]
    assert rows(graph.trace_imports(e, s, 1, inward=True), "file_id", "depth") == [(3, 1)]
    with pytest.raises(ValueError):
        graph.trace_imports(e, s, 11)


IMPORTS = [
    (".ts", "import type { A } from './a';\nimport './side';\nconst b = require('b');\nimport('./dyn');\nimport {\n c } from \"c\";", ["./a", "c", "./side", "b", "./dyn"]),
    (".py", "import os.path\nfrom a.b import c\n  import no\nimport os.path", ["os.path", "a.b"]),
    (".go", 'import "fmt"\nimport (\n  "os"\n  x "github.com/a/b"\n)', ["fmt", "os", "github.com/a/b"]),
    (".rs", "use std::io::Read;\nmod foo;\nuse alone;", ["std::io", "foo"]),
    (".java", "import static a.B.c;\nimport x.y.*;", ["a.B.c", "x.y.*"]),
    (".kt", "import a.b.C", ["a.b.C"]),
    (".rb", "require 'json'\nrequire_relative \"x/y\"", ["json", "x/y"]),
    (".php", "use A\\B as C;\nrequire_once 'x.php';", ["A\\B", "x.php"]),
    (".lua", "local a = require('m.n')\nlocal b = require 'q'", ["m.n", "q"]),
    (".zig", 'const s = @import("std");', ["std"]),
    (".ex", "alias A.B\nalias C.{D, E}\nimport F\nuse G\nrequire H", ["A.B", "C", "C.D", "C.E", "F", "G", "H"]),
]


@pytest.mark.parametrize("ext,code,want", IMPORTS, ids=[i[0] for i in IMPORTS])
def test_extract_imports(spark, ext, code, want):
    df = spark.createDataFrame([(1, ext, code)], "file_id long, file_type string, content string")
    got = [r[0] for r in graph.extract_imports(df).select("imported_module").collect()]
    if ext == ".ex":
        assert set(want) - {"C"} <= set(got)
    else:
        assert sorted(got) == sorted(want)


def test_resolve_imports(spark):
    files = spark.createDataFrame([(1, p) for p in ("src/a.ts", "src/b/index.ts", "lib/c.js", "pkg/m/__init__.py", "pkg/n.py", "go/util/x.go", "go/util/y.go", "src/main/java/a/B.java", "src/main/java/p/Q.java", "lib/r.rb")], "repo_id int, file_path string")
    ask = [
        ("src/z.ts", "./a", "typescript", "src/a.ts"), ("src/z.ts", "./b", "typescript", "src/b/index.ts"), ("src/z.ts", "../lib/c.js", "typescript", "lib/c.js"), ("src/z.ts", "react", "typescript", None),
        ("src/q/z.ts", "../a.js", "typescript", "src/a.ts"), ("x.py", "pkg.m", "python", "pkg/m/__init__.py"), ("x.py", "pkg.n", "python", "pkg/n.py"), ("x.go", "github.com/me/go/util", "go", "go/util/x.go"), ("x.go", "fmt", "go", None),
        ("X.java", "a.B", "java", "src/main/java/a/B.java"), ("X.java", "p.*", "java", "src/main/java/p/Q.java"), ("x.rb", "r", "ruby", "lib/r.rb"), ("x.rs", "std::io", "rust", None),
    ]
    edges = spark.createDataFrame([(1, s, m, lang) for s, m, lang, _ in ask], "repo_id int, source_path string, imported_module string, language string")
    got = {(r["source_path"], r["imported_module"]): r["target_path"] for r in graph.resolve_imports(edges, files).collect()}
    assert got == {(s, m): t for s, m, _, t in ask}


def test_scopes(spark):
    repos = spark.createDataFrame([(1, "a", "/a"), (2, "b", "/b")], "repo_id long, name string, root_path string")
    assert rows(filters.resolve_repos(repos, ["zzz"], 2), "repo_id") == [(2,)]
    assert rows(filters.resolve_repos(repos, ["a", "/b"], 2), "repo_id") == [(1,), (2,)]
    assert rows(filters.resolve_repos(repos, "project", 9), "repo_id") == []


def test_tokens(spark):
    import hashlib

    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    t = spark.createDataFrame([(1, h("ok"), False, datetime(2030, 1, 1)), (2, h("old"), False, datetime(2020, 1, 1)), (3, h("off"), True, datetime(2020, 1, 1)), (4, h("ever"), False, None)], "token_id long, token_hash string, revoked boolean, expires_at timestamp")
    a = spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "token_id long, repo_id long")
    p = spark.createDataFrame([("ok",), ("old",), ("off",), ("who",), ("ever",)], "presented string")
    got = {r[0]: (r[1], r[2]) for r in access.validate(t, a, p, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {"ok": ("ok", "3,5"), "old": ("expired", None), "off": ("revoked", None), "who": ("not_found", None), "ever": ("ok", None)}


def test_tree_hash_ignores_order(spark):
    e = [(1, "b", "2"), (1, "a", "1")]
    f = lambda x: etl.tree_hash(spark.createDataFrame(x, "k int, relpath string, content_hash string"), ["k"]).first()[1]
    assert f(e) == f(e[::-1]) != f([(1, "b", "1"), (1, "a", "2")])


def test_git_log(spark):
    lines = spark.createDataFrame([("x", i, s) for i, s in enumerate(["h1", "first", "2024", "h2", "second", "2023"])], "log string, pos int, line string")
    assert rows(etl.git_log(lines), "n", "commit_hash", "message", "date") == [(0, "h1", "first", "2024"), (1, "h2", "second", "2023")]


def test_metrics_for_an_empty_expectation(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (3, 5, 1)], "query_id long, file_id long, rank int")
    want = spark.createDataFrame([(1, 11), (2, 4)], "query_id long, file_id long")
    got = {r["query_id"]: r for r in evaluation.metrics(ranked, want).collect()}
    assert got[1]["mrr"] == 0.5 and got[1]["hit5"] == 1.0 and got[1]["p5"] == pytest.approx(0.2)
    assert got[2]["recall"] == 0.0 and got[3]["mrr"] == 0.0


def test_limiters():
    log = limits.SlidingLog(2, 10)
    assert [log(t) for t in (0, 1, 2, 10.5, 10.6, 11.1)] == ["accepted", "accepted", "rejected", "accepted", "rejected", "accepted"]
    b = limits.TokenBucket(2, 10)
    assert [b(t) for t in (0, 0, 0, 4, 5, 30)] == ["accepted", "accepted", "rejected", "rejected", "accepted", "accepted"]
    c = limits.LruTtl(2, 10)
    assert [c(t, v) for t, v in ((0, "a"), (9, "a"), (11, "a"), (12, "b"), (13, "c"), (14, "a"))] == ["miss", "hit", "miss", "miss", "miss", "miss"]


def test_fold_equals_a_loop(spark):
    import random

    rng = random.Random(3)
    ev = [(rng.choice("abc"), i, datetime.fromtimestamp(1_700_000_000 + rng.randint(0, 500))) for i in range(400)]
    df = spark.createDataFrame(ev, "k string, i int, ts timestamp")
    got = {r["tie"]: r["outcome"] for r in limits.fold(df, "k", "ts", "i", lambda: limits.SlidingLog(3, 60)).collect()}
    want, state = {}, {}
    for k, i, t in sorted(ev, key=lambda e: (e[2], e[1])):
        want[i] = state.setdefault(k, limits.SlidingLog(3, 60))(t.timestamp())
    assert got == want


def test_streams_equal_batches(spark, tmp_path):
    ev = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, m), float(m)) for m in range(0, 60, 7)] + [(2, datetime(2024, 1, 1, 5), 1.0)], "repo_id long, created_at timestamp, cost_usd double")
    ev.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = jobs.rolling_cost(s).writeStream.outputMode("complete").format("memory").queryName("roll").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert rows(spark.table("roll"), "start", "repo_id", "n") == rows(jobs.rolling_cost(ev), "start", "repo_id", "n")


def test_telemetry(spark, tmp_path):
    df = spark.createDataFrame([(1, "search")], "id int, event string")
    for _ in range(2):
        jobs.telemetry(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


PY = 'from typing import List\nimport os\n\n@dataclass\nclass A:\n    """An A."""\n    def __init__(self, x: int) -> None:\n        pass\n    def _own(self):\n        """Secret."""\n\ndef f(a: int, *b, c=1, **d) -> List:\n    """Does f.\n    More."""\n    return []\n'


def test_python_skeleton():
    text, entries = skeleton.outline("x/m.py", PY)
    assert text == '# m.py [Python]\nimports: typing, os\n\n@dataclass\nclass A\n  """An A."""\n  + __init__(x: int) -> None\n  - _own()\n    """Secret."""\n\nfunction f(a: int, *b, c, **d) -> List\n  """Does f."""'
    assert entries == [("A", "class", 5, 10), ("__init__", "method", 7, 8), ("_own", "method", 9, 10), ("f", "function", 12, 15)]
    assert skeleton.outline("m.py", "def broken(:\n x") == ("def broken(:\n x", [])


CODE = [
    ("a.go", 'package a\nimport "fmt"\ntype S struct {\n x int\n}\nfunc F(a int) string {\n return ""\n}', [("S", "struct", 3, 5), ("F", "function", 6, 8)]),
    ("a.rs", "use std::io;\npub struct S {\n}\nimpl S {\n    pub fn go(&self) -> u8 {\n        1\n    }\n}", [("S", "struct", 2, 3), ("S", "impl", 4, 8), ("go", "function", 5, 7)]),
    ("A.java", "import a.B;\npublic class A {\n    private int f(String s) {\n        return 1;\n    }\n}", [("A", "class", 2, 6), ("f", "method", 3, 5)]),
    ("a.rb", "module M\n  class C\n    def go(x)\n      x\n    end\n  end\nend", [("M", "class", 1, 7), ("C", "class", 2, 6), ("go", "method", 3, 5)]),
    ("a.kt", "import a.b\nclass C {\n    fun f(x: Int): Int {\n        return x\n    }\n}", [("C", "class", 2, 6), ("f", "method", 3, 5)]),
    ("a.c", '#include <stdio.h>\nint add(int a, int b) {\n    return a + b;\n}', [("add", "function", 2, 4)]),
    ("a.php", "<?php\nclass C {\n    public function f(int $a): int {\n        return $a;\n    }\n}", [("C", "class", 2, 6), ("f", "method", 3, 5)]),
    ("a.lua", "local M = {}\nfunction M.go(a, b)\n  return a\nend", [("M.go", "function", 2, 4)]),
    ("a.swift", "import UIKit\nstruct S {\n    func f(x: Int) -> Int {\n        return x\n    }\n}", [("S", "struct", 2, 6), ("f", "method", 3, 5)]),
    ("a.zig", 'const std = @import("std");\npub fn add(a: i32) i32 {\n    return a;\n}', [("add", "function", 2, 4)]),
    ("a.ex", "defmodule A do\n  def f(x) do\n    x\n  end\nend", [("A", "class", 1, 5), ("f", "function", 2, 4)]),
    ("a.scala", "object A {\n  def f(x: Int): Int = {\n    x\n  }\n}", [("A", "object", 1, 5), ("f", "function", 2, 4)]),
    ("a.cs", "using System;\nclass A {\n    public int F(int x)\n    {\n        return x;\n    }\n}", [("A", "class", 2, 7), ("F", "method", 3, 6)]),
    ("a.cpp", "#include <v>\nnamespace n {\nint f(int x) {\n    return x;\n}\n}", [("n", "namespace", 2, 6), ("f", "function", 3, 5)]),
]


@pytest.mark.parametrize("path,code,want", CODE, ids=[c[0] for c in CODE])
def test_line_skeletons(path, code, want):
    text, entries = skeleton.outline(path, code)
    assert entries == want
    assert text.startswith(f"# {path} [")


def test_outlines_of_broken_and_large_sources_end_soon():
    import time

    t = time.time()
    for path, _, _ in CODE:
        for text in ("(" * 100_000, "{" * 50_000, "a\n" * 50_000, "\n" * 50_000 + "}", '"' * 9999, "def x\n" * 2000, "class A {\n" * 900):
            assert skeleton.outline(path, text)[0].startswith(("# ", text[:1]))
    assert time.time() - t < 60


def test_prose_skeleton(spark):
    df = spark.createDataFrame([("# Top\nx\n## Sub \n#no\n" + "y" * 5000,)], "t string")
    r = df.select(skeleton.prose_entries(F.col("t")).alias("e"), F.length(skeleton.prose_text(F.col("t"))).alias("n")).first()
    assert [tuple(x) for x in r["e"]] == [("Top", "h1", 1, 1), ("Sub", "h2", 3, 3)] and r["n"] == 4000
    assert skeleton.outline("a.md", "# Top\n## S")[1] == [("Top", "h1", 1, 1), ("S", "h2", 2, 2)]


def test_walk(spark, tmp_path):
    from graphquarry.sources import scan

    for name, data in {"a.py": b"x\0y", "b/c.ts": b"ok", "node_modules/d.ts": b"no", "big.py": b"z" * 600_000, "key.pem": b"no", "b/Makefile": b"all:", "img.png": b"no", "b/gen/e.ts": b"no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    (tmp_path / ".indexignore").write_text("# generated\n\ngen/\n")
    rules = scan.ignore_rules(spark, str(tmp_path / ".indexignore"))
    assert rules == ["gen/"] and scan.ignore_rules(spark, str(tmp_path / "none")) == []
    got = rows(scan.walk(spark, str(tmp_path), rules), "file_path", "content")
    assert got == [("a.py", "xy"), ("b/Makefile", "all:"), ("b/c.ts", "ok")]


def test_api(spark):
    from graphquarry import api
    from graphquarry.sources.projection import Views

    v = Views(spark, "/root/testdata/sf0.001")
    index, low = api.Index.of(v), search.Scoring(min_score=0.05)
    q = v.queries.orderBy("query_id").limit(2)
    o = api.Options(top_n=5, scoring=low, languages=["python", "go"], scope=["src1", "src2"])
    got = api.search_files(index, q, o).join(v.files.select("file_id", "file_type", "repo_id"), "file_id").collect()
    assert got and {r["file_type"] for r in got} <= {".py", ".go"}
    names = dict(rows(v.repos, "repo_id", "name"))
    assert {names[r["repo_id"]] for r in got} <= {"src1", "src2"}
    kinds = {r["kind"] for r in api.search(index, q, api.Options(top_n=200, scoring=low)).collect()}
    assert kinds == {"file", "directory", "commit"}
    assert api.search_directories(index, q, api.Options(top_n=3, scoring=low)).count() == 6
    assert api.search_commits(index, q, api.Options(top_n=3, scoring=low, since=datetime(1995, 1, 1))).count() == 6
    changed = api.search_changed(index, datetime(2024, 1, 1, 1), q, api.Options(scoring=low))
    assert all(r["file_id"] >= 60 for r in changed.collect())
    asked = q.select(F.explode(F.array(F.lit(0), F.lit(9))).alias("pos"), "query_id", "query", "vec_id")
    assert api.batch_search(index, asked, api.Options(top_n=2, scoring=low)).count() == 8
    with pytest.raises(ValueError):
        api.batch_search(index, asked, most=1)
    assert api.search_files(index, q, api.Options(scoring=low, token_repos=[])).count() == 0
    assert api.search_files(index, q, api.Options(scoring=low, rerank=True)).count() > 0
    assert api.get_cost_summary(index, 3).count() > 0


def test_scratch_tables(spark):
    from graphquarry.sources import scratch

    df = scratch.stash(spark.createDataFrame([(1, None)], "a int, b string"), "t")
    assert [tuple(r) for r in df.collect()] == [(1, None)]
    scratch.clear(spark)
    assert scratch.stash(spark.range(3).toDF("a"), "t").count() == 3


def test_limiter_as_a_stream(spark, tmp_path):
    import random

    rng = random.Random(8)
    ev = [(rng.randint(1, 4), float(rng.randint(0, 300))) for _ in range(120)]
    spark.createDataFrame(ev, "key long, t double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("key long, t double").parquet(str(tmp_path / "in"))
    q = limits.limit_stream(s, 3, 60).writeStream.outputMode("append").format("memory").queryName("limited").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    want, state = [], {}
    for k, t in sorted(ev, key=lambda e: e[1]):
        want.append((k, t, state.setdefault(k, limits.SlidingLog(3, 60))(t)))
    assert rows(spark.table("limited"), "key", "t", "outcome") == sorted(want)


def test_fixed_rounds_as_printf(spark):
    values = [k / 1e6 for k in (*range(5000, 1000000, 10000), *range(500, 1000000, 7000))] + [0.125, 0.375, 0.0625, 2.675, 1.005, 12.345, -0.345, -0.001, -0.0004, 0.0, 0.995, 0.9995, 1.0]
    df = spark.createDataFrame([(float(x),) for x in values], "x double")
    for digits in (2, 3):
        assert [r[0] for r in df.select(tx.fixed(F.col("x"), digits)).collect()] == [f"%.{digits}f" % x for x in values]

"""Registered queries against brute force over all rows, where a cut of the job would show."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphquarry.operators import graph
from graphquarry.plans import registry
from graphquarry.sources.projection import Views

SF = "/root/testdata/sf0.001"


def test_blob_scores_cover_all_queries(spark):
    v = Views(spark, SF)
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in v.table("embeddings").select("vec_id", "embedding").collect()}
    asked = [(r["query_id"], r["vec_id"]) for r in v.queries.collect()]
    blobs = {r["content_hash"]: r["vec_id"] for r in v.blobs.collect()}
    cos = lambda a, b: float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
    by_blob = {(h, q): cos(vectors[x], vectors[y]) for h, y in blobs.items() for q, x in asked}
    want = {(r["file_id"], q): by_blob[r["content_hash"], q] for r in v.files.select("file_id", "content_hash").collect() for q, _ in asked}
    out = registry.QUERIES["blob_scores_to_files"](spark, SF).collect()
    got = {(r["file_id"], r["query_id"]): r["sim"] for r in out}
    assert len(asked) > 3 and len(out) == len(got) and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def walk(edges, seeds, depth):
    """(seed, file_id, depth) at every depth that some path gives."""
    out = set()
    for s in seeds:
        level = {s}
        for d in range(1, depth + 1):
            level = {b for a in level for b in edges.get(a, ())}
            out |= {(s, b, d) for b in level}
    return out


@pytest.mark.parametrize("name, inward", [("trace_import_chain", False), ("trace_import_chain_inward", True), ("trace_import_chain_all_depths", False)])
def test_import_walks_go_to_depth_10(spark, tmp_path, name, inward):
    v = Views(spark, SF)
    edges = {}
    for r in v.file_imports.filter("resolved_file_id is not null").collect():
        a, b = (r["resolved_file_id"], r["source_file_id"]) if inward else (r["source_file_id"], r["resolved_file_id"])
        edges.setdefault(a, set()).add(b)
    want = walk(edges, {r["query_id"] for r in v.queries.collect()}, 10)
    if not name.endswith("all_depths"):
        least = {}
        for s, f, d in want:
            least[s, f] = min(d, least.get((s, f), d))
        want = {(s, f, d) for (s, f), d in least.items() if s != f}
    out = registry.QUERIES[name](spark, SF).collect()
    assert len(out) == len(want) and {(r["seed"], r["file_id"], r["depth"]) for r in out} == want
    assert max(d for _, _, d in want) > 4


def test_conversations_start_at_their_own_first_turn(spark, tmp_path):
    turns = [(1, t) for t in range(14)] + [(2, t) for t in range(3, 10)] + [(3, 5), (4, 0), (4, 1), (4, 3)]
    spark.createDataFrame([(c, t, "user", "x") for c, t in turns], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = registry.QUERIES["trace_conversation_turns"](spark, str(tmp_path)).collect()
    assert {(r["conv_id"], r["depth"]) for r in out} == {(1, 10), (2, 6), (4, 1)}


def test_cross_repo_paths_and_python(spark):
    files = [(2, "lib/a.jsx"), (2, "src/lib/b.tsx"), (3, "lib/b.ts"), (2, "lib/c/index.jsx"), (3, "src/lib/d/index.ts"), (3, "lib/d/index.js"), (2, "src/deep/e.tsx"), (2, "src/deep/f/index.jsx")]
    files += [(4, "tools/run.py"), (3, "src/tools/run.py"), (4, "tools/kit/__init__.py"), (5, "src/tools/sub/__init__.py"), (1, "own/x.ts"), (4, "pkg/only.ts"), (2, "index.ts"), (7, "@s/p/z.ts")]
    packages = [(2, "pkg", "index.ts"), (6, "@s/p", "index.js")]
    asked = {
        ("lib/a", "typescript"): (2, "lib/a.jsx"), ("lib/b", "javascript"): (2, "src/lib/b.tsx"), ("lib/c", "typescript"): (2, "lib/c/index.jsx"), ("lib/d", "typescript"): (3, "src/lib/d/index.ts"),
        ("pkg/deep/e", "typescript"): (2, "src/deep/e.tsx"), ("pkg/deep/f", "typescript"): (2, "src/deep/f/index.jsx"), ("pkg", "typescript"): (2, "index.ts"),
        ("tools.run", "python"): (3, "src/tools/run.py"), ("tools.kit", "python"): (4, "tools/kit/__init__.py"), ("tools.sub", "python"): (5, "src/tools/sub/__init__.py"),
        ("@s/p/z", "typescript"): (7, "@s/p/z.ts"), ("@s/p", "typescript"): (6, None),
        ("own/x", "typescript"): None, ("./lib/a", "typescript"): None, ("lib.a", "python"): None, ("pkg", "go"): None,
    }
    rows = [(1, k, m, lang) for k, (m, lang) in enumerate(asked)]
    out = graph.cross_repo_edges(
        spark.createDataFrame(rows, "repo_id long, source_file long, imported_module string, language string"),
        spark.createDataFrame(packages, "repo_id long, package string, entry string"), spark.createDataFrame(files, "repo_id long, file_path string"),
    ).collect()
    want = {k: t for k, t in enumerate(asked.values()) if t}
    assert len(out) == len(want) and {r["source_file"]: (r["target_repo"], r["target_file"]) for r in out} == want


def test_a_hot_key_is_numbered_over_many_ranges(spark):
    from graphquarry.operators import etl

    rows = [(1, f"f{k:04d}") for k in range(900)] + [(k % 7 + 2, f"g{k}") for k in range(60)] + [(None, f"h{k}") for k in range(5)] + [(9, "same")] * 3
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "repo_id long, file_path string")
        out = etl.numbered(df, ["repo_id"], ["file_path"], "n").collect()
        empty = etl.numbered(df.limit(0), ["repo_id"], ["file_path"], "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = []
    for key in {r for r, _ in rows}:
        want += [(key, p, n) for n, p in enumerate(sorted(p for r, p in rows if r == key))]
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr) and not empty


def test_a_capped_repository_embeds_nothing(spark):
    from graphquarry.operators import build

    rows = spark.createDataFrame(
        [(1, "a", "h1", None, False, 9.0), (1, "b", "h2", [1.0], True, 9.0), (2, "c", "h3", [1.0], True, 9.0), (3, "d", "h4", None, False, None), (3, "e", "h5", None, False, None), (None, "f", "h1", None, False, 9.0)],
        "repo_id long, file_path string, content_hash string, vec array<double>, cached boolean, cost double",
    )
    fresh = spark.createDataFrame([("h1", [2.0]), ("h4", [3.0]), ("h5", [])], "content_hash string, vec array<double>")
    left = lambda cap: {r["file_path"] for r in build.embed_files(rows, fresh, F.col("cost"), cap).collect()}
    assert left(5.0) == {"c", "d"} and left(None) == {"a", "b", "c", "d", "f"}


def test_code_tokens_without_a_token_and_with_a_dotted_capital(spark, tmp_path):
    import duckdb

    texts = ["", "é ß …", "İstanbul aBİc Kelvin", "one two One", None]
    spark.createDataFrame([(i, t, "en", "web") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    cols = ["file_id", "n_tokens", "n_terms"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE['code_tokens']}) ORDER BY 1").fetchall()
    assert [tuple(r[c] for c in cols) for r in registry.QUERIES["code_tokens"](spark, str(tmp_path)).orderBy("file_id").collect()] == want
    assert [r[0] for r in want] == [2, 3]


def test_blob_scores_have_every_file_and_query(spark):
    sf = "/root/testdata/sf0.01"  # more than 200 contents
    v = Views(spark, sf)
    out = registry.QUERIES["blob_scores_to_files"](spark, sf)
    assert out.count() == v.files.count() * v.queries.count() == out.select("file_id", "query_id").distinct().count()

"""Repositories read by git, and batches sent to a store that refuses and fails."""

import json
import subprocess
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from graphquarry.operators.build import migration_rows, pending
from graphquarry.sources import git, upload


# -- git ------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def repositories(tmp_path_factory):
    roots = tmp_path_factory.mktemp("roots")

    def run(name, *args):
        return subprocess.run(["git", "-C", str(roots / name), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True).stdout.decode()

    for name in ("clean", "dirty", "empty"):
        (roots / name).mkdir()
        run(name, "init", "-q", "-b", "main")
    (roots / "no-repository").mkdir()
    for name in ("clean", "dirty"):
        for i in range(7):
            (roots / name / f"d{i}").mkdir(exist_ok=True)
            (roots / name / f"d{i}" / "a [1] é\tx.py").write_text(f"{i}")
            (roots / name / f"top{i}.md").write_text(f"{name} {i}")
            run(name, "add", "-A")
            run(name, "commit", "-q", "-m", f"commit {i}: and, more")
    (roots / "dirty" / "new.txt").write_text("not in the tree")
    (roots / "dirty" / "top1.md").write_text("changed")
    return roots, run


def read(spark, roots, kind, **options):
    git.register(spark)
    r = spark.read.format("git").option("roots", str(roots)).option("kind", kind)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def test_tree(spark, repositories):
    roots, run = repositories
    want = sorted(("clean", line.split("\t", 1)[1], line.split()[2]) for line in run("clean", "ls-tree", "-r", "-z", "HEAD").split("\0") if line)
    for entries in (200, 3):
        df = read(spark, roots, "tree", entries=entries)
        assert sorted(map(tuple, df.collect())) == want and len(want) == 14
    assert df.rdd.getNumPartitions() == 5  # 14 entries of the root, three at a time


def test_commits_in_stretches(spark, repositories):
    roots, run = repositories
    said = run("clean", "log", "--format=%H|%s|%aI").splitlines()
    want = [("clean", i, *line.split("|")) for i, line in enumerate(said)]
    df = read(spark, roots, "commits", stretch=2).filter("repo = 'clean'")
    assert sorted(map(tuple, df.collect())) == want
    assert df.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, read(spark, roots, "commits", depth=3).filter(F.col("repo").isin("clean", "none")).collect())) == want[:3]


def test_conditions_are_taken_in(spark, repositories):
    roots, _ = repositories
    git.register(spark)
    r = git.GitReader({"roots": str(roots), "kind": "commits"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    other = GreaterThan(("pos",), 3)
    assert list(r.pushFilters([EqualTo(("repo",), "clean"), other, IsNotNull(("repo",)), In(("repo",), ("clean", "dirty"))])) == [other]
    assert {p.repo for p in r.partitions()} == {"clean"}
    df = read(spark, roots, "commits").filter("repo = 'dirty' and pos > 3")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Filter" in plan and "repo" not in plan.split("Filter", 1)[1].split("\n")[0]  # only pos is left to Spark
    assert {tuple(x) for x in df.select("repo", "pos").collect()} == {("dirty", 4), ("dirty", 5), ("dirty", 6)}


def test_changed_paths(spark, repositories):
    roots, run = repositories
    assert {tuple(r) for r in read(spark, roots, "changed").collect()} == {("dirty", "top1.md")}
    at = run("clean", "rev-parse", "HEAD").strip()
    assert {tuple(r) for r in read(spark, roots, "changed", commit=at).filter("repo = 'clean'").collect()} == {("clean", "d6/a [1] é\tx.py"), ("clean", "top6.md")}


# -- upload ---------------------------------------------------------------------------------------
class Store:
    """A store that is too busy for the first try of every third batch, fails for good after ``breaks`` batches, and counts."""

    def __init__(self):
        self.breaks, self.seen, self.rows, self.now, self.most, self.lock = None, {}, [], 0, 0, threading.Lock()
        store = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                with store.lock:
                    store.now += 1
                    store.most = max(store.most, store.now)
                    key, tries = self.headers["Idempotency-Key"], store.seen.get(self.headers["Idempotency-Key"], 0)
                    store.seen[key] = tries + 1
                    busy, broken = body["batch"] % 3 == 0 and tries == 0, store.breaks is not None and len(store.rows) >= store.breaks
                    if not busy and not broken:
                        store.rows += [(body["repo_id"], f["file_path"]) for f in body["files"]]
                    store.now -= 1
                self.send_response(429 if busy else 500 if broken else 200)
                if busy:
                    self.send_header("Retry-After", "0.01")
                self.end_headers()

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/ingest"


@pytest.fixture
def store():
    s = Store()
    yield s
    s.server.shutdown()


def rows_of(spark):
    files = spark.range(230).selectExpr("id % 3 AS repo_id", "concat('f', id) AS file_path", "sha2(cast(id AS string), 256) AS content_hash", "'.py' AS file_type", "if(id % 5 = 0, null, concat('s', id)) AS skeleton")
    return migration_rows(files, 10)


def test_upload_sends_each_row_once(spark, store, tmp_path):
    rows = rows_of(spark)
    said = upload.upload(rows, store.url, str(tmp_path), "job-1", 2)
    assert said == {"batches": 24, "passed": 0, "rows": 230}
    assert sorted(store.rows) == sorted((r["repo_id"], r["file_path"]) for r in rows.collect())
    assert store.most <= 2 and max(store.seen.values()) == 2
    assert upload.upload(rows, store.url, str(tmp_path), "job-1", 2) == {"batches": 0, "passed": 24, "rows": 0}
    assert len(store.rows) == 230


def test_upload_goes_on_after_a_stop(spark, store, tmp_path):
    rows, store.breaks = rows_of(spark), 90
    with pytest.raises(Exception, match="refused: 500"):
        upload.upload(rows, store.url, str(tmp_path), "job", 2)
    done = upload.acknowledged(spark, str(tmp_path), "job")
    left = pending(rows, done)
    assert 90 <= len(store.rows) < 230 and left.count() == 230 - len(store.rows)
    assert (tmp_path / "job" / "stopped.json").exists()
    store.breaks = None
    said = upload.upload(left, store.url, str(tmp_path), "job", 2)
    assert said["passed"] == 0 and len(store.rows) == len(set(store.rows)) == 230


def test_upload_gives_up_after_its_attempts(spark, store, tmp_path):
    rows = rows_of(spark).filter("batch = 0 and repo_id = 0")
    with pytest.raises(Exception, match="refused: 429"):
        upload.upload(rows, store.url, str(tmp_path), "job", 1, attempts=0)
    with pytest.raises(Exception, match="need the columns"):
        rows.select("batch").write.format("upload").mode("append").option("url", store.url).option("acks", str(tmp_path)).save()

"""Sends numbered batches of rows to a remote store, as a Spark data source that writes.

    rows.repartition(2, "repo_id", "batch").sortWithinPartitions("repo_id", "batch")
        .write.format("upload").mode("append").option("url", url).option("acks", folder).save()

``upload`` below does this. Each batch is one request with a key of its own, so a store can tell a batch that it
already has. What is acknowledged is noted in a shared folder, one empty file for each batch: a task that is
run again, or a later run after a stop, passes over it.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow.fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from graphquarry.operators.build import retry_delays

BATCH = ("repo_id", "batch")


@dataclass
class Sent(WriterCommitMessage):
    """What one task did: how many batches it sent, how many it passed over, and how many rows were in those sent."""

    batches: int
    passed: int
    rows: int


class Ledger:
    """The acknowledged batches of a job, as files in a folder that all tasks share."""

    def __init__(self, folder: str, job: str):
        self.fs, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)
        self.root = f"{root.rstrip('/')}/{job}"
        self.fs.create_dir(self.root, recursive=True)

    def has(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.root}/{name}.ack").type == pyarrow.fs.FileType.File

    def put(self, name: str, text: str = "") -> None:
        with self.fs.open_output_stream(f"{self.root}/{name}") as f:
            f.write(text.encode())

    def acked(self) -> list[str]:
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(self.root))
        return sorted(f.base_name[:-4] for f in found if f.base_name.endswith(".ack"))


class UploadWriter(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType):
        self.url, self.acks, self.job = options["url"], options["acks"], options.get("job", "upload")
        self.attempts, self.timeout = int(options.get("attempts", 5)), float(options.get("timeout", 30))
        self.wait = float(options.get("wait", 1))
        self.columns = [c for c in schema.names if c not in BATCH]
        if missing := [c for c in BATCH if c not in schema.names]:
            raise ValueError(f"rows need the columns {missing}")

    def write(self, iterator: Iterator[Row]) -> Sent:
        ledger, done = Ledger(self.acks, self.job), Sent(0, 0, 0)
        for key, rows in groupby(iterator, key=lambda r: tuple(r[c] for c in BATCH)):
            name, files = "-".join(map(str, key)), [{c: r[c] for c in self.columns} for r in rows]
            if ledger.has(name):
                done.passed += 1
                continue
            self._send(name, {"job": self.job, "repo_id": key[0], "batch": key[1], "files": files})
            ledger.put(f"{name}.ack")
            done.batches += 1
            done.rows += len(files)
        return done

    def _send(self, name: str, body: dict) -> None:
        request = urllib.request.Request(self.url, json.dumps(body, default=str).encode(), {"Content-Type": "application/json", "Idempotency-Key": f"{self.job}/{name}"}, method="POST")
        for attempt in range(self.attempts + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    answer.read()
                return
            except urllib.error.HTTPError as e:
                # a store that is only too busy says so, and after how many seconds to come back
                if e.code not in (429, 503) or attempt == self.attempts:
                    raise RuntimeError(f"batch {name} was refused: {e.code} {e.reason}") from e
                after = e.headers.get("Retry-After")
                time.sleep(self.wait * retry_delays(float(after) if after else None, self.attempts)[attempt])

    def commit(self, messages: list[Sent | None]) -> None:
        sent = [m for m in messages if m is not None]
        said = {"batches": sum(m.batches for m in sent), "passed": sum(m.passed for m in sent), "rows": sum(m.rows for m in sent)}
        Ledger(self.acks, self.job).put("done.json", json.dumps(said))

    def abort(self, messages: list[Sent | None]) -> None:
        """What was acknowledged stays noted; the next run goes on from there."""
        sent = [m for m in messages if m is not None]
        Ledger(self.acks, self.job).put("stopped.json", json.dumps({"tasks": len(messages), "ended": len(sent)}))


class UploadSource(DataSource):
    """Options: url, acks (a shared folder), job, attempts (after the first, for a busy store), wait (a factor on its seconds), timeout."""

    @classmethod
    def name(cls) -> str:
        return "upload"

    def writer(self, schema: StructType, overwrite: bool) -> UploadWriter:
        return UploadWriter(dict(self.options), schema)


def acknowledged(spark: SparkSession, acks: str, job: str = "upload") -> DataFrame:
    """(repo_id, batch) of what a job has had acknowledged, for ``build.pending``."""
    names = [n.rsplit("-", 1) for n in Ledger(acks, job).acked()]
    return spark.createDataFrame([(int(r), int(b)) for r, b in names], "repo_id long, batch long")


def upload(rows: DataFrame, url: str, acks: str, job: str = "upload", concurrency: int = 2, **options) -> dict[str, int]:
    """Sends rows(repo_id, batch, ...), as ``ingest_rows`` and ``migration_rows`` number them, in ``concurrency`` tasks at once.

    Returns how many batches and rows were sent and how many batches had been acknowledged before.
    """
    spark = rows.sparkSession
    spark.dataSource.register(UploadSource)
    dealt = rows.repartition(concurrency, *BATCH).sortWithinPartitions(*BATCH)
    w = dealt.write.format("upload").mode("append").option("url", url).option("acks", acks).option("job", job)
    for k, v in options.items():
        w = w.option(k, str(v))
    w.save()
    ledger = Ledger(acks, job)
    with ledger.fs.open_input_stream(f"{ledger.root}/done.json") as f:
        return json.loads(f.read())

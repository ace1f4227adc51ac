"""WARC records in ZIP packages: a writer, and a reader that never extracts.

A package holds two stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member for
each record, and ``indexes/index.cdxj``, one line for each record with its offset and length. The
reader parses the end record, its ZIP64 counterpart and the central directory, finds where the
stored members begin, reads the index, and reads only byte ranges of the archive member.

Packages lie in the folder of ``spark.checkpoint.dir`` and are reached through Arrow file systems,
so the folder can be in any store that those know. A task writes to names of its own attempt and
returns them; only returned packages are read, so a repeated attempt leaves no double records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, scratch_path, settle, shuffle_parts, small, stash

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NULL_ID = 1 << 64


# -- ZIP ------------------------------------------------------------------------------------------
def _zip64(extra: bytes, wanted: list[int]) -> list[int]:
    """``wanted`` with every 0xFFFFFFFF replaced from the ZIP64 extra field, in the format's order."""
    at = 0
    while at + 4 <= len(extra):
        tag, size = struct.unpack_from("<HH", extra, at)
        if tag == 1:
            values = list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [values.pop(0) if x == 0xFFFFFFFF and values else x for x in wanted]
        at += 4 + size
    return wanted


def members(read, size: int) -> dict[str, tuple[int, int]]:
    """name -> (first byte, length) of every stored member; read(offset, length) -> bytes."""
    tail_at = max(0, size - 65_557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # that one was part of a comment
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        at = tail_at + end - 20
        sign, _, where, _ = struct.unpack("<4sIQI", read(at, 20))
        if sign != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = read(where, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = read(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        # the extra field holds the full values of those that are at their maximum, in this order
        plain, packed, local = _zip64(extra, [plain, packed, local])
        at += 46 + n_name + n_extra + n_note
        if method == 0 and not flags & 1:
            head = read(local, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("broken local header")
            a, b = struct.unpack_from("<HH", head, 26)
            found[name] = (local + 30 + a + b, packed)
    return found


# -- WARC -----------------------------------------------------------------------------------------
def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_NULL_ID if page_id is None else page_id & (_NULL_ID - 1))}>"


def _page_id(record_id: str) -> int | None:
    x = uuid.UUID(record_id.strip()[10:-1]).int
    return None if x == _NULL_ID else x - 2**64 if x >= 2**63 else x


def _header_safe(s: str | None) -> str:
    return "".join(c if " " <= c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in s or "")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_header_safe(url)}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}", "WARC-Truncated: length"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode()
    return head + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[int | None, str, int, str, str, int | None, bytes]:
    """(page_id, url, payload bytes, payload digest, type, refers to, payload); a revisit's payload is empty.

    A response's digest is computed from its payload and must equal its header's.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    kind, refers = fields["warc-type"], None
    if kind == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        refers = _page_id(fields["warc-refers-to"])
    else:
        size, own = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if own != digest:
            raise ValueError(f"the payload's digest is {own}, the header's {digest}")
    return _page_id(fields["warc-record-id"]), fields.get("warc-target-uri", ""), size, digest, kind, refers, payload


class PackageWriter:
    """One package in memory; ``close`` writes it."""

    def __init__(self):
        self.data, self.lines = io.BytesIO(), []

    def add(self, raw: bytes, url: str) -> None:
        z = zlib.compressobj(3, zlib.DEFLATED, 31)
        packed, at = z.compress(raw) + z.flush(), self.data.tell()
        self.data.write(packed)
        self.lines.append(f"{url.replace(' ', '%20')} {_DATE} " + json.dumps({"offset": at, "length": len(packed), "plain": len(raw), "filename": "data.warc.gz"}))

    def close(self, out) -> int:
        """Writes to a binary file object; returns the records."""
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr(zipfile.ZipInfo(ARCHIVE), self.data.getbuffer())
            z.writestr(zipfile.ZipInfo(INDEX), "\n".join([*self.lines, ""]).encode())
        return len(self.lines)


# -- Spark ----------------------------------------------------------------------------------------
def classify(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, revisit, refers_to): of equal payloads of ``min_bytes`` or more, the largest page_id is the response."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    marks = stash(pages.select("page_id", F.unhex(F.sha1(payload)).alias("sha1"), F.octet_length(payload).alias("n")), "payloads")
    best = marks.filter(F.col("n") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("best"))
    both = marks.join(best, "sha1", "left").distinct()
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return both.select("page_id", "sha1", revisit.alias("revisit"), F.when(revisit, F.col("best")).alias("refers_to"))


def write_packages(pages: DataFrame, folder: str, min_bytes: int = 0, max_bytes: int = 32 << 20, max_broadcast: int = 200_000) -> DataFrame:
    """(path, bytes, records) of the packages written; each holds about ``max_bytes`` of compressed records at most, or one larger record."""
    arrow_limits(pages.sparkSession)
    kinds = small(stash(classify(pages, min_bytes), "kinds"), max_broadcast)
    kinds = kinds.select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), "revisit", "refers_to")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("sha1", F.unhex(F.sha1("html")))
    rows = rows.join(kinds, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1")))
    rows = rows.select("page_id", "url", "html", "sha1", "revisit", "refers_to")

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem = f"pages-{task.partitionId():05d}-{task.taskAttemptId()}"
        written, own = [], PackageWriter()

        def close():
            path = f"{root}/{stem}-{len(written):04d}.wacz"
            with store.open_output_stream(path) as out:
                n = own.close(out)
            written.append((path, store.get_file_info(path).size, n))

        for b in batches:
            for page, url, html, sha, revisit, refers in zip(*(c.to_pylist() for c in b.columns)):
                own.add(record(page, url, html, sha, refers, revisit), _header_safe(url))
                if own.data.tell() >= max_bytes:
                    close()
                    own = PackageWriter()
        if own.lines:
            close()
        settle()
        yield pa.RecordBatch.from_arrays([pa.array([w[0] for w in written], pa.string()), pa.array([w[1] for w in written], pa.int64()), pa.array([w[2] for w in written], pa.int64())], ["path", "bytes", "records"])

    return stash(rows.mapInArrow(run, "path string, bytes long, records long"), "packages")


#: Plain bytes that a compressed byte can stand for at most.
MOST_PLAIN = 1032


def _ranges(index: list[dict], chunk: int) -> list[list[dict]]:
    """Adjacent records together, ``chunk`` plain bytes at most, or one larger record. Where an index lacks the plain size, its upper bound counts."""
    out: list[list[dict]] = []
    held = 0
    for x in index:
        own = max(x["length"], x.get("plain", MOST_PLAIN * x["length"]))
        if not out or held + own > chunk or x["offset"] != out[-1][-1]["offset"] + out[-1][-1]["length"]:
            out.append([])
            held = 0
        out[-1].append(x)
        held += own
    return out


def read_packages(packages: DataFrame, folder: str, chunk: int = 2 << 20, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records.

    First each package's directory and index are read and the records are joined to ranges of about
    ``chunk`` plain bytes at most; then the ranges, dealt anew over all tasks, are read and parsed, so a
    task holds the records of one range. Without payloads, that column stays in the worker.
    """
    arrow_limits(packages.sparkSession)

    def locate(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            rows = []
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_input_file(path) as f:
                    found = members(lambda at, n: f.read_at(n, at), size)
                    base, _ = found[ARCHIVE]
                    at, n = found[INDEX]
                    index = [json.loads(x[x.index("{") :]) for x in f.read_at(n, at).decode().splitlines()]
                rows += [(path, base + part[0]["offset"], [x["length"] for x in part]) for part in _ranges(index, chunk)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["path", "at", "lengths"])

    schema = T.StructType([
        T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
    ])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    if not payloads:
        schema = T.StructType(schema.fields[:-1])

    def fetch(batches):
        store, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, at, lengths in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_file(path) as f:
                    raw = f.read_at(sum(lengths), at)
                ends = np.cumsum(lengths).tolist()
                rows = [parse_record(zlib.decompress(raw[a:e], 31)) for a, e in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(zip(*rows), kinds, schema.names)], schema.names)

    ranges = packages.mapInArrow(locate, "path string, at long, lengths array<long>")
    total = packages.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    parts = max(shuffle_parts(packages.sparkSession), -(-total // (64 << 20)))  # a given number: by the size of their rows, all would go to one task
    return ranges.repartition(parts, "path", "at").mapInArrow(fetch, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """The records of ``pages`` after a trip through packages; one row for each row of ``pages``.

    page_id is a 64-bit integer, as record ids are made from it.

    Null html: an empty payload. Equal payloads: the row with the largest page_id is the response
    and the others revisit it; repeated rows of that page_id are responses all; null page_ids are
    smaller than any other. Null or odd urls: empty, or with control characters percent-encoded.
    Extra columns are ignored; an empty table gives no rows.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    return read_packages(write_packages(pages, folder, min_bytes), folder, payloads=payloads)


def op4(spark, sf_dir: str) -> DataFrame:
    out = archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _base32(hex_text: str) -> str:
    """SQL for the base-32 form of 40 hex digits: four runs of 40 bits, eight letters each."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr({h}, {at}, 10))::BIGINT >> {shift}) & 31)::INT + 1, 1)"
    return " || ".join(letter.format(h=hex_text, at=10 * run + 1, shift=35 - 5 * i) for run in range(4) for i in range(8))


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT *, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS best FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_base32('x')} AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM b
"""

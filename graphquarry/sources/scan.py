"""Sources and sinks: file trees, ignore files, packages, outlines, telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphquarry.functions.text import base64url_hex, strip_nul
from graphquarry.operators.filters import MAX_FILE_BYTES, indexable

# Extensions that are indexed, and what is never or by default not indexed.
INDEXABLE = [
    ".ts", ".tsx", ".js", ".jsx", ".py", ".rs", ".go", ".java", ".c", ".cpp", ".cc", ".cxx", ".hpp", ".hxx", ".h", ".cs", ".kt", ".kts", ".swift", ".rb", ".php", ".lua", ".scala", ".sc", ".md", ".mdx",
]
HARD_IGNORED = [".git/"]
SOFT_IGNORED = ["node_modules/", ".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "credentials.json"]


def walk(spark: SparkSession, root: str, soft: list[str] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """(file_path, size, modified, content) of the indexable files below ``root``, paths relative to it.

    The size limit is pushed to the listing, so large files aren't read. Bytes that are no UTF-8
    become replacement characters; NULs go.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).filter(F.col("length") <= MAX_FILE_BYTES)
    tail = base.split(":", 1)[-1].lstrip("/")
    path = F.element_at(F.split("path", f"\\Q{tail}/\\E", 2), 2)
    rows = raw.select(path.alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    kept = rows.filter(indexable(F.col("file_path"), F.col("size"), allowed or INDEXABLE, HARD_IGNORED, SOFT_IGNORED + (soft or [])))
    return kept.withColumn("content", strip_nul(F.decode("content", "UTF-8")))


def ignore_rules(spark: SparkSession, path: str) -> list[str]:
    """Patterns of one ignore file, without blanks and comments; a missing file has none.

    Spark's readers pass over names that begin with a dot, so the driver opens it through Hadoop.
    """
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    stream = fs.open(where)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]


def repos_below(listing: DataFrame) -> DataFrame:
    """(root, n_files) of listing(path): folders that hold a .git entry, with the number of files below each."""
    roots = listing.select(F.regexp_extract("path", r"^(.*)/\.git(?:/|$)", 1).alias("root")).filter("root <> ''").distinct()
    files = listing.filter(~F.col("path").rlike(r"/\.git(?:/|$)"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select("path", F.explode(above).alias("root")).join(roots, "root", "right").groupBy("root").agg(F.count("path").alias("n_files"))


def _last_part(dir_path: Column) -> Column:
    return F.element_at(F.split(dir_path, "/"), -1)


def detect_packages(dirs: DataFrame) -> DataFrame:
    """(dir, ecosystem, name, version) of dirs(dir, package_json, cargo_checksum, record, metadata, go_mod): the texts of the
    manifests, null where there is none. The first kind that fits wins: npm, cargo, python, go; none: the row goes.
    """
    npm = F.from_json("package_json", "name string, version string")
    base = _last_part(F.col("dir"))
    cut = lambda text, pattern, g: F.regexp_extract(text, pattern, g)
    stem = F.regexp_replace(base, r"\.dist-info$", "")
    pair = lambda eco, ok, name, version: F.when(ok & (name != "") & (version != ""), F.struct(F.lit(eco).alias("ecosystem"), name.alias("name"), version.alias("version")))
    has_files = F.from_json("cargo_checksum", "files map<string,string>")["files"].isNotNull()
    dash = r"^(.+)-([^-]*)$"
    found = F.coalesce(
        pair("npm", F.col("package_json").isNotNull() & npm["name"].isNotNull() & npm["version"].isNotNull(), F.coalesce(npm["name"], F.lit("")), F.coalesce(npm["version"], F.lit(""))),
        pair("cargo", has_files, cut(base, dash, 1), cut(base, dash, 2)),
        pair("python", base.endswith(".dist-info") & F.col("metadata").isNotNull() & F.coalesce(F.contains("record", F.lit(",sha256=")), F.lit(False)), cut(stem, dash, 1), cut(stem, dash, 2)),
        pair("go", F.col("go_mod").isNotNull(), cut(base, r"^(.+)@([^@]*)$", 1), cut(base, r"^(.+)@([^@]*)$", 2)),
    )
    return dirs.withColumn("_p", found).filter("_p is not null").select("dir", "_p.ecosystem", "_p.name", "_p.version")


def manifest_files(dirs: DataFrame) -> DataFrame:
    """(dir, relpath, content_hash) as checksum and record manifests give them: hex SHA-256."""
    cargo = dirs.select("dir", F.explode(F.from_json("cargo_checksum", "files map<string,string>")["files"]).alias("relpath", "content_hash"))
    lines = dirs.filter("cargo_checksum is null").select("dir", F.explode(F.split("record", "\n")).alias("line")).select("dir", F.split(F.trim("line"), ",").alias("p"))
    python = lines.filter((F.size("p") >= 2) & F.get("p", 1).startswith("sha256="))
    return cargo.unionByName(python.select("dir", F.get("p", 0).alias("relpath"), base64url_hex(F.substring(F.get("p", 1), 8, 1000)).alias("content_hash")))


def folder_outline(directories: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, markdown): an outline with one section for each folder, the shallowest first.

    directories(repo_id, dir_path, summary), files(repo_id, file_path). A folder without a summary of
    20 characters is marked for review.
    """
    folder = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    names = files.select("repo_id", F.when(folder == "", ".").otherwise(folder).alias("dir_path"), F.element_at(F.split("file_path", "/"), -1).alias("name"), "file_path")
    lists = names.groupBy("repo_id", "dir_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_path", "name"))), lambda x: x["name"]), ", ").alias("names"))
    rows = directories.join(lists, ["repo_id", "dir_path"], "left")
    review = F.when(F.col("summary").isNull() | (F.length("summary") < 20), " [REVIEW]").otherwise("")
    head = F.when(F.col("dir_path") == ".", "./").otherwise(F.concat(F.regexp_replace("dir_path", "/$", ""), F.lit("/")))
    part = F.concat(
        F.lit("\n## "), head, review, F.lit("\n"), F.when(F.length("summary") > 0, F.concat(F.lit("\n"), "summary")).otherwise(""),
        F.when(F.col("names").isNotNull(), F.concat(F.lit("\n\n**Files:** "), "names")).otherwise(""),
    )
    depth = F.length("dir_path") - F.length(F.replace("dir_path", F.lit("/"), F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(depth.alias("d"), "dir_path", part.alias("part"))))
    body = rows.groupBy("repo_id").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n").alias("body"))
    return body.select("repo_id", F.concat(F.lit("# AGENTS.md\n"), "body", F.lit("\n")).alias("markdown"))

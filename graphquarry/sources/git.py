"""Repositories as a Spark data source: the tree of HEAD, commits, and the paths that a commit changed.

    spark.read.format("git").option("roots", folder).option("kind", "tree").load().filter("repo = 'x'")

Every repository below ``roots`` is a partition of its own or several: a tree is split by the entries of its
root, a history into stretches of commits. Conditions on ``repo`` are taken in when the partitions are planned.
Tasks run git, so the folders have to be where the tasks run.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

SCHEMAS = {"tree": "repo string, path string, oid string", "commits": "repo string, pos long, commit_hash string, message string, date string", "changed": "repo string, path string"}


def git(root: str, *args: str) -> bytes | None:
    """The output, or None if git failed; where there is no repository or no commit, there is nothing to read."""
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", root, *args], capture_output=True)
    return done.stdout if done.returncode == 0 else None


@dataclass
class Part(InputPartition):
    """A part of a repository: paths of its tree, or a stretch of its commits."""

    repo: str
    root: str
    paths: tuple[str, ...] = ()
    skip: int = 0
    many: int = 0


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.kind, self.roots, self.commit = options.get("kind", "tree"), options["roots"], options.get("commit", "")
        self.depth, self.stretch, self.entries = int(options.get("depth", 0)), int(options.get("stretch", 5000)), int(options.get("entries", 200))
        if self.kind not in SCHEMAS:
            raise ValueError(f"kind is one of {sorted(SCHEMAS)}")
        self.only: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("repo",):
                self._keep({f.value})
            elif isinstance(f, In) and f.attribute == ("repo",):
                self._keep(set(f.value))
            elif isinstance(f, IsNotNull) and f.attribute == ("repo",):
                pass  # there is always a name
            else:
                yield f

    def _keep(self, names: set) -> None:
        self.only = names if self.only is None else self.only & names

    def partitions(self) -> Sequence[Part]:
        out = []
        for name in sorted(os.listdir(self.roots)):
            root = os.path.join(self.roots, name)
            if os.path.isdir(os.path.join(root, ".git")) and (self.only is None or name in self.only):
                out += self._split(name, root)
        return out or [Part("", "")]

    def _split(self, name: str, root: str) -> list[Part]:
        if self.kind == "tree":
            # with uncommitted changes the ids don't name what is on disk
            if (said := git(root, "status", "--porcelain")) is None or said.strip():
                return []
            top = [x for x in (git(root, "ls-tree", "--name-only", "-z", "HEAD") or b"").decode(errors="replace").split("\0") if x]
            return [Part(name, root, tuple(top[at : at + self.entries])) for at in range(0, len(top), self.entries)]
        if self.kind == "commits":
            n = int(git(root, "rev-list", "--count", "HEAD") or 0)
            n = min(n, self.depth) if self.depth else n
            return [Part(name, root, (), at, min(self.stretch, n - at)) for at in range(0, n, self.stretch)]
        return [Part(name, root)]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.root:
            yield from getattr(self, f"_{self.kind}")(part)

    def _tree(self, part: Part) -> Iterator[tuple]:
        said = git(part.root, "--literal-pathspecs", "ls-tree", "-r", "-z", "HEAD", "--", *part.paths) or b""
        for line in said.decode(errors="replace").split("\0"):
            about, tab, path = line.partition("\t")
            fields = about.split()
            if tab and len(fields) >= 3 and fields[1] == "blob":
                yield part.repo, path, fields[2]

    def _commits(self, part: Part) -> Iterator[tuple]:
        said = git(part.root, "log", "--format=%H%n%s%n%aI", f"--skip={part.skip}", f"-n{part.many}") or b""
        lines = said.decode(errors="replace").split("\n")
        for i in range(part.many):
            if 3 * i + 2 < len(lines):
                yield part.repo, part.skip + i, *(x.strip() for x in lines[3 * i : 3 * i + 3])

    def _changed(self, part: Part) -> Iterator[tuple]:
        how = ["diff-tree", "--root", "--no-commit-id", "--name-only", "-r", "-z", self.commit] if self.commit else ["diff", "--name-only", "-z", "HEAD"]
        for path in (git(part.root, *how) or b"").decode(errors="replace").split("\0"):
            if path:
                yield part.repo, path


class GitSource(DataSource):
    """Options: roots, kind (tree, commits, changed), depth (newest commits only; 0: all), commit (for changed; none: against HEAD),
    stretch (commits of a partition), entries (of a tree's root in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("kind", "tree")]

    def reader(self, schema) -> GitReader:
        return GitReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets it take conditions in."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitSource)

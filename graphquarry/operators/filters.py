"""Filters: languages, folders, dates, repository and token scopes, ignore rules, secrets."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Language names and their extensions.
LANGUAGES = {
    "typescript": [".ts", ".tsx"], "ts": [".ts", ".tsx"], "javascript": [".js", ".jsx"], "js": [".js", ".jsx"], "python": [".py"], "py": [".py"],
    "rust": [".rs"], "go": [".go"], "java": [".java"], "c": [".c", ".h"], "cpp": [".cpp", ".cc", ".hpp"], "csharp": [".cs"], "kotlin": [".kt", ".kts"],
    "swift": [".swift"], "ruby": [".rb"], "php": [".php"], "lua": [".lua"], "scala": [".scala"], "markdown": [".md", ".mdx"],
}
MAX_FILE_BYTES = 524_288


def extensions(languages: list[str]) -> list[str]:
    """Extensions of the named languages, each once; an unknown ``foo`` is ``.foo``."""
    out: dict[str, None] = {}
    for name in languages:
        low = name.lower()
        for e in LANGUAGES.get(low, [low if low.startswith(".") else f".{low}"]):
            out[e] = None
    return list(out)


def by_language(files: DataFrame, languages: list[str]) -> DataFrame:
    return files.filter(F.col("file_type").isin(extensions(languages)))


def in_folders(path: Column, folders: list[str], itself: bool = False) -> Column:
    """Below one of the folders; itself: or one of them. Wildcards of LIKE in a folder's name act as such."""
    test = F.lit(False)
    for f in folders:
        d = f.rstrip("/")
        test = test | path.like(f"{d}/%")
        if itself:
            test = test | (path == d)
    return test


def since_date(since: str, now: datetime, clamp: bool = True) -> datetime:
    """``Nd``, ``Nw``, ``Nm`` before now, or an ISO date. Months are clamped to the last day, or run over into the next."""
    m = re.fullmatch(r"(\d+)([dwm])", since)
    if not m:
        return datetime.fromisoformat(since.replace("Z", "+00:00")).replace(tzinfo=None)
    n, unit = int(m[1]), m[2]
    if unit != "m":
        return now - timedelta(days=n * (7 if unit == "w" else 1))
    year, month = divmod(now.year * 12 + now.month - 1 - n, 12)
    first = datetime(year, month + 1, 1, now.hour, now.minute, now.second, now.microsecond)
    last = (datetime(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return first + timedelta(days=(min(now.day, last) if clamp else now.day) - 1)


def changed_since(files: DataFrame, file_commits: DataFrame, commits: DataFrame, since: datetime) -> DataFrame:
    """Files with any commit at or after ``since``."""
    recent = file_commits.join(commits.filter(F.col("authored_at") >= F.lit(since)).select("commit_id"), "commit_id", "left_semi").select("file_id")
    return files.join(recent, "file_id", "left_semi")


def resolve_repos(repos: DataFrame, scope: str | list[str], current: int) -> DataFrame:
    """(repo_id): 'project' is the current one, 'all' all; a list by name or path falls back to the current one if nothing matches."""
    if scope == "all":
        return repos.select("repo_id")
    own = repos.filter(F.col("repo_id") == current).select("repo_id")
    if scope == "project":
        return own
    named = repos.filter(F.col("name").isin(scope) | F.col("root_path").isin(scope)).select("repo_id")
    none = named.agg(F.count("*").alias("n"))
    return named.unionByName(own.crossJoin(F.broadcast(none)).filter("n = 0").select("repo_id"))  # one row each


def token_scope(access: Column, caller: Column) -> Column:
    """Repository ids that both allow; null: unrestricted."""
    return F.when(access.isNull(), caller).when(caller.isNull(), access).otherwise(F.array_sort(F.array_intersect(access, caller)))


def ignore_regex(pattern: str) -> str:
    """One gitignore pattern as a regex over whole relative paths."""
    p = pattern.rstrip("/")
    rooted = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + (re.escape(p[i]) if not p[i].isalnum() and p[i] not in "/_-" else p[i]), i + 1
    return ("^" if rooted else "^(?:.*/)?") + out + ("/.*$" if pattern.endswith("/") else "(?:/.*)?$")


def ignored(path: Column, hard: list[str], soft: list[str]) -> Column:
    """Hard rules always hold; of soft ones the last that matches decides, and ``!`` takes a path back in."""
    verdict = F.lit(False)
    for rule in soft:
        back = rule.startswith("!")
        verdict = F.when(path.rlike(ignore_regex(rule[1:] if back else rule)), F.lit(not back)).otherwise(verdict)
    always = F.lit(False)
    for rule in hard:
        always = always | path.rlike(ignore_regex(rule))
    return always | verdict


def indexable(path: Column, size: Column, allowed: list[str], hard: list[str], soft: list[str]) -> Column:
    """Not ignored, of an allowed extension or without one, and small enough."""
    ext = F.regexp_extract(path, "[^/.][^/]*(\\.[^./]+)$", 1)
    return ~ignored(path, hard, soft) & ((ext == "") | F.lower(ext).isin(allowed)) & (size <= MAX_FILE_BYTES)


def safe_path(path: Column) -> Column:
    """Relative and without ``..``."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


# Names and patterns of secrets that keep a file out of the index; public formats.
SECRET_PATTERNS = {
    "access_key": "AKIA[0-9A-Z]{16}", "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "assigned": "(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]{6,}",
}


def secret_names(text: Column) -> Column:
    """Names of the patterns that the text holds, in order."""
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in SECRET_PATTERNS.items()]), lambda x: x.isNotNull())


def without_secrets(files: DataFrame, public: DataFrame) -> DataFrame:
    """Files without secrets, and those of public repositories with secrets in published content: public(repo_id, content_hash)."""
    clean = files.filter(F.size(secret_names(F.col("skeleton"))) == 0)
    flagged = files.filter(F.size(secret_names(F.col("skeleton"))) > 0).join(public, ["repo_id", "content_hash"], "left_semi")
    return clean.unionByName(flagged)

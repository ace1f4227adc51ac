"""Import graphs: extraction, resolution, walks, cross-repository edges, symbol references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphquarry.functions.text import like_escape
from graphquarry.operators.etl import numbered
from graphquarry.sources.scratch import stash

# Import patterns by language; group 1 is the module.
IMPORT_PATTERNS = {
    "typescript": [
        r"import\s+(?:type\s+)?(?:[\s\S]*?)\s+from\s+[\"']([^\"']+)[\"']", r"import\s+[\"']([^\"']+)[\"']",
        r"require\s*\(\s*[\"']([^\"']+)[\"']\s*\)", r"import\s*\(\s*[\"']([^\"']+)[\"']\s*\)",
    ],
    "python": [r"(?m)^import\s+([\w.]+)", r"(?m)^from\s+([\w.]+)\s+import"],
    "go": [r"import\s+\"([^\"]+)\""],
    "rust": [r"use\s+([\w:]+(?:::[\w*{},\s]+)*)", r"mod\s+(\w+)\s*;"],
    "java": [r"import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"],
    "kotlin": [r"import\s+([\w.]+(?:\.\*)?)"],
    "ruby": [r"require\s+[\"']([^\"']+)[\"']", r"require_relative\s+[\"']([^\"']+)[\"']"],
    "php": [r"use\s+([\w\\]+)(?:\s+as\s+\w+)?\s*;", r"(?:require|include)(?:_once)?\s+[\"']([^\"']+)[\"']"],
    "lua": [r"require\s*\(\s*[\"']([^\"']+)[\"']\s*\)", r"require\s+(?!\()[\"']([^\"']+)[\"']"],
    "zig": [r"@import\s*\(\s*\"([^\"]+)\"\s*\)"],
    "elixir": [r"alias\s+([\w.]+)(?!\.\{)", r"import\s+([\w.]+)", r"use\s+([\w.]+)", r"require\s+([\w.]+)"],
}
# Extension to language.
EXTENSION_LANGUAGE = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "typescript", ".jsx": "typescript", ".py": "python", ".go": "go", ".rs": "rust", ".java": "java",
    ".kt": "kotlin", ".kts": "kotlin", ".rb": "ruby", ".php": "php", ".lua": "lua", ".zig": "zig", ".ex": "elixir", ".exs": "elixir",
}
GO_GROUP = r"import\s*\(([\s\S]*?)\)"
ELIXIR_GROUP = r"alias\s+([\w.]+)\.\{([^}]+)\}"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def modules_of(text: Column, language: str) -> Column:
    """Modules that a source text imports, each once, in the order of patterns and places."""
    found = [_all(text, p) for p in IMPORT_PATTERNS[language]]
    if language == "go":
        found.append(F.flatten(F.transform(_all(text, GO_GROUP), lambda g: _all(g, r"\"([^\"]+)\""))))
    elif language == "rust":
        parents = F.transform(found[0], lambda m: F.array_join(F.slice(F.split(m, "::"), F.lit(1), F.greatest(F.lit(0), F.size(F.split(m, "::")) - 1)), "::"))
        found[0] = F.filter(parents, lambda m: m != "")
    elif language == "elixir":
        found[0] = F.filter(F.transform(found[0], lambda m: F.regexp_replace(m, r"\.$", "")), lambda m: m != "")
        groups = F.arrays_zip(_all(text, ELIXIR_GROUP, 1).alias("base"), _all(text, ELIXIR_GROUP, 2).alias("names"))
        members = lambda g: F.filter(F.transform(F.split(g["names"], ","), lambda x: F.trim(x)), lambda x: x != "")
        found.insert(1, F.flatten(F.transform(groups, lambda g: F.transform(members(g), lambda n: F.concat(g["base"], F.lit("."), n)))))
    return F.array_distinct(F.concat(*found))


def extract_imports(files: DataFrame) -> DataFrame:
    """(file_id, imported_module, language) of files(file_id, file_type, content)."""
    lang = F.lit(None).cast("string")
    found = F.array().cast("array<string>")
    for ext, name in EXTENSION_LANGUAGE.items():
        lang = F.when(F.col("file_type") == ext, F.lit(name)).otherwise(lang)
    for name in IMPORT_PATTERNS:
        found = F.when(F.col("language") == name, modules_of(F.col("content"), name)).otherwise(found)
    rows = files.withColumn("language", lang).filter("language is not null")
    return rows.select("file_id", F.explode(found).alias("imported_module"), "language")


def normal_path(path: Column) -> Column:
    """``a/./b/../c`` as ``a/c``; a path that leaves the root keeps its ``..``."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda a, p: F.when(F.size(a) == 0, F.when(p.isin("", "."), a).otherwise(F.array(p))).otherwise(step(a, p))), "/")


# Endings that a module without extension is tried with, in this order.
TS_ENDINGS = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", ""]
JVM_PREFIXES = ["", "src/main/java/", "src/main/kotlin/", "src/"]
JVM_ENDINGS = [".java", ".kt", ".kts"]


def _candidates(module: Column, folder: Column, language: str) -> Column:
    """Paths that an import can mean, the best first; unresolvable: none."""
    none = F.array().cast("array<string>")
    at = normal_path(F.concat_ws("/", folder, module))
    relative = module.startswith(".")
    if language == "typescript":
        bare = F.regexp_replace(at, r"\.(js|jsx)$", "")
        both = [F.concat(at, F.lit(e)) for e in TS_ENDINGS] + [F.concat(bare, F.lit(e)) for e in TS_ENDINGS[:4]]
        return F.when(relative, F.array(*both)).otherwise(none)
    if language == "python":
        path = F.translate(module, ".", "/")
        return F.array(F.concat(path, F.lit(".py")), F.concat(path, F.lit("/__init__.py")))
    if language == "ruby":
        own = F.array(F.concat(at, F.lit(".rb")), at)
        other = F.array(F.concat(F.lit("lib/"), module, F.lit(".rb")), F.concat(module, F.lit(".rb")))
        return F.when(relative, own).otherwise(other)
    if language in ("java", "kotlin"):
        path = F.translate(F.regexp_replace(module, r"\.\*$", ""), ".", "/")
        return F.array(*[F.concat(F.lit(p), path, F.lit(e)) for p in JVM_PREFIXES for e in JVM_ENDINGS])
    return none


def resolve_imports(edges: DataFrame, files: DataFrame) -> DataFrame:
    """``edges`` (repo_id, source_path, imported_module, language) with target_path, null where nothing fits.

    files(repo_id, file_path). The candidates are joined by equality and the first that exists wins.
    Go modules, whose first part must hold a dot, match the longest suffix that is a folder, and
    then its first file; a JVM module without a file falls back to the first file of its folder.
    """
    folder = F.regexp_extract("source_path", "^(.*)/[^/]*$", 1)
    choice = F.array().cast("array<string>")
    for name in IMPORT_PATTERNS:
        choice = F.when(F.col("language") == name, _candidates(F.col("imported_module"), folder, name)).otherwise(choice)
    key = ["repo_id", "source_path", "imported_module", "language"]
    tried = edges.select(*key, F.posexplode(choice).alias("pos", "file_path"))
    exact = tried.join(files.select("repo_id", "file_path"), ["repo_id", "file_path"]).select(*key, "pos", F.col("file_path").alias("found"))
    parts = F.split(F.regexp_replace("imported_module", r"\.\*$", ""), "/")
    go = edges.filter((F.col("language") == "go") & F.contains(parts[0], F.lit("."))).select(*key, parts.alias("parts"))
    go = go.select(*key, F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("i"), "parts")
    go = go.select(*key, (F.col("i") + 1000).alias("pos"), F.array_join(F.slice("parts", F.col("i"), F.size("parts")), "/").alias("folder"))
    jvm = edges.filter(F.col("language").isin("java", "kotlin"))
    path = F.translate(F.regexp_replace("imported_module", r"\.\*$", ""), ".", "/")
    jvm = jvm.select(*key, F.posexplode(F.array(*[F.concat(F.lit(p), path) for p in JVM_PREFIXES])).alias("p", "folder")).select(*key, (F.col("p") + 2000).alias("pos"), "folder")
    firsts = files.groupBy("repo_id", F.regexp_extract("file_path", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.min("file_path").alias("found"))
    by_folder = go.unionByName(jvm).join(firsts, ["repo_id", "folder"]).select(*key, "pos", "found")
    best = exact.unionByName(by_folder).groupBy(*key).agg(F.min_by("found", "pos").alias("target_path"))
    return edges.join(best, key, "left").select(*key, "target_path")


def importers(file_imports: DataFrame, files: DataFrame, targets: DataFrame) -> DataFrame:
    """Files that import one of targets(file_id)."""
    hit = file_imports.join(targets.select(F.col("file_id").alias("resolved_file_id")), "resolved_file_id")
    return hit.join(files.select(F.col("file_id").alias("source_file_id"), "file_path"), "source_file_id").select("resolved_file_id", "source_file_id", "file_path", "imported_module")


def dependencies(file_imports: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """What sources(file_id) import; an unresolved import stays with a null path."""
    own = file_imports.join(sources.select(F.col("file_id").alias("source_file_id")), "source_file_id")
    return own.join(files.select(F.col("file_id").alias("resolved_file_id"), "file_path"), "resolved_file_id", "left").select("source_file_id", "imported_module", "resolved_file_id", "file_path")


def trace_imports(file_imports: DataFrame, seeds: DataFrame, max_depth: int, inward: bool = False, all_depths: bool = False, scope: DataFrame | None = None) -> DataFrame:
    """(seed, file_id, depth) reachable from seeds(file_id) in at most max_depth steps, level by level.

    A file comes at its least depth; all_depths: at every depth that some path gives it, cycles
    included. scope(file_id): the files that may be seen; others are left out before they are expanded, so
    nothing behind them is reached through them. Seeds count as given. The loop has max_depth rounds at most and
    ends early when a level is empty.

    Seeds travel as bits: a file has one row for every 64 seeds that have reached it, whatever paths led there.
    """
    if not 1 <= max_depth <= 10:
        raise ValueError("max_depth is 1 to 10")
    a, b = ("resolved_file_id", "source_file_id") if inward else ("source_file_id", "resolved_file_id")
    edges = file_imports.filter("resolved_file_id is not null").select(F.col(a).alias("file_id"), F.col(b).alias("next"))
    if scope is not None:
        edges = edges.join(scope.select(F.col("file_id").alias("next")), "next", "left_semi")
    edges = stash(edges.distinct(), "edges")
    named = stash(numbered(seeds.select("file_id").distinct(), [], ["file_id"], "n").select(F.expr("cast(n div 64 as int)").alias("word"), F.expr("cast(n % 64 as int)").alias("bit"), F.col("file_id").alias("seed")), "seeds")
    level = named.select(F.col("seed").alias("file_id"), "word", F.expr("shiftleft(1L, bit)").alias("bits"))
    seen, out = level, None
    for depth in range(1, max_depth + 1):
        reached = edges.join(level, "file_id").groupBy(F.col("next").alias("file_id"), "word").agg(F.bit_or("bits").alias("bits"))
        if all_depths:
            level = stash(reached, "level")
        else:
            both = reached.select("file_id", "word", "bits", F.lit(0).cast("long").alias("old")).unionByName(seen.select("file_id", "word", F.lit(0).cast("long").alias("bits"), F.col("bits").alias("old")))
            both = stash(both.groupBy("file_id", "word").agg(F.bit_or("bits").alias("bits"), F.bit_or("old").alias("old")), "level")
            level = both.select("file_id", "word", F.col("bits").bitwiseAND(F.bitwise_not("old")).alias("bits")).filter("bits <> 0")
            seen = both.select("file_id", "word", F.col("bits").bitwiseOR(F.col("old")).alias("bits"))
        found = level.withColumn("depth", F.lit(depth).cast("long"))
        out = found if out is None else out.unionByName(found)
        if level.isEmpty():
            break
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1)
    return out.select("file_id", "depth", "word", F.explode(places).alias("bit")).join(named, ["word", "bit"]).select("seed", "file_id", "depth")


# Where another repository's module, subpath or entry is looked for, in this order.
CROSS_ENDINGS = [".ts", ".tsx", ".js", ".jsx"]
CROSS_PYTHON = [("", ".py"), ("", "/__init__.py"), ("src/", ".py"), ("src/", "/__init__.py")]


def _cross_paths(module: Column) -> Column:
    forms = [(p, i + e) for e in CROSS_ENDINGS for i in ("", "/index") for p in ("", "src/")]
    return F.array(*[F.concat(F.lit(p), module, F.lit(e)) for p, e in forms])


def _lowest_by_path(paths: DataFrame, there: DataFrame, named: DataFrame, most: int = 8) -> DataFrame:
    """``paths``(file_path, repo_id, package, ...) with target_repo and target_file: the lowest repository of there(target_repo,
    file_path) that has the path, isn't the row's own, and has no package of named(target_repo, package) that the row names.

    Each path is one row with its ``most`` lowest repositories before it meets the imports, so a path that a
    third of the repositories have costs no more than another. Only where all of these are ruled out and there
    are more are the rest looked at one by one.
    """
    paths = stash(paths, "cross-paths")
    asked = there.join(paths.select("file_path").distinct(), "file_path", "left_semi").select("target_repo", "file_path").distinct()
    lowest = Window.partitionBy("file_path").orderBy("target_repo")
    few = stash(asked.withColumn("i", F.row_number().over(lowest)).filter(F.col("i") <= most).drop("i"), "lowest-repos")  # cut before the shuffle, too
    own = named.join(few.select("target_repo").distinct(), "target_repo", "left_semi").groupBy("target_repo").agg(F.collect_set("package").alias("own"))
    held = few.join(own, "target_repo", "left").select("file_path", "target_repo", F.coalesce("own", F.array().cast("array<string>")).alias("own"))
    tops = held.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("target_repo", "own"))).alias("top"))
    tops = stash(tops.join(asked.groupBy("file_path").agg(F.count("*").alias("n")), "file_path"), "repos-of-paths")
    free = F.filter("top", lambda t: (t["target_repo"] != F.col("repo_id")) & ~F.coalesce(F.array_contains(t["own"], F.col("package")), F.lit(False)))
    both = paths.join(tops, "file_path").withColumn("target_repo", F.get(free, 0)["target_repo"])
    done = both.filter("target_repo is not null").select(*paths.columns, "target_repo")
    open_ = stash(both.filter(F.col("target_repo").isNull() & (F.col("n") > most)).select(*paths.columns), "open-paths")
    if not open_.isEmpty():
        rest = open_.join(there.select("target_repo", "file_path"), "file_path").filter("repo_id <> target_repo")
        rest = rest.join(named.select("target_repo", "package"), ["target_repo", "package"], "left_anti")
        done = done.unionByName(rest.groupBy(*paths.columns).agg(F.min("target_repo").alias("target_repo")))
    return done.withColumn("target_file", F.col("file_path"))


def cross_repo_edges(unresolved: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """Edges from unresolved imports to other repositories.

    unresolved(repo_id, source_file, imported_module, and language; without that column all are
    typescript), packages(repo_id, package, entry), files(repo_id, file_path). TypeScript and JavaScript:
    a module is a package's name (then the entry file), its name and a path below, or a path in a
    repository of another name; paths are tried with four endings, plain, below src/, and as index
    files. Python: the dotted path as a file or a package, plain or below src/. Relative and absolute
    modules have no edge. Of several repositories that have the file the lowest id wins; if none has it,
    a package of that name gives an edge without a target file.
    """
    if "language" not in unresolved.columns:
        unresolved = unresolved.withColumn("language", F.lit("typescript"))
    key = ["repo_id", "source_file", "imported_module"]
    module = F.col("imported_module")
    parts = F.split("imported_module", "/")
    scoped = F.when(module.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(parts[0])
    ts = unresolved.filter(F.col("language").isin("typescript", "javascript") & ~module.startswith(".") & ~module.startswith("/"))
    rows = ts.withColumn("package", scoped).withColumn("sub", F.when(F.length("imported_module") > F.length("package") + 1, F.substring("imported_module", F.length("package") + 2, F.length("imported_module"))))
    named = packages.withColumnRenamed("repo_id", "target_repo")
    both = rows.join(named, "package").filter("repo_id <> target_repo")
    tries = F.when(F.col("sub").isNull(), F.array("entry")).otherwise(F.concat(F.array("sub"), _cross_paths(F.col("sub"))))
    tried = both.select(*key, "target_repo", F.posexplode(tries).alias("pos", "file_path"))
    there = files.select(F.col("repo_id").alias("target_repo"), "file_path", F.col("file_path").alias("target_file"))
    by_name = tried.join(there, ["target_repo", "file_path"], "left").select(*key, "target_repo", "pos", "target_file")

    # Paths match in any repository but one whose package the module names: there only the package counts.
    python = unresolved.filter(F.col("language") == "python")
    dotted = F.translate(module, ".", "/")
    choice = F.array(*[F.concat(F.lit(p), dotted, F.lit(e)) for p, e in CROSS_PYTHON])
    paths = ts.select(*key, scoped.alias("package"), F.posexplode(_cross_paths(module)).alias("pos", "file_path"))
    paths = paths.unionByName(python.select(*key, F.lit(None).cast("string").alias("package"), F.posexplode(choice).alias("pos", "file_path")))
    by_path = _lowest_by_path(paths, there, named)

    hit = by_name.unionByName(by_path.select(*key, "target_repo", "pos", "target_file"))
    order = Window.partitionBy(*key).orderBy(F.col("target_file").isNull(), "target_repo", "pos")
    best = hit.withColumn("r", F.row_number().over(order)).filter("r = 1")
    return best.select(F.col("repo_id").alias("source_repo"), "target_repo", "source_file", "imported_module", "target_file")


def callers(file_imports: DataFrame, files: DataFrame, symbol: str, limit: int = 100) -> DataFrame:
    """Files whose imports name a symbol; ``limit`` is the feature's own."""
    hit = file_imports.filter(F.col("imported_module").like(f"%{like_escape(symbol)}%")).select(F.col("source_file_id").alias("file_id")).distinct()
    return files.join(hit, "file_id").select("repo_id", "file_path", "file_id").orderBy("repo_id", "file_path").limit(limit)


def implementors(files: DataFrame, symbol: str, limit: int = 100) -> DataFrame:
    """Files whose skeleton names a symbol beside a word of inheritance; ``limit`` is the feature's own."""
    s = F.col("skeleton")
    near = s.like("%implements%") | s.like("%extends%") | s.like("%: %") | s.like("%conform%")
    return files.filter(s.like(f"%{like_escape(symbol)}%") & near).select("repo_id", "file_path", "file_id").orderBy("repo_id", "file_path").limit(limit)


def repo_graph(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source_repo", "target_repo").agg(F.count("*").alias("n_edges"))


def repo_neighbours(edges: DataFrame) -> DataFrame:
    """(repo_id, depends_on, used_by): sorted lists of the other repositories."""
    pairs = edges.select("source_repo", "target_repo").distinct()
    out = pairs.groupBy(F.col("source_repo").alias("repo_id")).agg(F.array_join(F.array_sort(F.collect_list("target_repo")), ",").alias("depends_on"))
    back = pairs.groupBy(F.col("target_repo").alias("repo_id")).agg(F.array_join(F.array_sort(F.collect_list("source_repo")), ",").alias("used_by"))
    return out.join(back, "repo_id", "full").select("repo_id", F.coalesce("depends_on", F.lit("")).alias("depends_on"), F.coalesce("used_by", F.lit("")).alias("used_by"))


def symbol_references(definitions: DataFrame, files: DataFrame, file_imports: DataFrame, edges: DataFrame, symbol: str) -> DataFrame:
    """(kind, file_id, score): definitions(file_id, score) of a symbol; files of the same content with the best score of it;
    importers of a definition with 0.5; cross-repository edges that name the symbol with 0.4."""
    top = definitions.orderBy(F.desc(F.round("score", 6)), "file_id").limit(20).filter("score > 0")
    own = top.select(F.lit("definition").alias("kind"), "file_id", "score")
    hashes = top.join(files.select("file_id", "content_hash"), "file_id").groupBy("content_hash").agg(F.max("score").alias("score"))
    same = files.select("file_id", "content_hash").join(hashes, "content_hash").join(top.select("file_id"), "file_id", "left_anti")
    fan = same.select(F.lit("same_content").alias("kind"), "file_id", "score")
    used = file_imports.join(top.select(F.col("file_id").alias("resolved_file_id")), "resolved_file_id", "left_semi").select(F.col("source_file_id").alias("file_id")).distinct()
    cons = used.select(F.lit("consumer").alias("kind"), "file_id", F.lit(0.5).alias("score"))
    cross = edges.filter(F.col("imported_module").ilike(f"%{like_escape(symbol)}%")).select(F.col("source_file").alias("file_id")).distinct()
    return own.unionByName(fan).unionByName(cons).unionByName(cross.select(F.lit("cross_repo").alias("kind"), "file_id", F.lit(0.4).alias("score")))

"""Queries of import extraction and resolution by language, over sources that differ from row to row."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphquarry.operators import graph as g

from .registry import query

# extension, then for doc_id % 3 = 0, 1, 2: a source text (# stands for the doc_id) and the modules that it imports
SOURCES = {
    "python": (".py", [("import os.path\nimport m#\nx = 'import no'\n", ["os.path", "m#"]), ("from pkg.m# import a, b\n    import hidden\n", ["pkg.m#"]), ("# import gone\nfrom a.b import c\nfrom a.b import d#\nimport z#.q\n", ["a.b", "z#.q"])]),
    "go": (".go", [('package a\nimport "fmt#"\n', ["fmt#"]), ('import (\n\t"a/b#"\n\tx "c.d/e"\n)\n', ["a/b#", "c.d/e"]), ('import "os"\nimport (\n\t"example.com/t/d#"\n)\n', ["os", "example.com/t/d#"])]),
    "rust": (".rs", [("use a#::b::C;\nfn f() {}\n", ["a#::b"]), ("mod m#;\nuse std::io;\n", ["std", "m#"]), ("use lonely#;\nuse x::y#::Z;\n", ["x::y#"])]),
    "java": (".java", [("import java.util.List#;\n", ["java.util.List#"]), ("import static a.b.C#.*;\nimport a.D;\n", ["a.b.C#.*", "a.D"]), ("package p;\nimport  q.R# ;\nclass X {}\n", ["q.R#"])]),
    "kotlin": (".kt", [("import a.b.c#\nimport x.*\n", ["a.b.c#", "x."]), ("package k\nimport one.Two#\n", ["one.Two#"]), ("import m.n#\nimport m.n#\n", ["m.n#"])]),
    "ruby": (".rb", [("require 'json#'\n", ["json#"]), ("require_relative './lib/x#'\nrequire \"set\"\n", ["set", "./lib/x#"]), ("require 'a/b#'\nrequire 'a/b#'\n", ["a/b#"])]),
    "php": (".php", [("use App\\Models\\U#;\n", ["App\\Models\\U#"]), ("require_once 'inc/p#.php';\ninclude \"q.php\";\n", ["inc/p#.php", "q.php"]), ("use A\\B as C#;\n", ["A\\B"])]),
    "lua": (".lua", [('local a = require("m#")\n', ["m#"]), ("local b = require 'n#'\n", ["n#"]), ("require('p')\nrequire \"q#\"\n", ["p", "q#"])]),
    "zig": (".zig", [('const s = @import("std#");\n', ["std#"]), ('const a = @import( "a.zig" );\nconst b = @import("b#.zig");\n', ["a.zig", "b#.zig"]), ('// none\nconst c = @import("c#");\n', ["c#"])]),
    "elixir": (".ex", [("alias A.B#\nimport C.D\n", ["A.B#", "C.D"]), ("alias E.{F, G#}\n", ["E", "E.F", "E.G#"]), ("use H.I#\nrequire Logger\n", ["H.I#", "Logger"])]),
}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _case(values: list[str]) -> str:
    return "CASE doc_id % 3 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


for _name, (_ext, _forms) in SOURCES.items():
    _lists = _case(["[" + ", ".join(f"replace({_literal(m)}, '#', doc_id::VARCHAR)" for m in modules) + "]" for _, modules in _forms])

    @query(f"extract_imports_{_name}", f"SELECT doc_id AS file_id, unnest({_lists}) AS imported_module, '{_name}' AS language FROM documents")
    def _(v, ext=_ext, forms=_forms):
        d = v.table("documents").select(F.col("doc_id").alias("file_id"), F.lit(ext).alias("file_type"))
        text = F.element_at(F.array(*[F.lit(t) for t, _ in forms]), (F.col("file_id") % 3 + 1).cast("int"))
        return g.extract_imports(d.withColumn("content", F.replace(text, F.lit("#"), F.col("file_id").cast("string"))))


def _resolved(v, paths, modules, language):
    """Imports of ``language`` by every document, in a repository of the folder of files that ``paths`` gives; both are columns of doc_id."""
    d = v.table("documents")
    files = d.select(F.lit(1).cast("long").alias("repo_id"), paths.alias("file_path")).distinct()
    edges = d.select(F.lit(1).cast("long").alias("repo_id"), F.concat(F.lit("src/app/main"), F.col("doc_id").cast("string")).alias("source_path"), modules.alias("imported_module"), F.lit(language).alias("language"))
    return g.resolve_imports(edges, files).select("source_path", "imported_module", "target_path")


def _by(*values):
    """A column: the value for doc_id % len(values), with # as the doc_id."""
    text = F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    return F.replace(text, F.lit("#"), F.col("doc_id").cast("string"))


def _sql_by(*values):
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if x is None else f"replace({_literal(x)}, '#', doc_id::VARCHAR)") for i, x in enumerate(values)) + " END"


def _resolver(name: str, language: str, files: tuple, modules: tuple, targets: tuple) -> None:
    """Registers a query in which the import of a document means the file of the same document, or none."""
    body = f"SELECT 'src/app/main' || doc_id AS source_path, {_sql_by(*modules)} AS imported_module, {_sql_by(*targets)} AS target_path FROM documents"

    @query(name, body)
    def _(v):
        return _resolved(v, _by(*files), _by(*modules), language)


_resolver("resolve_imports_python", "python", ("pkg/m#.py", "pkg/m#/__init__.py", "other/m#.py", "pkg/m#.txt"), ("pkg.m#", "pkg.m#", "pkg.m#", "pkg.m#"), ("pkg/m#.py", "pkg/m#/__init__.py", None, None))
_resolver("resolve_imports_ruby", "ruby", ("src/app/x#.rb", "lib/y#.rb", "z#.rb", "src/q#.rb"), ("./x#", "y#", "z#", "./q#"), ("src/app/x#.rb", "lib/y#.rb", "z#.rb", None))
_resolver("resolve_imports_go", "go", ("d#/a.go", "in/d#/a.go", "d#/a.go"), ("example.com/t/d#", "example.com/in/d#", "std/d#"), ("d#/a.go", "in/d#/a.go", None))
_resolver("resolve_imports_java", "java", ("src/main/java/a/C#.java", "src/b/C#.kt", "src/main/kotlin/p#/Z.kt", "q/C#.java"), ("a.C#", "b.C#", "p#.*", "nowhere.C#"), ("src/main/java/a/C#.java", "src/b/C#.kt", "src/main/kotlin/p#/Z.kt", None))
_resolver("resolve_imports_none", "rust", ("a/b#.rs", "c#.rs"), ("a::b#", "c#"), (None, None))

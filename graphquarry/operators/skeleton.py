"""Skeletons: the outline of a source text, with entries (name, kind, start and end line).

Prose is outlined in the JVM. Python goes through its own parser, the other languages through the
writers of ``outlines``. Any failure falls back to the first lines of the text.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphquarry.operators.outlines import outlined

FALLBACK_LINES = 50
PROSE_CHARS = 4000
ENTRY = "array<struct<name:string,kind:string,start_line:int,end_line:int>>"


# -- prose, native --------------------------------------------------------------------------------
def prose_text(text: Column) -> Column:
    return F.substring(text, 1, PROSE_CHARS)


def prose_entries(text: Column) -> Column:
    """Headings of the whole text as entries h1 to h6."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(F.ltrim(x).alias("t"), (i + 1).cast("int").alias("n")))
    heads = F.filter(lines, lambda x: x["t"].rlike(r"^#{1,6}\s+.+"))
    return F.transform(heads, lambda x: F.struct(
        F.trim(F.regexp_extract(x["t"], r"^#{1,6}\s+(.+)", 1)).alias("name"), F.concat(F.lit("h"), F.length(F.regexp_extract(x["t"], r"^(#{1,6})\s", 1)).cast("string")).alias("kind"),
        x["n"].alias("start_line"), x["n"].alias("end_line")))


def fallback(text: Column, lines: int = FALLBACK_LINES) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")


# -- Python, by its parser ------------------------------------------------------------------------
def _signature(node) -> str:
    args = [*node.args.posonlyargs, *node.args.args]
    if args and args[0].arg in ("self", "cls"):
        args = args[1:]
    out = [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in args]
    if node.args.vararg:
        out.append("*" + node.args.vararg.arg)
    out += [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in node.args.kwonlyargs]
    if node.args.kwarg:
        out.append("**" + node.args.kwarg.arg)
    return f"({', '.join(out)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")


def _python(name: str, text: str) -> tuple[str, list]:
    tree = ast.parse(text)
    entries, blocks, modules = [], [], []

    def doc(node, pad: str) -> list[str]:
        d = ast.get_docstring(node)
        return [f'{pad}"""{d.strip().splitlines()[0]}"""'] if d and d.strip() else []

    for node in tree.body:
        if isinstance(node, ast.Import):
            modules += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            modules.append("." * node.level + (node.module or ""))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            entries.append((node.name, "function", node.lineno, node.end_lineno))
            blocks.append([*(f"@{ast.unparse(d)}" for d in node.decorator_list), f"function {node.name}{_signature(node)}", *doc(node, "  ")])
        elif isinstance(node, ast.ClassDef):
            entries.append((node.name, "class", node.lineno, node.end_lineno))
            lines = [*(f"@{ast.unparse(d)}" for d in node.decorator_list), f"class {node.name}", *doc(node, "  ")]
            for m in node.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    entries.append((m.name, "function" if m.decorator_list else "method", m.lineno, m.end_lineno))  # decorated ones count as functions
                    own = m.name.startswith("_") and not m.name.startswith("__")
                    lines += [f"  @{ast.unparse(d)}" for d in m.decorator_list]
                    lines += [f"  {'-' if own else '+'} {m.name}{_signature(m)}", *doc(m, "    ")]
            blocks.append(lines)
    head = [f"# {name} [Python]"]
    if modules:
        head.append("imports: " + ", ".join(dict.fromkeys(modules)))
    top = doc(tree, "")
    return "\n\n".join("\n".join(b) for b in [head + top, *blocks]).rstrip(), entries


PROSE_EXTENSIONS = (".md", ".mdx", ".rst", ".txt", ".adoc")


def outline(path: str, text: str, fallback_lines: int = FALLBACK_LINES) -> tuple[str, list[tuple[str, str, int, int]]]:
    """(text, entries) of one source file; on any failure its first lines and no entries."""
    ext = ("." + path.rsplit(".", 1)[-1].lower()) if "." in path.rsplit("/", 1)[-1] else ".txt"
    name = path.rsplit("/", 1)[-1]
    try:
        if ext in PROSE_EXTENSIONS:
            heads = [(i + 1, m) for i, x in enumerate(text.split("\n")) if (m := re.match(r"(#{1,6})\s+(.+)", x.lstrip()))]
            return text[:PROSE_CHARS], [(m[2].strip(), f"h{len(m[1])}", i, i) for i, m in heads]
        if ext == ".py":
            return _python(name, text)
        if got := outlined(name, text, ext):
            return got
    except (SyntaxError, ValueError, RecursionError):
        pass
    return "\n".join(text.split("\n")[:fallback_lines]), []


def with_skeletons(files: DataFrame, path_col: str = "file_path", text_col: str = "content") -> DataFrame:
    """``files`` plus skeleton struct<text, entries>; null texts: empty."""

    @F.pandas_udf(f"text string, entries {ENTRY}")
    def run(path: pd.Series, text: pd.Series) -> pd.DataFrame:
        got = [outline(p or "", t or "") for p, t in zip(path, text)]
        return pd.DataFrame({"text": [g[0] for g in got], "entries": [[{"name": n, "kind": k, "start_line": a, "end_line": b} for n, k, a, b in g[1]] for g in got]})

    return files.withColumn("skeleton", run(F.col(path_col), F.col(text_col)))

"""Queries of skeletons."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphquarry.operators import skeleton as k

from .registry import query
from .samples import SAMPLES


def _marked(v):
    """Documents with their first line as a heading."""
    return v.table("documents").select("doc_id", F.concat(F.lit("# "), "text").alias("text"))


@query("skeleton_prose_text", "SELECT doc_id, sha256(left(text, 4000)) AS hash FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.sha2(k.prose_text(F.col("text")), 256).alias("hash"))


@query("skeleton_prose_entries", "SELECT doc_id, trim(string_split(text, chr(10))[1]) AS name, 'h1' AS kind, 1 AS start_line FROM documents WHERE regexp_matches(string_split(text, chr(10))[1], '^\\s*\\S')")
def _(v):
    e = _marked(v).select("doc_id", F.explode(k.prose_entries(F.col("text"))).alias("e")).filter("e.start_line = 1")
    return e.select("doc_id", "e.name", "e.kind", "e.start_line")


@query("skeleton_fallback", "SELECT doc_id, sha256(array_to_string(string_split(text, chr(10))[1:50], chr(10))) AS hash FROM documents")
def _(v):
    return v.table("documents").select("doc_id", F.sha2(k.fallback(F.col("text")), 256).alias("hash"))


@query("skeleton_python", "SELECT doc_id, '# m' || doc_id || '.py [Python]' || chr(10) || 'imports: os' || chr(10) || chr(10) || 'class C' || doc_id || chr(10) || '  + run(x: int) -> str' || chr(10) || chr(10) || 'function f' || doc_id || '(a, b)' AS text, 3 AS n_entries FROM documents")
def _(v):
    d = F.col("doc_id").cast("string")
    code = F.concat(F.lit("import os\n\nclass C"), d, F.lit(":\n    def run(self, x: int) -> str:\n        return ''\n\ndef f"), d, F.lit("(a, b):\n    pass\n"))
    rows = v.table("documents").select("doc_id", F.concat(F.lit("src/m"), d, F.lit(".py")).alias("file_path"), code.alias("content"))
    return k.with_skeletons(rows).select("doc_id", F.col("skeleton.text").alias("text"), F.size("skeleton.entries").alias("n_entries"))


def _literal(text: str) -> str:
    return "replace('" + text.replace("'", "''") + "', '§', doc_id::VARCHAR)"


for _ext, _samples in SAMPLES.items():
    _n = len(_samples)
    _case = lambda k: f"CASE doc_id % {_n} " + " ".join(f"WHEN {i} THEN {_literal(x[k])}" for i, x in enumerate(_samples)) + " END"  # noqa: B023, E731

    @query(f"skeleton_{_ext}", f"SELECT doc_id, {_case(1)} AS text, {_case(2)} AS entries FROM documents")
    def _(v, ext=_ext, samples=_samples):
        code = F.element_at(F.array(*[F.lit(t) for t, _, _ in samples]), (F.col("doc_id") % len(samples) + 1).cast("int"))
        rows = v.table("documents").select("doc_id", F.lit(f"src/m.{ext}").alias("file_path"), F.replace(code, F.lit("§"), F.col("doc_id").cast("string")).alias("content"))
        shown = F.transform("skeleton.entries", lambda e: F.concat(e["name"], F.lit(":"), e["kind"], F.lit(":"), e["start_line"].cast("string"), F.lit("-"), e["end_line"].cast("string")))
        return k.with_skeletons(rows).select("doc_id", F.col("skeleton.text").alias("text"), F.array_join(shown, ", ").alias("entries"))

"""The pipeline's stages against brute force on a small corpus."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from graphquarry.llm import secrets

from .test_edges import brute_spans
from .test_near_copies import brute_kept, brute_links, brute_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    words = "alpha beta gamma delta river stone winter letter paper garden window music simple quiet number".split()
    clean = [" ".join(rng.choice(words, 60)) + f" ending {i}." for i in range(120)]
    junk = ["BUY!!! NOW!!! $$$ %d ### | | | " % i + "CLICK!!! " * int(rng.integers(5, 20)) for i in range(120)]
    texts = clean + junk
    texts += [clean[3].replace(" ", "\n"), clean[3] + "  ", clean[4].upper(), clean[5], 'here is token = "abcdef0123456789" to hide ' + clean[6], clean[7] + " " + "long tail " * 3000, None, ""]
    texts += [" ".join(rng.choice(words, 30)) + ' here is token = "abcdef0123456789" to hide ' + " ".join(rng.choice(words, 30)) + "."]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    return str(at)


def test_stages(spark, folder):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    raw, good, unique, far, masked = seen
    assert set(range(120)) <= set(good) and not set(range(120, 240)) & set(good)

    groups = {}
    for d, t in good.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(d)
    assert set(unique) == {min(g, key=lambda d: (-len(good[d] or ""), d)) for g in groups.values()}

    ids = sorted(unique)
    near = brute_kept(len(ids), brute_links([x or {""} for x in brute_sets([unique[d] for d in ids])]))
    assert set(far) == {ids[i] for i in near} and len(far) < len(unique)

    assert set(masked) == set(far)
    for d, t in far.items():
        at, want = 0, ""
        for a, _, b, _ in brute_spans(t or ""):
            if a >= at:
                want += t[at:a] + secrets.MARK
            at = max(at, b)
        assert masked[d] == want + (t or "")[at:]
    assert any(secrets.MARK in t for t in masked.values())

    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for d, t in masked.items():
        seq = [*model.encode(t, add_special_tokens=False).ids, 1]
        for k in range(0, len(seq), 4096):
            part = np.array(seq[k : k + 4096], "<u4")
            want.append((d, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    out = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)


WORDS = "river stone winter letter paper garden window music simple quiet number forest castle bridge".split()


def shared_ids():
    """Texts that share a doc_id, repeated rows and null ids, for the stages that drop rows."""
    a = " ".join(WORDS * 3)
    near = a + " and one more"
    b = " ".join(reversed(WORDS * 2))
    c = "a third text that nobody else has, not even in parts"
    return [(1, a), (7, a), (7, b), (7, b), (None, a), (None, c), (None, c), (3, near), (1, c + "!"), (9, None), (9, ""), (4, " ".join(WORDS * 3) + "  ")]


def rows_of(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in df.collect()))


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)


def kept_of(groups):
    """groups: the rows of each group, the one to stay first -> what rows_of gives."""
    return sorted((d is None, d or 0, t or "") for d, t in (g[0] for g in groups))


def test_exact_stage_decides_by_row(spark):
    rows = shared_ids()
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((d, t))
    want = kept_of([sorted(g, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for g in groups.values()])
    assert rows_of(corpus_pipeline.dedup_exact(spark, table(spark, rows), "")) == want
    assert [(d, t) for _, d, t in want if d == 7] == [(7, rows[2][1])]


def test_near_stage_decides_by_row(spark):
    rows = shared_ids()
    sets = [s or {""} for s in brute_sets([t for _, t in rows])]
    root = list(range(len(rows)))
    for i, j in brute_links(sets):
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    groups = {}
    for r, row in zip(root, rows):
        groups.setdefault(r, []).append(row)
    got = rows_of(corpus_pipeline.dedup_near(spark, table(spark, rows), ""))
    assert [g[:2] for g in got] == sorted(min((d is None, d or 0) for d, _ in g) for g in groups.values())
    assert (False, 7, rows[2][1]) in got and (True, 0, rows[5][1]) in got and (False, 1, rows[8][1]) in got


def test_quality_stage_decides_by_row(spark, folder):
    bad = "BUY!!! NOW!!! $$$ 7 ### | | | " + "CLICK!!! " * 9
    good = " ".join("alpha beta gamma delta river stone winter letter".split() * 7) + " ending 7."
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = [(500, good), (500, bad), (500, good), (None, good), (None, bad)]
    out = corpus_pipeline.classify(spark, docs.unionByName(table(spark, more)), folder)
    got = [(r["doc_id"], r["text"]) for r in out.filter("doc_id is null or doc_id = 500").collect()]
    assert sorted(got, key=str) == sorted([(500, good), (500, good), (None, good)], key=str)


def test_clashing_columns(spark):
    names = ["_id", "_hash", "row", "stays", "node", "text_hash", "_doc", "n"]
    rows = table(spark, shared_ids()).selectExpr("*", *[f"'{i}' AS {c}" for i, c in enumerate(names)])
    for stage in (corpus_pipeline.dedup_exact, corpus_pipeline.dedup_near):
        out = stage(spark, rows, "")
        assert out.columns == rows.columns and {r["row"] for r in out.collect()} == {"2"}


def test_an_empty_table(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

"""The ten registered queries on the smallest tables: their columns and values against brute force."""

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from graphquarry.llm import queries

from .test_edges import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return {d: t or "" for d, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()}


def run(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, SF).collect()]


def test_op1(spark, texts):
    got = {r["doc_id"]: r for r in run(spark, "op1_simhash_pivots")}
    ids = sorted(texts)
    fps = [(d, brute_fp(texts[d])) for d in ids]
    root = brute_components(fps)
    least = {}
    for d, r in zip(ids, root):
        least[r] = min(d, least.get(r, d))
    assert sorted(got) == ids
    assert {d: (got[d]["fingerprint"], got[d]["component_id"]) for d in ids} == {d: (f"{f:016x}", least[r]) for (d, f), r in zip(fps, root)}


def test_op2(spark, texts):
    got = run(spark, "op2_minimax_shards")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    slots, homes, load = {}, {}, np.zeros(40, int)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None) and 0 <= r["shard"] < 40
        slots.setdefault(r["shard"], []).append(r["slot"])
        homes.setdefault(raw, set()).add(r["shard"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    largest = max(sum(len(t.encode()) + 16 for t in texts.values() if t == x) for x in set(texts.values()))
    assert load.max() <= max(largest, load.sum() / 40 + largest)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    names = [d[0] for d in cur.description]
    want = sorted((dict(zip(names, r)) for r in cur.fetchall()), key=lambda r: str(sorted(r.items())))
    assert sorted(run(spark, name), key=lambda r: str(sorted(r.items()))) == want


def test_op5(spark, texts):
    got = {r["doc_id"]: r for r in run(spark, "op5_rule_ensemble")}
    assert sorted(got) == sorted(texts)
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    known = [d for d in labels if labels[d] is not None and d in got]
    assert np.mean([got[d]["predicted"] == labels[d] for d in known]) > 0.95


def test_op6(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet' order by vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    near = {}
    for r in run(spark, "op6_hilbert_curves"):
        near.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(near) == [i for i in ids if i % 50 == 0]
    hit = 0
    for q, got in near.items():
        y = x[ids == q][0]
        cos = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum())
        at = {i: c for i, c in zip(ids.tolist(), cos) if i != q}
        got.sort()
        assert [r for r, _, _ in got] == [1, 2, 3, 4, 5] and all(abs(s - at[v]) < 1e-12 for _, v, s in got)
        assert [(-round(s, 12), v) for _, v, s in got] == sorted((-round(s, 12), v) for _, v, s in got)
        hit += len({v for _, v, _ in got} & set(sorted(at, key=lambda i: (-at[i], i))[:5]))
    assert hit / (5 * len(near)) >= 0.9


def test_op7(spark, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for d, t in texts.items():
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, 4096 * k, len(ids[4096 * k : 4096 * (k + 1)]), zlib.crc32(ids[4096 * k : 4096 * (k + 1)].tobytes())) for k in range(-(-len(ids) // 4096))]
    got = run(spark, "op7_swap_packing")
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_op10(spark, texts):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for d, t in texts.items():
        ids = np.array(enc.encode_ordinary(t), "<u4")
        want[d] = (len(ids), sha(ids.tobytes()), sha(t.encode()))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op10_matrix_bpe")} == want

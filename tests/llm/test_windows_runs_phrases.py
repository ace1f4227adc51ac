"""Substring dedup, periodic runs and collocations against brute force: edge cases, forced collisions, spills, both join ways."""

import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphquarry.llm import periodic, phrases, windows

DOC = "doc_id long, text string, lang string, source string, n_chars long, part string, runs string, words string, n string, gram string, bucket string, _id string, check string"
WHITE = "[\x20\x09-\x0d]+"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *["?"] * 8) for i, t, lang in rows], DOC)


def words(t):
    return [w for w in re.split(WHITE, t or "") if w]


def corpus(rng, n=40, vocabulary=400):
    """Documents that share passages, repeat themselves, and are copies; null and empty texts; ids that are null or shared."""
    pick = lambda m: [f"w{x}" for x in rng.integers(0, vocabulary, m)]
    passages = [pick(int(m)) for m in rng.integers(15, 60, 6)]
    rows = []
    for i in range(n):
        own = pick(int(rng.integers(0, 50)))
        for p in rng.permutation(6)[: int(rng.integers(0, 3))]:
            own += passages[p] + pick(int(rng.integers(0, 5)))
        if i % 9 == 0:
            own += own
        rows.append((100 - i, "  ".join(own) if i % 2 else "\n".join(own), ["en", "de", None][i % 3]))
    rows += [(500, rows[3][1], "en"), (501, rows[3][1] + " tail", "en"), (7, None, "en"), (8, "", None), (9, " \t\r\n", "de")]
    rows += [(None, rows[3][1], "en"), (None, rows[5][1], "en"), (None, None, "en"), (rows[4][0], rows[6][1], "en"), rows[8], rows[8]]
    rows += [(600, "loop the loop " * 3000, "en"), (601, "é à " * 40, "de"), (602, "one\x0btwo\x0cthree four five", "en")]
    return rows


# -- substring dedup ------------------------------------------------------------------------------
def kept_words(named, size):
    """named: {(none, id, part): words} -> {(none, id, part): kept words}."""
    seen, out = set(), {}
    for key in sorted(named):
        w = named[key]
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            x = tuple(w[s : s + size])
            if x in seen:
                gone[s : s + size] = [True] * size
            seen.add(x)
        out[key] = [x for x, g in zip(w, gone) if not g]
    return out


@pytest.mark.parametrize("options", [{}, {"width": 1, "buckets": 1, "max_sent": 0}, {"buckets": 7, "pack_bytes": 500}, {"buckets": 3, "pack_bytes": 1, "max_sent": 0}])
def test_windows(spark, options):
    rows = corpus(np.random.default_rng(5))
    docs = frame(spark, rows)
    got = windows.dedup_windows(docs, 20, **options).collect()
    parts = [(r["doc_id"], r["part"], r["text"]) for r in windows.named(docs, "doc_id", "text").collect()]
    assert {i for i, p, _ in parts if p} == {None, rows[4][0]}
    named = {(i is None, i or 0, p): words(t) for i, p, t in parts}
    kept = kept_words(named, 20)
    want = sorted((str(i), len(words(t)), len(words(t)) - len(kept[i is None, i or 0, p]), " ".join(kept[i is None, i or 0, p])) for i, p, t in parts)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == want
    for r in got:
        ends = [(s["start"], s["start"] + s["length"]) for s in r["spans"]]
        assert sum(e - s for s, e in ends) == r["n_removed"] and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_windows_of_other_sizes_and_an_empty_table(spark):
    rows = [(1, "a b c a b c d", "en"), (2, "b c d a", "en"), (3, "a b", "en")]
    for size in (1, 2, 3, 5):
        got = {r["doc_id"]: r["kept_text"] for r in windows.dedup_windows(frame(spark, rows), size).collect()}
        assert got == {k[1]: " ".join(w) for k, w in kept_words({(False, i, 0): t.split() for i, t, _ in rows}, size).items()}
    assert windows.dedup_windows(frame(spark, [])).collect() == []


@pytest.mark.parametrize("size", [1, 2, 3, 7, 20, 31])
def test_rolling_hash_is_the_polynomial(size):
    v = np.random.default_rng(size).integers(0, 2**64, 60, dtype=np.uint64)
    factor = 0x9E3779B97F4A7C15
    want = [sum(int(x) * pow(factor, j, 2**64) for j, x in enumerate(v[i : i + size])) % 2**64 for i in range(60 - size + 1)]
    assert windows.rolling(v, size, factor).tolist() == want
    assert windows.rolling(v[: size - 1], size, factor).tolist() == []


def test_packing_round_trip():
    rng = np.random.default_rng(3)
    names = windows.Docs(np.array([0, 0, 0, 1]), np.array([-5, 3, 2**62, 0]), np.array([0, -7, 0, 9]))
    doc = np.sort(rng.integers(0, 4, 100))
    place = np.concatenate([np.sort(rng.choice(10**6, (doc == k).sum(), replace=False)) for k in range(4)])
    rows = [windows.pack(names, doc[a:z], place[a:z]) for a, z in ((0, 40), (40, 100))]
    found, d, p = windows.unpack(rows)
    assert p.tolist() == place.tolist()
    for k in ("none", "ids", "parts"):
        assert getattr(found, k)[d].tolist() == getattr(names, k)[doc].tolist()


def test_a_false_match_is_found_and_repaired(spark):
    """With hashes of one byte in one bucket different windows do look equal; the check must see it, and the next pass be right."""
    rng = np.random.default_rng(9)
    docs = frame(spark, [(i, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 60)), "en") for i in range(20)])
    rows = windows.named(docs, "doc_id", "text")
    runs = windows.repeated_runs(rows, 20, 1, 1, 1)
    assert runs.count() > 0
    total = sum(r["check"] for r in windows._kept(rows, runs, 20, 1).collect())
    assert total % 2**64
    assert sum(r["n_removed"] for r in windows.dedup_windows(docs, 20, width=1, buckets=1).collect()) == 0


# -- periodic runs --------------------------------------------------------------------------------
def brute_runs(w):
    out = []
    n = len(w)
    for q in range(1, n // 4 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e > s and e + q - s >= max(6, 4 * q):
                stretch = w[s : e + q]
                if not any(all(stretch[i] == stretch[i + p] for i in range(len(stretch) - p)) for p in range(1, q)):
                    out.append((s, e + q - s, q))
            s = max(e, s + 1) if e > s else s + 1
    return sorted(out)


@pytest.mark.parametrize("heavy", [None, 0, 2, 10**9])
def test_runs_of_random_words(heavy):
    rng = np.random.default_rng(1)
    for _ in range(150):
        w = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 90)))
        if rng.random() < 0.6 and len(w) > 12:
            a, p = int(rng.integers(0, len(w) - 8)), int(rng.integers(1, 9))
            w[a:] = [w[a + (i - a) % p] for i in range(a, len(w))]
        assert periodic.runs_of(w, heavy) == brute_runs(w.tolist())


def test_lag_matches_are_exact():
    rng = np.random.default_rng(2)
    for n, kinds in ((1, 1), (50, 3), (3000, 7), (3000, 2000)):
        w = rng.integers(0, kinds, n)
        want = [int((w[q:] == w[: n - q]).sum()) if q else None for q in range(n // 4 + 1)]
        for heavy in (None, 0, 5, 10**9):
            assert periodic.lag_matches(w, n // 4, heavy)[1:].tolist() == want[1:]


def test_periodic_runs(spark):
    rows = corpus(np.random.default_rng(6), 12, 5)
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic.periodic_runs(frame(spark, rows)).collect())
    want = []
    for i, t, _ in rows:
        w = words(t)
        runs = brute_runs(w) if len(w) < 2000 else [(0, 9000, 3)]
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        want.append((str(i), len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want)
    assert periodic.periodic_runs(frame(spark, [])).collect() == []


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 50)), "en") for i in range(300)] + [(None, "a b c", "en"), (301, None, "en")]
    got = {r["doc_id"]: words(r["text"]) for r in periodic.planted(frame(spark, rows)).collect()}
    for i, t, _ in rows:
        w, h = words(t), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
        assert got[i] == w


def test_best_run_by_exact_fraction(spark, tmp_path):
    texts = ["x " * 7 + "a b " * 5, "a b " * 3 + "c", "p q r s t " * 4 + "y", "k k k k k k l l l l l l"]
    frame(spark, [(i, t, "en") for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    for r in periodic.op12(spark, str(tmp_path)).collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 10:
            runs = brute_runs(words(texts[r["doc_id"]]))
            best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
            assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
            assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)


# -- collocations ---------------------------------------------------------------------------------
def brute_phrases(rows, top, most, least, percent):
    f, n = Counter(), Counter()
    for _, t, lang in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cands = {k: a for k, a in f.items() if len(k[1]) >= 2 and a >= least}
    inner = defaultdict(int)
    for (lang, w), a in cands.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                inner[lang, w[i : i + m]] = max(inner[lang, w[i : i + m]], a)
    out = defaultdict(list)
    for (lang, w), a in cands.items():
        if 100 * inner[lang, w] >= percent * a:
            continue
        cut = min((1000000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-cut[0], -a, " ".join(w).encode(), cut[2], cut[3]))
    return sorted((lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for i, (s, a, p, x, y) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize("options", [{}, {"least": 2, "top": 15}, {"least": 2, "most": 4, "percent": 80, "buckets": 5}, {"least": 3, "most": 2, "buckets": 1}])
def test_collocations(spark, options):
    o = {"top": 2000, "most": 3, "least": 10, "percent": 50} | {k: v for k, v in options.items() if k != "buckets"}
    rows = corpus(np.random.default_rng(8), 30, 12)
    rows += [(700, "New York, new york. NEW YORK!\tÉtat É\n new\tyork: a , ,; ", None), (701, "naïve Éclair. " * 12, "fr"), (702, "x" * 50_000, "fr"), (703, "ab " * 5000, "zz")]
    got = sorted(tuple(r) for r in phrases.collocations(frame(spark, rows), **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == brute_phrases(rows, **o)


def test_collocations_of_nothing(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [(1, None, None), (2, " ,, ", "en")])).collect() == []


def test_scores_beyond_64_bits(spark):
    a, x, y = 3_000_000_019, 7_000_000_033, 9_000_000_011
    counts = spark.createDataFrame([("en", 1, "p", x), ("en", 1, "q", y), ("en", 2, "p q", a)], "lang string, n int, gram string, f long")
    assert [tuple(r) for r in phrases.scored(counts).select("a", "l", "r", "score").collect()] == [(a, x, y, 1000000 * a * a // (x * y))]


def test_small_packs_give_the_same_counts(spark):
    rows = frame(spark, corpus(np.random.default_rng(4), 20, 9))
    every = lambda pack: sorted(map(tuple, phrases.frequent(phrases.pieces(rows), 3, 2, 4, pack).groupBy("lang", "n", "gram").agg(F.sum("f")).collect()))
    assert every(50) == every(1 << 22)

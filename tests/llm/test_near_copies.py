"""The pipeline's near-dedup stage on planted pairs around a similarity of 0.8, against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from graphquarry.llm import jaccard
from graphquarry.llm.common import stash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set()))
    return out


def brute_links(sets):
    n = range(len(sets))
    return [(i, j) for i in n for j in range(i) if len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])]


def brute_kept(n, links):
    root = list(range(n))
    for _ in range(n):
        before = list(root)
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
        if root == before:
            return {i for i in range(n) if root[i] == i}


def planted(rng, n_bases=60, words=240):
    texts = []
    for b in range(n_bases):
        base = [f"w{rng.integers(4000)}" for _ in range(words)]
        texts.append(" ".join(base))
        for edits in (1, 3, 4, 5, 6, 7, 9):  # each changes five shingles of 236
            t = list(base)
            for k, at in enumerate(rng.choice(words // 6, edits, replace=False)):
                t[at * 6 + 2] = f"edit{b}x{edits}x{k}"
            texts.append(" ".join(t))
    return texts


def run(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    return [r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, "").collect()]


def test_planted_pairs(spark):
    texts = planted(np.random.default_rng(5))
    sets = brute_sets(texts)
    links = brute_links(sets)
    near = [len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in links]
    assert sum(s < 0.85 for s in near) > 100
    got = run(spark, texts)
    assert len(got) == len(set(got)) and set(got) == brute_kept(len(texts), links)


def test_a_large_group_and_short_texts(spark):
    rng = np.random.default_rng(6)
    base = [f"w{rng.integers(4000)}" for _ in range(200)]
    texts = ["", None, " \n", "one", "ONE", "one two", "one two three four five six seven", "one two three four five six eight"]
    for k in range(300):
        t = list(base)
        for at in rng.choice(200, int(rng.integers(1, 7)), replace=False):
            t[at] = f"e{k}x{at}"
        texts.append(" ".join(t))
    got = run(spark, texts)
    assert set(got) == brute_kept(len(texts), brute_links([s or {"nothing"} for s in brute_sets(texts)]))


def assembled(rng, n, paragraphs=30, of=3):
    """Texts of some of the same paragraphs and one word of their own."""
    stock = [" ".join(f"p{i}w{rng.integers(10**6)}" for _ in range(20)) for i in range(paragraphs)]
    return [" ".join([*(stock[p] for p in sorted(rng.choice(paragraphs, of, replace=False))), f"own{k}"]) for k in range(n)]


@pytest.mark.parametrize("sizes,own_words", [((120, 360), 1), ((150,), 14)])
def test_texts_of_the_same_paragraphs(spark, monkeypatch, sizes, own_words):
    """The pairs to verify follow the ways to combine paragraphs, not the texts; with many words of their own, texts of the same paragraphs aren't linked."""
    counts, across = [], jaccard._across

    def spy(*a):
        out = stash(across(*a), "pairs")
        counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_across", spy)
    for n in sizes:
        texts = [t + "".join(f" and{k}x{i}" for i in range(own_words - 1)) for k, t in enumerate(assembled(np.random.default_rng(4), n, 8))]
        assert set(run(spark, texts)) == brute_kept(len(texts), brute_links(brute_sets(texts)))
    assert counts[-1] <= 2 * counts[0] + 60  # 56 ways


def test_sets_that_share_a_name_are_renamed(spark):
    rows = [(1, 1, 5, 70, 0, 3, [1]), (2, 2, 5, 71, 0, 3, [1]), (3, 3, 5, 70, 0, 3, [1]), (4, 4, 6, 72, 0, 3, [1])]
    found = spark.createDataFrame(rows, "doc_id long, text_hash long, node long, check long, fp long, size int, keys array<long>")
    again, nodes = jaccard._named(found)
    names = {r["doc_id"]: r["node"] for r in again.collect()}
    assert names[1] == names[3] == 5 and names[4] == 6 and len({5, 6, names[2]}) == 3 and nodes.count() == 3

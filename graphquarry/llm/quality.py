"""Quality classifier: a sparse ensemble of rules from trees over text statistics.

Shallow boosted trees are grown over the statistics; every path from a root becomes a conjunctive
rule. A logistic model with an L1 penalty over all rules and the clipped statistics picks few of
them, and the picked ones become one Spark column expression. Only labels, and the statistics of
the texts they belong to, are learnt from: never doc_id, lang or source.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, spread, stash, text_hash, whole_row

STATS = [
    "log_bytes", "upper", "digit", "blank", "line_end", "pipe", "bang", "symbol", "stop", "other_mark", "non_ascii",
    "log_words", "word_bytes", "unique_words", "mark_words", "upper_words", "symbol_words", "log_lines", "line_bytes", "repeated_lines", "top_word",
]
#: Rows that the model is fitted on at most: those with the smallest hashes of id and text.
MAX_TRAIN_ROWS = 20_000

_CLASS = np.full(256, 255, np.uint8)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n", b"|", b"!", b"#$%&*@^~<>{}[]\\/_=+`", b".,;:?", b"'\"-()")):
    for _c in _chars:
        _CLASS[_c] = _k
_CLASS[128:] = 9
_MARKS = frozenset("|!#$%&*@^~<>{}[]\\/_=+`")


def _counts(text: bytes) -> np.ndarray:
    total = np.zeros(256, np.int64)
    for at in range(0, len(text), 1 << 20):
        total += np.bincount(_CLASS[np.frombuffer(text[at : at + (1 << 20)], np.uint8)], minlength=256)
    return total[:10]


def statistics(text: str | None) -> list[float]:
    """The values of STATS for one whole text; null and empty texts: all 0."""
    t = text or ""
    raw = t.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    words, lines = t.split(), t.split("\n")
    w = max(1, len(words))
    distinct: dict[str, int] = {}
    for x in words:
        distinct[x] = distinct.get(x, 0) + 1
    upper = marked = alone = 0
    for x, k in distinct.items():
        if x.isupper():
            upper += k
        if x[-1] in _MARKS:
            marked += k
            if len(x) == 1:
                alone += k
    return [
        float(np.log1p(len(raw))), *(float(c) / n for c in _counts(raw)), float(np.log1p(len(words))), (len(raw) - len(words)) / w if words else 0.0,
        len(distinct) / w, marked / w, upper / w, alone / w, float(np.log1p(len(lines) if t else 0)), len(raw) / len(lines),
        1 - len(set(lines)) / len(lines), max(distinct.values(), default=0) / w,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def measured(texts: pa.Array) -> pa.Array:
    """The STATS of each text."""
    rows = np.array([statistics(t) for t in texts.to_pylist()], np.float64).reshape(-1)
    return pa.ListArray.from_arrays(np.arange(0, len(rows) + 1, len(STATS), dtype=np.int32), rows)


# -- trees and rules ------------------------------------------------------------------------------
Condition = tuple[int, bool, float]  # statistic, above, bound: x > bound, or x <= bound


@dataclass
class RuleModel:
    bias: float
    rules: list[tuple[tuple[Condition, ...], float]]
    linear: list[tuple[int, float, float, float]]  # statistic, low, high, weight of the clipped value

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for conds, w in self.rules:
            out += w * _holds(x, conds)
        for j, a, b, w in self.linear:
            out += w * np.clip(x[:, j], a, b)
        return out

    def score(self, stats: Column) -> Column:
        """The score as an expression over an array of the STATS."""
        total = F.lit(self.bias)
        for conds, w in self.rules:
            test = None
            for j, above, bound in conds:
                one = stats[j] > bound if above else stats[j] <= bound
                test = one if test is None else test & one
            total = total + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        for j, a, b, w in self.linear:
            total = total + F.greatest(F.lit(a), F.least(F.lit(b), stats[j])) * F.lit(w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(x: np.ndarray, conds) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, bound in conds:
        out &= x[:, j] > bound if above else x[:, j] <= bound
    return out


def _grow(codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: tuple, rules: set, out: np.ndarray, least: int) -> None:
    """One regression tree on gradients, by histograms; adds each node's path to rules and leaf values to out."""
    if path:
        rules.add(path)
    best = (1e-9, None)
    if depth and len(rows) >= 2 * least:
        gs, hs = g[rows].sum(), h[rows].sum()
        for j in range(codes.shape[1]):
            if not len(cuts[j]):
                continue
            c = codes[rows, j]
            n = len(cuts[j]) + 1
            gl, hl, nl = np.cumsum(np.bincount(c, g[rows], n))[:-1], np.cumsum(np.bincount(c, h[rows], n))[:-1], np.cumsum(np.bincount(c, minlength=n))[:-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (j, k))
    if best[1] is None:
        out[rows] = -g[rows].sum() / (h[rows].sum() + 1)
        return
    j, k = best[1]
    low, bound = codes[rows, j] <= k, float(cuts[j][k])
    _grow(codes, cuts, g, h, rows[low], depth - 1, (*path, (j, False, bound)), rules, out, least)
    _grow(codes, cuts, g, h, rows[~low], depth - 1, (*path, (j, True, bound)), rules, out, least)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, seed: int) -> list[tuple[Condition, ...]]:
    """Paths of boosted trees, each grown on a random half of the rows."""
    rng = np.random.default_rng(seed)
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1]))
        cuts.append(q[q < x[:, j].max()])
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    margin, rules = np.zeros(len(y)), set()
    least = max(5, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.permutation(len(y))[: max(1, len(y) // 2)])
        step, own = np.zeros(len(y)), set()
        _grow(codes, cuts, p - y, p * (1 - p), rows, depth, (), own, step, least)
        leaves = [r for r in own if not any(len(q) > len(r) and q[: len(r)] == r for q in own)]
        for r in leaves:
            held = _holds(x, r)
            inside = rows[held[rows]]
            margin[held] += 0.3 * step[inside[0]] if len(inside) else 0
        rules |= own
    return sorted(rules, key=repr)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """(bias, weights) by accelerated proximal gradient; columns of z should have like scales."""
    n, m = z.shape
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, vb, t = w.copy(), b, 1.0
    u = np.ones(m) / max(1, m) ** 0.5
    for _ in range(20):  # the largest eigenvalue of z'z / n
        u = z.T @ (z @ u) / n
        top = float(np.linalg.norm(u)) or 1.0
        u /= top
    rate = 1 / (0.25 * (top + 1))
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(z @ v + vb))) - y
        new = v - rate * (z.T @ r / n)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        nb = vb - rate * float(r.mean())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = new, nb, t2
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-3, max_rules: int = 400, seed: int = 7) -> RuleModel:
    """No rows, or one label only: a constant score, the smoothed share of label 1."""
    if not len(y) or len(np.unique(y)) < 2:
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), [], [])
    rules = tree_rules(x, y, trees, depth, seed)
    held = np.stack([_holds(x, r) for r in rules], axis=1) if rules else np.zeros((len(y), 0), bool)
    share = held.mean(axis=0)
    rank = np.argsort(-np.abs(((held - share) * (y - y.mean())[:, None]).mean(axis=0)) / np.sqrt(share * (1 - share) + 1e-9), kind="stable")
    use, seen = [], set()
    for i in rank:
        mark = held[:, i].tobytes()
        if 0 < share[i] < 1 and mark not in seen and len(use) < max_rules:
            seen.add(mark)
            use.append(i)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    spread = clipped.std(axis=0)
    lin = np.flatnonzero(spread > 1e-12)
    scale = 0.4 / spread[lin]  # as much as a typical rule
    center = clipped[:, lin].mean(axis=0)
    z = np.concatenate([held[:, use].astype(float), (clipped[:, lin] - center) * scale], axis=1)
    b, w = lasso_logistic(z, y, penalty)
    k = len(use)
    linear = [(int(j), float(low[j]), float(high[j]), float(w[k + i] * scale[i])) for i, j in enumerate(lin) if w[k + i]]
    b -= sum(float(w[k + i] * scale[i] * center[i]) for i in range(len(lin)))
    return RuleModel(float(b), [(rules[i], float(w[c])) for c, i in enumerate(use) if w[c]], linear)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _bound(rows: DataFrame, most: int) -> int:
    """A bound on rows(at), 63-bit numbers, with ``most`` distinct ones at or below it, or all if fewer; twice as many at most.

    Counts by 12 more bits of the number each time, so 4096 rows reach the driver at once.
    """
    low, bits, taken = 0, 63, 0
    while True:
        step = min(12, bits)
        part = rows.filter((F.col("at") >= low) & (F.col("at") <= low + (1 << bits) - 1))
        counts = part.groupBy(F.shiftright(F.col("at") - low, bits - step).alias("k")).agg(F.countDistinct("at").alias("n")).collect()
        for k, n in sorted((r["k"], r["n"]) for r in counts):
            if taken + n >= most:
                break
            taken += n
        else:
            return low + (1 << bits) - 1
        low, bits = low + (k << (bits - step)), bits - step
        if n <= most or not bits:
            return low + (1 << bits) - 1


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Fits on ``max_rows`` labelled rows that aren't held out; null labels and doc_ids are left out, repeated rows count once.

    Which rows these are depends on a hash of id and text alone. Only their statistics are worked out,
    and about twice as many at most reach the driver.
    """
    known = labels.filter("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("quality")).distinct()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text")).filter(~held_out(F.col("doc_id")))
    at = F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash"), 1).alias("at")
    names = stash(rows.select("doc_id", "text_hash", at).join(known, "doc_id"), "labelled")
    few = names.filter(F.col("at") <= _bound(names.select("at"), max_rows)).distinct()
    got = rows.join(F.broadcast(few), ["doc_id", "text_hash"]).dropDuplicates(["at", "quality"])  # few: bounded by max_rows
    got = got.select("at", "quality", measured("text").alias("stats")).toPandas().sort_values(["at", "quality"]).head(max_rows)
    x = np.array(got["stats"].tolist(), float).reshape(-1, len(STATS))
    return fit_rules(x, (got["quality"].to_numpy(float) > 0.5).astype(float))


def score_documents(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(doc_id, score): one row for each row of ``docs``; the fit runs when this is called.

    score: 0 to 1, higher: label 1 likelier. Null and empty texts have statistics 0 and get a score
    too. Without usable labels the score is a constant. Repeated rows return each, null doc_ids too
    (they are never learnt from); extra columns are ignored.
    """
    arrow_limits(docs.sparkSession)
    model = train(docs, labels, max_rows)
    return spread(docs.select("doc_id", "text"), "doc_id").select("doc_id", measured("text").alias("stats")).select("doc_id", model.score(F.col("stats")).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose text scores below the threshold.

    Each row is judged by its own text, rows that share a doc_id and rows with a null one too; repeated
    rows all stay or all go. No join brings the verdict back: the score is a filter on the row.
    """
    arrow_limits(docs.sparkSession)
    model = train(docs, labels)
    rows = spread(docs, "doc_id").select(whole_row(docs).alias("row"), measured("text").alias("stats"))
    return rows.filter(model.score(F.col("stats")) >= threshold).select("row.*")


def op5(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_documents(docs, labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

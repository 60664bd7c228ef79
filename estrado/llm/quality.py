"""Quality: a sparse rule ensemble.

Statistics of a text feed small boosted trees, fitted on a bounded sample of labelled rows. Every path from a tree's
root to a node is a rule, a conjunction of thresholds; rules and clipped linear terms get lasso
logistic weights, most of them zero, and what is left is compiled into one Spark column expression
over the statistics. The score is the logistic of the weighted sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table, with_defaults, written

#: Labelled rows that are fitted at most; rows are taken in the order of a hash.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS = 40, 3, 48
LASSO = 2e-3
STATS = [
    "chars", "words", "word_length", "symbols", "digits", "upper", "bangs", "bars", "non_ascii",
    "repeats", "distinct", "short", "lines", "line_repeats", "line_words", "stops", "longest",
]
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)) + b" \t\n\r\x0b\x0c"
_DIGITS = b"0123456789"
_PLAIN = b".,;:'\"?()-"
_UPPER = bytes(range(65, 91))
_HIGH = bytes(range(128, 256))


def stats(text: str | None) -> list[float]:
    """STATS of a whole text; null counts as empty, whose statistics are all zero."""
    t = text or ""
    b = t.encode("utf-8", "surrogatepass")
    w = b.split()
    if not w:
        return [float(len(t))] + [0.0] * (len(STATS) - 1)
    n, size = len(w), max(1, len(b))
    lines = [x for x in b.split(b"\n") if x.strip()]
    lengths = list(map(len, w))
    without = lambda x: size - len(b.translate(None, x))
    digits, high = without(_DIGITS), without(_HIGH)
    letters = max(1, without(_LETTERS))
    symbols = len(b.translate(None, _LETTERS + _DIGITS + _PLAIN))
    upper = sum(map(str.isupper, map(lambda x: x[:2], t.split()))) if high > size // 20 else sum(map(bytes.isupper, w))
    return [
        float(len(t)), float(n), sum(lengths) / n, symbols / size, digits / size, upper / n, b.count(b"!!") / n, w.count(b"|") / n, high / size,
        sum(map(bytes.__eq__, w, w[1:])) / n, len(set(w)) / n, sum(x <= 3 for x in lengths) / n, float(len(lines)), 1 - len(set(lines)) / len(lines), n / len(lines),
        (b.count(b". ") + b.count(b".\n")) / n, float(max(lengths)),
    ]


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, STATS) of every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = [stats(x) for x in b.column(1).to_pylist()]
            cols = np.array(rows, np.float64).reshape(len(rows), len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.ascontiguousarray(cols[:, i])) for i in range(len(STATS))]], names=["doc_id", *STATS])

    return small_batches(docs).select("doc_id", text).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"`{s}` double" for s in STATS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, at most, threshold) all hold


def _tree(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: Rule, depth: int, out: np.ndarray, rules: list[Rule]) -> None:
    """Grows one tree on gradients; adds the path of every node to rules and the leaves' values to out."""
    if path:
        rules.append(path)
    G, H = g[rows].sum(), h[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 40:
        for f in range(codes.shape[1]):
            c = codes[rows, f]
            gl = np.cumsum(np.bincount(c, g[rows], BINS + 1))[:-1]
            hl = np.cumsum(np.bincount(c, h[rows], BINS + 1))[:-1]
            nl = np.cumsum(np.bincount(c, minlength=BINS + 1))[:-1]
            gain = gl**2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G**2 / (H + 1)
            gain[(nl < 15) | (len(rows) - nl < 15)] = -1
            gain = gain[: len(edges[f])]
            if len(gain) and gain.max() > best[0]:
                best = (float(gain.max()), (f, int(gain.argmax())))
    if best[1] is None:
        out[rows] = G / (H + 1)
        return
    f, k = best[1]
    left = codes[rows, f] <= k
    for side, mine in ((True, rows[left]), (False, rows[~left])):
        _tree(codes, edges, g, h, mine, (*path, (f, side, float(edges[f][k]))), depth - 1, out, rules)


def _holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, at_most, t in rule:
        ok &= (x[:, f] <= t) if at_most else (x[:, f] > t)
    return ok


class Ensemble:
    """Weighted rules and linear terms: bias + sum of weight * rule + sum of slope * clip(statistic)."""

    def __init__(self, bias: float, rules: list[tuple[float, Rule]], linear: list[tuple[float, int, float, float]]):
        self.bias, self.rules, self.linear = bias, rules, linear

    def column(self) -> Column:
        """The score as a column over the statistics."""
        z = F.lit(self.bias)
        for w, rule in self.rules:
            hold = F.lit(True)
            for f, at_most, t in rule:
                hold = hold & ((F.col(STATS[f]) <= t) if at_most else (F.col(STATS[f]) > t))
            z = z + F.when(hold, F.lit(w)).otherwise(F.lit(0.0))
        for w, f, low, high in self.linear:
            z = z + w * F.least(F.greatest(F.col(STATS[f]), F.lit(low)), F.lit(high))
        return 1 / (1 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for w, rule in self.rules:
            z += w * _holds(rule, x)
        for w, f, low, high in self.linear:
            z += w * np.clip(x[:, f], low, high)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Ensemble:
    """An ensemble from statistics and labels 0 or 1. No rows, or one label alone: a constant score."""
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.5
        p = min(max(p, 0.01), 0.99)
        return Ensemble(float(np.log(p / (1 - p))), [], [])
    rng = np.random.Generator(np.random.PCG64(seed))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        out = np.zeros(len(y))
        grown: list[Rule] = []
        _tree(codes, edges, y - p, p * (1 - p), rows, (), DEPTH, out, grown)
        step = np.zeros(len(y))
        leaves = {r: float(out[rows[_holds(r, x[rows])][0]]) for r in grown if _holds(r, x[rows]).any() and not any(len(q) > len(r) and q[: len(r)] == r for q in grown)}
        for r, v in leaves.items():
            step += v * _holds(r, x)
        z = z + 0.3 * step
        rules += grown
    unique = list(dict.fromkeys(tuple(sorted(r)) for r in rules))
    # rules that hold for the same rows are one
    distinct = {np.packbits(_holds(r, x)).tobytes(): r for r in reversed(unique)}
    unique = list(distinct.values())[::-1]
    cols = np.array([_holds(r, x) for r in unique], np.float64).reshape(len(unique), len(x)).T
    clip = [(float(np.quantile(x[:, f], 0.025)), float(np.quantile(x[:, f], 0.975))) for f in range(x.shape[1])]
    line = np.stack([np.clip(x[:, f], *clip[f]) for f in range(x.shape[1])], axis=1)
    sd = line.std(axis=0)
    sd[sd == 0] = np.inf
    X = np.concatenate([cols - cols.mean(axis=0), 0.4 * (line - line.mean(axis=0)) / sd], axis=1)
    # accelerated proximal gradient of the lasso
    step = 4 * len(y) / max(np.linalg.norm(X.T @ X, 2), 1e-9)
    w, v, b, t = np.zeros(X.shape[1]), np.zeros(X.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), 1.0
    for _ in range(400):
        e = y - 1 / (1 + np.exp(-(X @ v + b)))
        b += 4 * e.mean()
        u = v + step * (X.T @ e) / len(y)
        new = np.sign(u) * np.maximum(np.abs(u) - step * LASSO, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    k = len(unique)
    slope = 0.4 * w[k:] / sd
    bias = b - float(w[:k] @ cols.mean(axis=0)) - float(slope @ line.mean(axis=0))
    return Ensemble(bias, [(float(w[i]), unique[i]) for i in range(k) if w[i]], [(float(slope[f]), f, *clip[f]) for f in range(x.shape[1]) if slope[f]])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(stat: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Ensemble:
    """Fits on at most rows labelled rows, those of the least hash of doc_id, none of them held out."""
    l = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", label)
    l = l.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(rows)
    # a doc_id may repeat on both sides, so the joined rows are bounded as well
    joined = stat.join(F.broadcast(l), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", label, *STATS).limit(rows)
    got = joined.select(*STATS, label).collect()
    m = np.array([tuple(r) for r in got], np.float64).reshape(len(got), len(STATS) + 1)
    m = m[np.lexsort(m.T)]
    return fit(m[:, :-1], m[:, -1])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs(doc_id, text).

    Null and empty texts are scored by their (zero) statistics. Rows that repeat a doc_id are scored one by one; a null doc_id
    is never held out nor learned from. Labels other than 0 and 1 are ignored. An empty table gives no rows.
    """
    stat = written(with_stats(docs), "statistics")
    model = train(stat, labels)
    s = stat.select("doc_id", model.column().alias("score"))
    return s.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7(spark, sf_dir: str) -> DataFrame:
    return score(with_defaults(table(spark, sf_dir, "documents"), "doc_id", "text"), with_defaults(table(spark, sf_dir, "labels"), "doc_id", "quality"))

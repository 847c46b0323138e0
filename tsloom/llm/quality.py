"""Quality: a sparse rule ensemble over text statistics.

Statistics of each whole text (shares of byte classes, word and line shapes,
repetition) are counted in numpy.  On a bounded labelled sample (SAMPLE rows of
each class) small boosted trees are grown; every path from a root to a node is
a conjunctive rule.  A lasso logistic fit over rules and clipped linear terms
keeps few of them, and those are compiled into one Spark column expression over
the statistics, so a model can be read, stored and applied in SQL.

Defined results: null and empty texts have zero statistics and are scored by
the same rules; repeated rows are repeated; without labels of both classes every
score is the labels' smoothed rate, or 1 where there are none at all; an empty
table gives no rows; clashing column names of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.llm.sample import learned, remainder
from tsloom.llm.textbytes import ALNUM, LOWER, SOLID, hashes, runs, words

FOLDS, HELD_OUT, CUT = 5, 0, 0.3
#: Labelled rows learned from, at most: of low quality, of high quality.
SAMPLE = (3000, 5000)
TREES, DEPTH, SHRINK, BINS, LEAF = 24, 3, 0.3, 32, 8
PENALTY = 2e-3
#: Bytes of text counted at once.
RUN = 1 << 20

#: Byte classes: 0 others, then as in SHARES.
_CLASS = np.zeros(256, np.uint8)
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r\v\f", b".", b",;:", b"!?", b"|", b"#$%&*@^~+=<>\\/_", b"()[]{}\"'`-", bytes(range(128, 256))), start=1):
    _CLASS[list(_bytes)] = _k
SHARES = ("upper", "lower", "digit", "blank", "newline", "stop", "comma", "shout", "bar", "symbol", "bracket", "high")
STATS = (*(f"share_{s}" for s in SHARES), "log_words", "word_bytes", "distinct_words", "long_words", "symbol_words", "bare_words", "log_lines", "line_words", "repeated_lines", "words_per_stop")


def _repeats(owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes of each owner."""
    order = np.lexsort((h, owner))
    o, h = owner[order], h[order]
    fresh = np.append(True, (o[1:] != o[:-1]) | (h[1:] != h[:-1])) if len(o) else np.zeros(0, bool)
    return np.bincount(o[fresh], minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATS for each text."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    counts = np.bincount(owner * 13 + _CLASS[data], minlength=13 * n).reshape(n, 13)[:, 1:]
    low = LOWER[data]
    starts, ends, rows = words(low, offsets, SOLID)
    lens, per = ends - starts, np.diff(rows)
    mine = np.repeat(np.arange(n), per)
    some = np.maximum(per, 1)
    h = hashes(low, starts, ends)
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~ALNUM[low], out=marks[1:])
    odd = marks[ends] - marks[starts]
    line = np.ones(256, bool)
    line[10] = False
    ls, le, lrows = words(low, offsets, line)
    lines = np.diff(lrows)
    unlike = _repeats(np.repeat(np.arange(n), lines), hashes(low, ls, le), n)
    by = lambda x: np.bincount(mine, weights=x, minlength=n) / some
    return np.column_stack(
        [
            counts / np.maximum(sizes, 1)[:, None], np.log1p(per), by(lens), _repeats(mine, h, n) / some, by(lens > 20), by(odd >= 2), by(odd == 0), np.log1p(lines), per / np.maximum(lines, 1), 1 - unlike / np.maximum(lines, 1), per / (1.0 + counts[:, 5]),
        ]
    ).astype(np.float64)


def _of_texts(texts: list[str]) -> np.ndarray:
    batch = pa.record_batch([pa.array(texts, pa.large_string())], names=["text"])
    return np.concatenate([statistics(d, o) for _, d, o in runs(batch, limit=RUN)])


Rule = tuple[tuple[int, bool, float], ...]  #: (statistic, above, limit), all of which hold


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: list[np.ndarray], binned: np.ndarray, rows: np.ndarray, path: Rule, found: list[Rule], out: np.ndarray) -> None:
    """Splits rows by the best gain, notes each node's path, writes the leaves' steps to out."""
    g, h = grad[rows].sum(), hess[rows].sum()
    out[rows] = -SHRINK * g / (h + 1)
    if path:
        found.append(path)
    if len(path) == DEPTH or len(rows) < 2 * LEAF:
        return
    best = (1e-6, -1, -1)
    for f in range(x.shape[1]):
        b = binned[rows, f]
        gs = np.cumsum(np.bincount(b, weights=grad[rows], minlength=BINS))[:-1]
        hs = np.cumsum(np.bincount(b, weights=hess[rows], minlength=BINS))[:-1]
        ns = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < LEAF) | (len(rows) - ns < LEAF)] = 0
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    if best[1] < 0:
        return
    f, limit = best[1], float(edges[best[1]][best[2]])
    above = x[rows, f] > limit
    for side in (False, True):
        _grow(x, grad, hess, edges, binned, rows[above == side], (*path, (f, side, limit)), found, out)


def rules_of(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[Rule]:
    """Distinct paths of boosted trees."""
    edges, binned = [], np.zeros(x.shape, np.int64)
    for f in range(x.shape[1]):
        cut = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        values = np.unique(x[:, f])
        up = values[np.minimum(np.searchsorted(values, cut, "right"), len(values) - 1)]
        cut = np.round((cut + up) / 2, 6)
        edges.append(cut)
        binned[:, f] = np.searchsorted(cut, x[:, f], "left")
    z, found = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(y))
        _grow(x, weight * (p - y), weight * p * (1 - p), [np.append(e, np.full(BINS - 1 - len(e), np.inf)) for e in edges], binned, np.arange(len(y)), (), found, step)
        z += step
    return list(dict.fromkeys(found))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, above, limit in rule:
        ok &= (x[:, f] > limit) == above
    return ok


def lasso(a: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Sparse logistic weights and the free intercept, by accelerated proximal gradients."""
    weight = weight / weight.sum()
    full = np.column_stack([a, np.ones(len(a))])
    v = np.ones(full.shape[1])
    for _ in range(20):
        v = full.T @ (weight * (full @ v))
        v /= np.linalg.norm(v)
    step = 4 / (np.linalg.norm(full.T @ (weight * (full @ v))) + 1e-9)
    w = prev = np.zeros(full.shape[1])
    for k in range(rounds):
        at = w + k / (k + 3) * (w - prev)
        grad = full.T @ (weight * (1 / (1 + np.exp(-np.clip(full @ at, -30, 30))) - y))
        new = at - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        prev, w = w, new
    return w[:-1], float(w[-1])


class RuleModel:
    """score = sigmoid(bias + weights of the rules that hold + clipped linear terms)."""

    def __init__(self, bias: float, rules: list[tuple[Rule, float]], linear: list[tuple[int, float, float, float]]):
        self.bias, self.rules, self.linear = bias, rules, linear

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x = statistics(data, offsets)
        z = np.full(len(x), self.bias)
        for rule, w in self.rules:
            z += w * holds(rule, x)
        for f, low, high, w in self.linear:
            z += w * np.clip(x[:, f], low, high)
        return 1 / (1 + np.exp(-z))

    def column(self, stats: str = "stats") -> Column:
        """The score as a Spark expression over the struct column of statistics."""
        at = lambda f: F.col(f"{stats}.{STATS[f]}")
        z = F.lit(self.bias)
        for rule, w in self.rules:
            test = F.lit(True)
            for f, above, limit in rule:
                test = test & (at(f) > limit if above else at(f) <= limit)
            z = z + F.when(test, w).otherwise(0.0)
        for f, low, high, w in self.linear:
            z = z + w * F.greatest(F.lit(low), F.least(F.lit(high), at(f)))
        return 1 / (1 + F.exp(-z))

    def __str__(self) -> str:
        named = [f"{w:+.3f} if " + " and ".join(f"{STATS[f]} {'>' if a else '<='} {t:g}" for f, a, t in r) for r, w in self.rules]
        return "\n".join([f"{self.bias:+.3f}", *named, *(f"{w:+.3f} * clip({STATS[f]}, {lo:g}, {hi:g})" for f, lo, hi, w in self.linear)])


def fit(rows: list[tuple[str, str | None, int]], counts: tuple[int, int]) -> RuleModel:
    y = np.array([r[2] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        rate = (counts[1] + 1) / (sum(counts) + 2) if sum(counts) else 1 - 1e-12
        return RuleModel(float(np.log(rate / (1 - rate))), [], [])
    x = _of_texts([r[0] for r in rows])
    share = np.array([counts[c] / (y == c).sum() for c in (0, 1)])
    weight = share[y.astype(int)] / share[y.astype(int)].mean()
    rules = rules_of(x, y, weight)
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    spread = np.clip(x, low, high).std(axis=0)
    line = [f for f in range(x.shape[1]) if spread[f] > 1e-9]
    # Linear terms are scaled like a typical rule.
    a = np.column_stack([*(holds(r, x) for r in rules), *(0.4 * np.clip(x[:, f], low[f], high[f]) / spread[f] for f in line)]).astype(np.float64)
    w, bias = lasso(a, y, weight, PENALTY)
    kept = [(r, float(v)) for r, v in zip(rules, w[: len(rules)], strict=True) if abs(v) > 1e-6]
    linear = [(f, float(low[f]), float(high[f]), float(0.4 * v / spread[f])) for f, v in zip(line, w[len(rules) :], strict=True) if abs(v) > 1e-6]
    return RuleModel(bias, kept, linear)


def fit_on(docs: DataFrame, labels: DataFrame) -> RuleModel:
    return learned(fit, docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE)


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs with a struct column stats."""

    @F.pandas_udf(", ".join(f"{s} double" for s in STATS))
    def stats(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            batch = pa.record_batch([pa.array(s, pa.large_string(), from_pandas=True)], names=["text"])
            out = [statistics(data, offsets) for _, data, offsets in runs(batch, limit=RUN)]
            yield pd.DataFrame(np.concatenate(out) if out else np.zeros((0, len(STATS))), columns=list(STATS))

    return docs.drop("stats").withColumn("stats", stats(F.col("text").cast("string")))


def score_texts(docs: DataFrame, model: RuleModel) -> DataFrame:
    """docs with stats, score and good (score at or over CUT)."""
    scored = with_statistics(docs.drop("score", "good")).withColumn("score", model.column())
    return scored.withColumn("good", F.col("score") >= CUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_texts(docs.select("doc_id", "text"), fit_on(docs, labels))
    held = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))

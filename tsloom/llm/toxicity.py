"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words of the whole text are hashed whole and by their first 4, 6 and 8 bytes; a
word's vector is the sum of its buckets' vectors, so inflected forms of a stem
share most of it and a clash in one bucket matters little.  Filters
of widths 1, 2 and 3 slide over the words, each is max-pooled over the whole
text, and a logistic layer scores the pooled values.  All of it is trained in
numpy on a bounded sample (SAMPLE rows of each class); the first embedding
coordinate starts at the words' log-odds.  Gradients flow through the pooled
maxima only, so they are sparse.  Scores are Platt-scaled on a part of the
sample that the network didn't see, at the labels' own rates; decision
thresholds are set there by language.  lang decides which threshold holds and
is no input of the score.

Scoring multiplies filters and embeddings into one table per filter position
beforehand, so a text costs a few table look-ups a word.

Defined results: null and empty texts are scored like a text of padding;
repeated rows are repeated; null languages and languages with too few labelled
texts use the threshold of all; without labels of both classes every score is
the labels' smoothed rate, or 0 where there are none at all; an empty table
gives no rows; clashing column names of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsloom.llm.sample import learned, remainder
from tsloom.llm.textbytes import ALNUM, LOWER, hashes, ragged, runs, words

FOLDS, HELD_OUT, CUT = 4, 2, 0.3
#: Labelled rows learned from, at most: not toxic, toxic.
SAMPLE = (3000, 1200)
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 12, 6, (1, 2, 3)
EPOCHS, BATCH, RATE, DECAY = 4, 64, 0.02, 1e-4
#: Labelled texts of each class that a language needs for a threshold of its own.
SUPPORT = 20
PADS = max(WIDTHS)
#: Bytes of text tokenised at once; a word takes some hundred bytes of products meanwhile.
RUN = 1 << 19
#: Bytes of a word that each hash sees; words shorter than a prefix have none.
PREFIXES = (None, 4, 6, 8)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (hash, n) with padding after each text, positions of the windows, and each text's first position."""
    low = LOWER[data]
    starts, ends, rows = words(low, offsets, ALNUM)
    counts = np.diff(rows)
    code = np.full((len(PREFIXES), len(starts) + PADS * len(counts)), BUCKETS, np.int32)
    place = np.arange(len(starts)) + np.repeat(np.arange(len(counts)) * PADS, counts)
    for row, size in zip(code, PREFIXES, strict=True):
        some = slice(None) if size is None else ends - starts >= size
        h = hashes(low, starts[some], ends[some] if size is None else starts[some] + size)
        row[place[some]] = (h >> np.uint64(20) & np.uint64(BUCKETS - 1)).astype(np.int32)
    used = np.maximum(counts, 1)
    at = ragged(np.cumsum(counts + PADS) - counts - PADS, used)
    return code, at, np.cumsum(used) - used


def _batch(texts: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(texts, pa.large_string())], names=["text"])


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tokens() of all texts, made run by run."""
    parts, words_before, at_before = [], 0, 0
    for _, data, offsets in runs(_batch(texts), limit=RUN):
        code, at, first = tokens(data, offsets)
        parts.append((code, at + words_before, first + at_before))
        words_before, at_before = words_before + code.shape[1], at_before + len(at)
    codes, ats, firsts = zip(*parts, strict=True)
    return np.concatenate(codes, axis=1), np.concatenate(ats), np.concatenate(firsts)


class Network:
    """Embeddings, filters and output layer; float32."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.embed = [normal(BUCKETS + 1, DIM, scale=0.05) for _ in PREFIXES]
        for e in self.embed:
            e[BUCKETS] = 0
        self.kernel = {k: normal(k, DIM, FILTERS, scale=0.2) for k in WIDTHS}
        for w in self.kernel.values():
            w[0, 0, 0] = 1.0
        self.bias = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        self.out = normal(len(WIDTHS) * FILTERS, scale=0.1)
        self.out[::FILTERS] = 0.5
        self.shift = np.zeros(1, np.float32)
        self.platt = (1.0, 0.0)

    def tables(self) -> list[np.ndarray]:
        """For each hash the products of its vectors with all filter positions, one column block each."""
        flat = np.concatenate([self.kernel[k][j] for k in WIDTHS for j in range(k)], axis=1)
        return [e @ flat for e in self.embed]

    def logits(self, code: np.ndarray, at: np.ndarray, first: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        value, column, out = sum(t[c] for t, c in zip(tables, code, strict=True)), 0, self.shift[0]
        for i, k in enumerate(WIDTHS):
            conv = value[at, column : column + FILTERS]
            for j in range(1, k):
                conv = conv + value[at + j, column + j * FILTERS : column + (j + 1) * FILTERS]
            column += k * FILTERS
            pooled = np.maximum(np.maximum.reduceat(conv, first, axis=0) + self.bias[k], 0)
            # Added up filter by filter: a text's score must not hang on the batch it came in.
            for f in range(FILTERS):
                out = out + pooled[:, f] * self.out[i * FILTERS + f]
        return out

    def scores(self, logits: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * logits.astype(np.float64) + b, -30, 30)))


def _log_odds(code, texts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """By hash: smoothed log-odds of each bucket, small for rare ones."""
    out = []
    for h in range(len(PREFIXES)):
        seen = np.unique(texts.astype(np.int64) * (BUCKETS + 1) + code[h])
        bucket, doc = seen % (BUCKETS + 1), seen // (BUCKETS + 1)
        pos = np.bincount(bucket[y[doc] == 1], minlength=BUCKETS + 1)
        neg = np.bincount(bucket[y[doc] == 0], minlength=BUCKETS + 1)
        n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
        odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
        odds *= (pos + neg) / (pos + neg + 4.0)
        odds[BUCKETS] = 0
        out.append((odds / len(PREFIXES)).astype(np.float32))
    return out


def train(texts: list[str], y: np.ndarray, seed: int = 5) -> Network:
    rng, net = np.random.default_rng(seed), Network(seed)
    code, at, first = tokens_of(texts)
    ends = np.append(first[1:], len(at))
    row = np.repeat(np.arange(len(texts)), ends - first)
    for e, odds in zip(net.embed, _log_odds(code[:, at], row, y), strict=True):
        e[:, 0] = odds
    net.shift[0] = -2.0
    memory = {"embed": [np.full(BUCKETS + 1, 1e-2, np.float32) for _ in PREFIXES]}
    steps: dict[str, list[np.ndarray]] = {}

    def adam(name: str, value: np.ndarray, grad: np.ndarray, t: int) -> None:
        m, v = steps.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        value -= (RATE / 4) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)

    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            batch, t = order[lo : lo + BATCH], t + 1
            used = ends[batch] - first[batch]
            where = at[ragged(first[batch], used)]
            begin = np.cumsum(used) - used
            doc = np.repeat(np.arange(len(batch)), used)
            vectors = [sum(e[c[where + j]] for e, c in zip(net.embed, code, strict=True)) for j in range(PADS)]
            z, saved = np.full(len(batch), net.shift[0], np.float32), []
            for i, k in enumerate(WIDTHS):
                conv = sum(vectors[j] @ net.kernel[k][j] for j in range(k))
                top = np.maximum.reduceat(conv, begin, axis=0)
                pick = np.zeros((len(batch), FILTERS), np.int64)
                r, c = np.nonzero(conv == top[doc])
                pick[doc[r[::-1]], c[::-1]] = r[::-1]
                pooled = np.maximum(top + net.bias[k], 0)
                z += pooled @ net.out[i * FILTERS : (i + 1) * FILTERS]
                saved.append((k, pick, pooled))
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[batch]).astype(np.float32) / len(batch)
            adam("shift", net.shift, np.array([error.sum()], np.float32), t)
            grad_out = np.concatenate([p.T @ error for _, _, p in saved])
            touched: list[tuple[np.ndarray, np.ndarray]] = []
            for i, (k, pick, pooled) in enumerate(saved):
                g = error[:, None] * net.out[None, i * FILTERS : (i + 1) * FILTERS] * (pooled > 0)
                grad = np.empty_like(net.kernel[k])
                for j in range(k):
                    x = vectors[j][pick]
                    grad[j] = np.einsum("bfd,bf->df", x, g)
                    touched.append((where[pick] + j, g[:, :, None] * net.kernel[k][j].T[None]))
                adam(f"kernel{k}", net.kernel[k], grad + DECAY * net.kernel[k], t)
                adam(f"bias{k}", net.bias[k], g.sum(0), t)
            adam("out", net.out, grad_out + DECAY * net.out, t)
            place = np.concatenate([p.ravel() for p, _ in touched])
            g = np.concatenate([x.reshape(-1, DIM) for _, x in touched])
            for h in range(len(PREFIXES)):
                bucket, inverse = np.unique(code[h, place], return_inverse=True)
                total = np.zeros((len(bucket), DIM), np.float32)
                np.add.at(total, inverse, g)
                memory["embed"][h][bucket] += (total * total).mean(1)
                net.embed[h][bucket] -= RATE * total / np.sqrt(memory["embed"][h][bucket])[:, None]
                net.embed[h][BUCKETS] = 0
    return net


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method; targets are smoothed for small samples."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([z, np.ones(len(z))], axis=1), np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * (theta - [1, 0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - step / max(1.0, np.abs(step).max())
    return max(float(theta[0]), 1e-3), float(theta[1])


def _threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The score with the best F1, half-way to the next lower one."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    f1[np.append(s[1:] == s[:-1], False)] = 0
    k = int(np.argmax(f1))
    return float(np.clip((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2, 0.1, 0.9))


class Classifier:
    """Scores by the network, or a constant; thresholds by language."""

    def __init__(self, net: Network | None, constant: float, thresholds: dict[str, float], default: float):
        self.net, self.constant, self.thresholds, self.default = net, constant, thresholds, default
        self._tables: list[np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(offsets) - 1, self.constant)
        if self._tables is None:
            self._tables = self.net.tables()
        return self.net.scores(self.net.logits(*tokens(data, offsets), self._tables))


def fit(rows: list[tuple[str, str | None, int]], counts: tuple[int, int]) -> Classifier:
    y = np.array([r[2] for r in rows], np.int64)
    if len(set(y.tolist())) < 2 or np.bincount(y).min() < 4:
        rate = (counts[1] + 1) / (sum(counts) + 2) if sum(counts) else 0.0
        return Classifier(None, rate, {}, CUT)
    kept = np.zeros(len(y), bool)
    for c in (0, 1):  # every fourth of each class calibrates
        kept[np.flatnonzero(y == c)[::4]] = True
    net = train([r[0] for r, k in zip(rows, kept, strict=True) if not k], y[~kept])
    tables = net.tables()
    z = np.concatenate([net.logits(*tokens(data, offsets), tables) for _, data, offsets in runs(_batch([r[0] for r, k in zip(rows, kept, strict=True) if k]), limit=RUN)])
    del tables
    lang = np.array([r[1] or "" for r in rows])[kept]
    y = y[kept]
    share = np.array([counts[c] / max(1, (y == c).sum()) for c in (0, 1)])
    net.platt = _platt(z.astype(np.float64), y, share[y] / share[y].mean())
    s = net.scores(z)
    own = {str(x): _threshold(s[lang == x], y[lang == x]) for x in sorted(set(lang)) if x and min((y[lang == x] == c).sum() for c in (0, 1)) >= SUPPORT}
    return Classifier(net, 0.0, own, _threshold(s, y))


def fit_on(docs: DataFrame, labels: DataFrame) -> Classifier:
    return learned(fit, docs, labels, "toxic", FOLDS, HELD_OUT, SAMPLE)


def score_texts(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with score, threshold and toxic (score at or over its language's threshold)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            batch = pa.record_batch([pa.array(s, pa.large_string(), from_pandas=True)], names=["text"])
            out = [sent.value.score(data, offsets) for _, data, offsets in runs(batch, limit=RUN)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    threshold = F.lit(model.default)
    if "lang" in docs.columns:
        for lang, t in model.thresholds.items():
            threshold = F.when(F.col("lang") == lang, t).otherwise(threshold)
    kept = docs.drop("score", "threshold", "toxic")
    return kept.withColumn("score", score(F.col("text").cast("string"))).withColumn("threshold", threshold).withColumn("toxic", F.col("score") >= F.col("threshold"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score_texts(docs.select("doc_id", "text", "lang"), fit_on(docs, labels))
    held = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"), "threshold", "toxic")

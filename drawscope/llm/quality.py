"""Quality scores by positive-unlabelled learning.

Only texts known to be good and unlabelled web text are used for training. A linear scorer
over dense text statistics minimises the non-negative unbiased risk: with class prior ``pi``,
logistic loss ``l``, positives P and unlabelled U::

    pi * mean_P l(+)  +  max(0, mean_U l(-) - pi * mean_P l(-))

When the second term falls below zero, the step goes the other way on it, so the risk of the
negatives can't be driven below zero by overfitting. The prior is estimated from P and U alone:
a first scorer tells P from U, and ``pi`` is the least ratio, over thresholds that keep enough
of P, of the shares of U and of P above the threshold (if what is left of U holds nothing but
positives, that ratio is ``pi``).

Statistics of a text are computed over the whole of it, from its bytes and words: shares of
byte classes, lengths, repetition, and the square root of the share of its words and word pairs that fall in each of
``BINS`` hashed bins. The training sample is bounded: ``max_positive`` and ``max_unlabelled`` ids of smallest hash,
one text each.

Defined cases: null and empty texts have all statistics zero, and a score; repeated rows are
scored each for themselves (for training, of the texts of one id that of least statistics counts); with no positives or no unlabelled rows every score is the prior
(1 without any); an empty table gives an empty result; further columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes

MAX_POSITIVE = 4000
MAX_UNLABELLED = 8000
BINS = 128
#: Weight of a hashed bin beside a statistic, before training.
BIN_SCALE = 0.25


def _class(*bytes_: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(b"".join(bytes_), np.uint8))


#: Bytes by class; every byte is in one class, and a text's shares of all but "lower" are features.
CLASSES = {
    "lower": _class(bytes(range(97, 123))),
    "upper": _class(bytes(range(65, 91))),
    "digit": _class(bytes(range(48, 58))),
    "shout": _class(b"!?"),
    "stop": _class(b".,;:"),
    "bar": _class(b"|<>{}[]\\/_="),
    "sign": _class(b"#$%&*@^~+`"),
    "quote": _class(b"'\"()-"),
    "space": _class(bytes(range(0, 10)) + bytes(range(11, 33)) + b"\x7f"),
    "line": _class(b"\n"),
    "wide": np.arange(256) >= 128,
}
KIND = np.argmax(list(CLASSES.values()), axis=0)
STATISTICS = (*list(CLASSES)[1:], "log words", "word length", "distinct", "repeated", "repeated pair", "upper of letters")
FEATURES = (*STATISTICS, *(f"bin {b}" for b in range(BINS)))


def statistics(column: pa.Array) -> np.ndarray:
    """[text, feature], for whole texts."""
    out = np.zeros((len(column), len(FEATURES)))
    for lo, hi, data, offsets in textbytes.chunks(column):
        part = out[lo:hi]
        size = np.maximum(np.diff(offsets), 1)
        k = len(CLASSES)
        kinds = np.bincount(KIND[data] + np.repeat(np.arange(hi - lo) * k, np.diff(offsets)), minlength=(hi - lo) * k).reshape(-1, k)
        at = k - 1
        part[:, :at] = kinds[:, 1:] / size[:, None]
        w = textbytes.words(data, offsets)
        text_of = w.text_of
        n = np.diff(w.first)
        some = np.maximum(n, 1)
        part[:, at] = np.log1p(n)
        part[:, at + 1] = np.bincount(text_of, weights=w.end - w.start, minlength=hi - lo) / some
        order = np.lexsort((w.hash, text_of))
        h, t = w.hash[order], text_of[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        part[:, at + 2] = np.bincount(t[new], minlength=hi - lo) / some
        for j, gap in ((at + 3, 1), (at + 4, 2)):
            same = np.zeros(len(w.hash), bool)
            same[gap:] = (w.hash[gap:] == w.hash[:-gap]) & (text_of[gap:] == text_of[:-gap])
            part[:, j] = np.bincount(text_of[same], minlength=hi - lo) / some
        pairs = textbytes.grams(w.hash, 2)
        inside = text_of[:-1] == text_of[1:]
        hashed, of = np.concatenate([w.hash, pairs[inside]]), np.concatenate([text_of, text_of[1:][inside]])
        binned = np.bincount((hashed >> np.uint64(32)).astype(np.int64) % BINS + of * BINS, minlength=(hi - lo) * BINS).reshape(-1, BINS)
        part[:, len(STATISTICS) :] = np.sqrt(binned / np.maximum(binned.sum(axis=1, keepdims=True), 1))
        part[:, at + 5] = kinds[:, 1] / np.maximum(kinds[:, [0, 1, at]].sum(axis=1), 1)
    return out


@dataclass(frozen=True)
class Scorer:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        own, bins = z[:, : len(STATISTICS)], z[:, len(STATISTICS) :]
        return np.concatenate([own, bins * BIN_SCALE, own**2 / 8, np.ones((len(z), 1))], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -500, 500)))


def _minimise(p: np.ndarray, u: np.ndarray, prior: float, non_negative: bool, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Full-batch Adam on the risk; sigma(z) - 1 and sigma(z) are the slopes of l(+) and l(-)."""
    w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        good = prior * (p.T @ (sp - 1)) / len(p)
        rest = (u.T @ su) / len(u)
        if non_negative:
            rest = rest - prior * (p.T @ sp) / len(p)
            risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            grad = good + rest if risk >= 0 else -rest
        else:
            grad = good + (1 - prior) * rest
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of shares above a threshold, over thresholds that keep 30 % of P or more."""
    at = np.quantile(positive, np.linspace(0, 0.7, 71))
    ratio = [(unlabelled >= t).mean() / (positive >= t).mean() for t in at]
    return float(np.clip(min(ratio), 0.01, 0.99))


def train(positive: np.ndarray, unlabelled: np.ndarray) -> Scorer:
    d = len(FEATURES)
    if not len(positive) or not len(unlabelled):
        return Scorer(np.zeros(d), np.ones(d), np.append(np.zeros(d + len(STATISTICS)), 30.0), 1.0)
    both = np.concatenate([positive, unlabelled])
    blank = Scorer(both.mean(axis=0), np.maximum(both.std(axis=0), 1e-6), np.zeros(0), 0.5)
    p, u = blank._design(positive), blank._design(unlabelled)
    first = _minimise(p[::2], u[::2], 0.5, False)
    prior = estimated_prior(p[1::2] @ first if len(p) > 1 else p @ first, u[1::2] @ first if len(u) > 1 else u @ first)
    return Scorer(blank.mean, blank.scale, _minimise(p, u, prior, True), prior)


def _features(df: DataFrame, text: str):
    @F.arrow_udf("array<double>")
    def measured(column: pa.Array) -> pa.Array:
        x = statistics(column)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))

    return measured(F.col(text).cast("string"))


def _sample(ids: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` ids of smallest hash."""
    n = ids.count()
    h = F.xxhash64(F.col(key).cast("string"))
    few = ids if n <= most else ids.where(h.cast("double") / float(2**64) + 0.5 <= min(1.0, (1.2 * most + 50) / n))
    return few.select(key).orderBy(h, key).limit(most)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Scorer:
    """``labels``: the rows that may be learnt from. Positives are those with label 1; documents
    that have no row there are unlabelled."""
    known = labels.select(F.col(key), F.col(label).alias("__label")).where(F.col(key).isNotNull())
    good = _sample(known.where("__label = 1").select(key).distinct(), key, max_positive)
    plain = docs.select(F.col(key), F.col(text).alias("text"))
    web = _sample(plain.select(key).where(F.col(key).isNotNull()).join(known.select(key), key, "left_anti"), key, max_unlabelled)
    drawn = good.withColumn("__p", F.lit(True)).unionByName(web.withColumn("__p", F.lit(False)))
    measured = plain.join(F.broadcast(drawn), key).select(key, "__p", _features(plain, "text").alias("x"))
    # A sampled id may be that of very many rows: one of them is taken, by partial aggregation.
    rows = measured.groupBy(key, "__p").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: (r[key], r["x"]))
    x = {flag: np.array([r["x"] for r in rows if r["__p"] is flag]).reshape(-1, len(FEATURES)) for flag in (True, False)}
    return train(x[True], x[False])


def score_column(df: DataFrame, scorer: Scorer, text: str = "text"):
    sent = df.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(sent.value.scores(statistics(column)))

    return scored(F.col(text).cast("string"))

"""URL filtering: host and path rules, and a logistic regression for what no rule covers.

A rule is a host with a path (``example.com/en/``). It fits its host and all subdomains, for
urls whose path starts with the rule's; of several, the longest decides. Other urls are judged
by logistic regression on hashed character n-grams of host and path (host and path n-grams
differ), trained on a small table of labelled urls, at most ``max_rows`` of them.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from
there up to ``?``, ``#`` or the end. A null url, or one without ``://``, has neither.

Defined cases: null and odd urls are judged like any other, by the regression's intercept; a
training table without both labels allows everything; repeated rows are judged each for
themselves; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes

BINS = 1 << 16
ORDERS = (3, 4, 5)
MAX_ROWS = 4000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """The pages with the columns host and path."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(F.col(url).cast("string"), pattern, i), F.lit(""))
    return pages.withColumns({"host": F.translate(part(1), _UPPER, _LOWER), "path": part(2)})


@dataclass(frozen=True)
class Rules:
    """(rule, verdict) pairs, by host, the longest rule first."""

    by_host: dict[str, list[tuple[str, str, str]]]

    @staticmethod
    def of(pairs: list[tuple[str, str]]) -> Rules:
        by: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in sorted(pairs, key=lambda p: (-len(p[0]), p[0])):
            host, slash, path = rule.partition("/")
            by.setdefault(host, []).append((slash + path, rule, verdict))
        return Rules(by)

    def judge(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        labels = host.split(".") if host else []
        for i in range(len(labels)):
            for start, rule, verdict in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
        return best


def _hashed(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of every n-gram of ``^host/`` and of ``|path$``."""
    rows, bins = [], []
    for mark, texts in ((b"^", hosts), (b"|", paths)):
        raw = [mark + t.encode() + b"$" for t in texts]
        size = np.array([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1 + 256 * mark[0])
        row, end = np.repeat(np.arange(len(raw)), size), np.repeat(np.cumsum(size), size)
        for n in ORDERS:
            g = textbytes.grams(data, n)
            ok = np.arange(len(g)) + n <= end[: len(g)]
            rows.append(row[: len(g)][ok])
            bins.append((g[ok] & np.uint64(BINS - 1)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(bins)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float

    def block_probability(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        row, at = _hashed(hosts, paths)
        n = np.maximum(np.bincount(row, minlength=len(hosts)), 1)
        z = np.bincount(row, weights=self.weights[at], minlength=len(hosts)) / np.sqrt(n) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(hosts: list[str], paths: list[str], block: list[int], steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Full-batch AdaGrad on the L2-regularised logistic loss."""
    y = np.array(block, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BINS), -1.0)
    row, at = _hashed(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(y)), 1))
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    w, b, gw, gb = np.zeros(BINS), 0.0, np.full(BINS, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(row, weights=w[at], minlength=len(y)) * scale + b
        error = (1 / (1 + np.exp(-z)) - y) * balance
        grad = np.bincount(at, weights=(error * scale)[row], minlength=BINS) + decay * w
        gw += grad**2
        gb += error.sum() ** 2
        w -= rate * grad / np.sqrt(gw)
        b -= rate * error.sum() / np.sqrt(gb)
    return Model(w, float(b))


def fit(labelled: DataFrame, url: str = "url", label: str = "block", max_rows: int = MAX_ROWS) -> Model:
    """Train on the ``max_rows`` labelled urls of smallest hash (label: 1 block, 0 allow).

    Hashes below a threshold are taken first, so only about twice as many rows as wanted are
    made distinct and sorted. Rows are counted, copies of a hot url too, so where the threshold
    leaves too few urls all of them are taken.
    """
    rows = with_parts(labelled.select(F.col(url).alias("url"), F.col(label).cast("int").alias("y")).where("url is not null and y is not null")).select("host", "path", "y")
    h = F.xxhash64("host", "path")
    unit = h.cast("double") / F.lit(float(2**64)) + F.lit(0.5)

    def least(part: DataFrame) -> list:
        return part.distinct().orderBy(h, "host", "path", "y").limit(max_rows).collect()

    share = (2.0 * max_rows + 100) / max(1, rows.count())
    taken = least(rows.where(unit <= share))
    if len(taken) < max_rows and share < 1:
        taken = least(rows)
    return train([r.host for r in taken], [r.path for r in taken], [r.y for r in taken])


def judged(pages: DataFrame, rules: list[tuple[str, str]], model: Model, url: str = "url") -> DataFrame:
    """The pages with host, path, rule, verdict and block_score (null where a rule decides)."""
    sent = pages.sparkSession.sparkContext.broadcast((Rules.of(rules), model))

    @F.arrow_udf("struct<rule:string,verdict:string,block_score:double>")
    def judge(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        known, scorer = sent.value
        h, p = hosts.to_pylist(), paths.to_pylist()
        found = [known.judge(a, b) for a, b in zip(h, p, strict=True)]
        open_rows = [i for i, f in enumerate(found) if f[0] is None]
        scores: list[float | None] = [None] * len(h)
        if open_rows:
            for i, s in zip(open_rows, scorer.block_probability([h[i] for i in open_rows], [p[i] for i in open_rows]).tolist(), strict=True):
                scores[i] = s
        verdicts = [f[1] or ("block" if s >= 0.5 else "allow") for f, s in zip(found, scores, strict=True)]
        return pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], ["rule", "verdict", "block_score"])

    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    parts = with_parts(pages.select(*kept), url)
    return parts.withColumn("__judged", judge("host", "path")).select(*kept, "host", "path", "__judged.*")


def by_rules(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url") -> DataFrame:
    """(url, block): the urls that a rule decides, as a table of labels."""
    done = judged(pages.select(url), rules, Model(np.zeros(BINS), -1.0), url)
    return done.where("rule is not null").select(F.col(url).alias("url"), (F.col("verdict") == "block").cast("int").alias("block"))

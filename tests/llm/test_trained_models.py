"""The trained models against plain statements of what they minimise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from drawscope.llm import quality, urlfilter


def plain_risk(w, p, u, prior):
    """The non-negative risk, a row at a time."""
    good = [float(np.log1p(np.exp(-x @ w))) for x in p]
    as_bad_p = [float(np.log1p(np.exp(x @ w))) for x in p]
    as_bad_u = [float(np.log1p(np.exp(x @ w))) for x in u]
    return prior * np.mean(good) + max(0.0, np.mean(as_bad_u) - prior * np.mean(as_bad_p))


def two_kinds(seed=0, n=400, share=0.6):
    rng = np.random.default_rng(seed)
    one = lambda m: np.c_[rng.normal(1.5, 1, m), rng.normal(0, 1, m), np.ones(m)]
    other = lambda m: np.c_[rng.normal(-1.5, 1, m), rng.normal(0, 1, m), np.ones(m)]
    return one(n), np.concatenate([one(int(share * 2 * n)), other(2 * n - int(share * 2 * n))])


def test_the_risk_is_minimised():
    p, u = two_kinds()
    w = quality._minimise(p, u, 0.6, True, decay=0.0)
    least = plain_risk(w, p, u, 0.6)
    assert least < plain_risk(np.zeros(3), p, u, 0.6) - 0.1
    rng = np.random.default_rng(1)
    assert all(plain_risk(w + rng.normal(0, s, 3), p, u, 0.6) >= least - 2e-3 for s in (0.05, 0.3, 1.0) for _ in range(20))


def test_the_prior_is_that_of_the_mixture():
    p, u = two_kinds(2, 4000)
    assert quality.estimated_prior(p[:, 0], u[:, 0]) == pytest.approx(0.6, abs=0.06)


def test_one_row_of_a_hot_id_is_taken(spark):
    rows = [(7, "good text number seven.")] * 300 + [(i, f"good text number {i}.") for i in range(30)] + [(i, "BUY!!! " * (i % 9)) for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"x": F.lit("clash"), "__p": F.lit("clash")})
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    once = spark.createDataFrame(list(dict.fromkeys(rows)), "doc_id long, text string")
    a, b = quality.fit(docs, labels), quality.fit(once.where("doc_id != 7 or text like '%seven.'"), labels)
    assert a.prior == pytest.approx(b.prior, abs=0.2)
    s = docs.select("doc_id", quality.score_column(docs, a).alias("s")).collect()
    assert min(r.s for r in s if r.doc_id < 100) > max(r.s for r in s if r.doc_id >= 100 and r.doc_id % 9)


def test_the_url_loss_is_minimised():
    rng = np.random.default_rng(3)
    hosts = [f"{'casino' if i % 3 == 0 else 'school'}{rng.integers(99)}.org" for i in range(60)]
    paths, y = [f"/{rng.integers(999)}" for _ in hosts], [int(i % 3 == 0) for i in range(60)]
    model = urlfilter.train(hosts, paths, y)

    def loss(weights, intercept):
        total = 0.0
        for h, p, label in zip(hosts, paths, y, strict=True):
            _, at = urlfilter._hashed([h], [p])
            z = sum(weights[b] for b in at.tolist()) / np.sqrt(len(at)) + intercept
            side = 0.5 / np.mean(y) if label else 0.5 / (1 - np.mean(y))
            total += side / len(y) * np.log1p(np.exp(-z if label else z))
        return total + 0.5e-4 * float(weights @ weights)

    least = loss(model.weights, model.intercept)
    assert least < 0.1 and least < loss(model.weights * 0.9, model.intercept) and least < loss(np.zeros(urlfilter.BINS), 0.0)
    for h, p, label in zip(hosts, paths, y, strict=True):
        assert (model.block_probability([h], [p])[0] > 0.5) == bool(label)

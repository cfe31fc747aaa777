"""The fitted logistic scorer against the same steps in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from toxscan.operators.logistic import BIAS, PENALTY, RATE, fit_logistic, score_logistic
from toxscan.operators.tokens import with_tokens
from toxscan.plans import artifacts
from toxscan.plans.dataset import with_text

SF001 = "/root/testdata/sf0.001"


def plain_fit(rows, steps):
    """``rows``: tokens, class, copies."""
    names = sorted({t for d, _, _ in rows for t in d})
    place = {t: i + 1 for i, t in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    for k, (d, _, _) in enumerate(rows):
        for t in d:
            x[k, place[t]] = 1
        x[k] /= max(np.sqrt((x[k] ** 2).sum()), 1e-300)
        x[k, 0] = 1
    y, c = (np.array([r[j] for r in rows], dtype=float) for j in (1, 2))
    w = np.zeros(len(names) + 1)
    for _ in range(steps):
        e = c * (1 / (1 + np.exp(-x @ w)) - y) / c.sum()
        w = w - RATE * (x.T @ e + PENALTY * np.r_[0, w[1:]])
    return dict(zip([BIAS, *names], w)), x @ w


@pytest.mark.parametrize("bound", [None, 2000])
def test_fit_equals_numpy(spark, bound):
    texts = {i: " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(i % 9)) + (" bad" if i % 3 == 0 else " * good") for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()) + [(99, "not in training")], "doc_id long, text string")
    train = spark.createDataFrame([(i, int(i % 3 == 0), c) for i in texts for c in range(2 if i % 3 == 0 else 1)], "doc_id long, bucket int, copy int")
    if bound is not None:
        spark.conf.set("spark.toxscan.broadcastMaxBytes", str(bound))
    try:
        weights = fit_logistic(train, docs, steps=3)
        got = {r.token: r.weight for r in weights.collect()}
        rows = [([t for t in texts[i].split() if t != "*"], int(i % 3 == 0), 2 if i % 3 == 0 else 1) for i in sorted(texts)]
        want, z = plain_fit(rows, 3)
        assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t], abs=1e-9) for t in want)
        scored = {r.doc_id: r for r in score_logistic(with_tokens(docs), weights).collect()}
        assert len(scored) == 61 and all(scored[i].score == pytest.approx(z[k], abs=1e-9) for k, i in enumerate(sorted(texts)))
        assert all(r.pred == (r.score > 0) for r in scored.values())
    finally:
        spark.conf.unset("spark.toxscan.broadcastMaxBytes")


def test_steps_shuffle_sums_only(spark):
    from toxscan.operators.logistic import _scored, unit_features
    from toxscan.operators.tokens import with_row_key
    from toxscan.session import bucket_by_doc

    rows = with_row_key(artifacts.doc_tokens(spark, SF001).select("tokens"))
    features = bucket_by_doc(unit_features(rows, []), "logistic-plan", key="_row")
    weights = spark.createDataFrame([(BIAS, 0.1, None), ("the", 0.5, 9)], "token string, weight double, frequency long")
    plan = _scored(features, weights, [])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_both_classes_are_needed(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        fit_logistic(spark.createDataFrame([(1, 0)], "doc_id long, bucket int"), docs)


def test_it_separates_the_training_rows(spark):
    sf = "/root/testdata/sf0.01"
    ds = artifacts.dataset(spark, sf)
    train = with_tokens(with_text(ds.train.filter("copy = 0"), spark, sf))
    got = score_logistic(train, artifacts.logistic(spark, sf), keep=["bucket"])
    right = {r.bucket: r.share for r in got.groupBy("bucket").agg(F.avg((F.col("pred") == F.col("bucket")).cast("int")).alias("share")).collect()}
    assert right[1] > 0.8 and right[0] > 0.8

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from toxscan.operators.purify import attribute, purify
from toxscan.operators.scorer import AdditiveScorer, fit_scorer

SF001 = "/root/testdata/sf0.001"

# FIXTURES.md, purify cases: (text, {token: weight}, bias, expected text, expected masked count)
CASES = [
    ("you idiot ok", {"you": 0, "idiot": 3, "ok": -1}, 0, "you ***** ok", 1),
    ("bad bad fine", {"bad": 2, "fine": -1}, 0, "*** *** fine", 2),
    ("good", {"good": -2}, 0, "good", 0),
    ("a b", {"a": 1, "b": -5}, 4, "a b", 0),
    ("a b", {"a": 1, "b": -5}, 5, "* b", 1),
    ("a b c", {"a": 2, "b": -1, "c": -9}, 9, "* b c", 1),
    ("a b c", {"a": 2, "b": -3, "c": -9}, 11, "* b c", 1),
    ("x y", {"x": 1, "y": 1}, 5, "* *", 2),
    ("", {}, 1, "", 0),
]


def scorer_for(spark, weights, bias):
    rows = [(t, Decimal(w).quantize(Decimal("0.000001"))) for t, w in weights.items()]
    df = spark.createDataFrame(rows or [("__none__", Decimal(0))], "token string, weight decimal(18,6)")
    return AdditiveScorer(df, Decimal(bias))


@pytest.mark.parametrize("text,weights,bias,expected,n_masked", CASES)
def test_purify_fixtures(spark, text, weights, bias, expected, n_masked):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = purify(df, scorer_for(spark, weights, bias)).collect()[0]
    assert r.text == expected
    assert r.n_masked == n_masked
    s0 = bias + sum(weights.get(t, 0) for t in text.split())
    assert r.pred == int(s0 > 0)


def literal_loop(tokens, weights, bias):
    """The reference loop: while toxic, mask the best unmasked token (weight desc, position asc)."""
    w = [Decimal(str(weights.get(t, 0))) if t != "*" else Decimal(0) for t in tokens]
    masked = [False] * len(tokens)
    s = bias + sum(w)
    while s > 0:
        cands = [i for i, t in enumerate(tokens) if not masked[i] and t != "*"]
        if not cands:
            break
        best = min(cands, key=lambda i: (-w[i], i))
        masked[best] = True
        s -= w[best]
    return masked


@pytest.mark.parametrize("bias", [0, 20, 80])
def test_closed_form_equals_literal_loop(spark, bias):
    from toxscan.plans.dataset import labelled_dataset, with_text
    from toxscan.operators.tokens import with_tokens

    ds = labelled_dataset(spark, SF001)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    sc = fit_scorer(ds.train, docs)
    weights = {r.token: r.weight for r in sc.weights.collect()}
    sc = AdditiveScorer(sc.weights, Decimal(bias))
    test = with_text(ds.test, spark, SF001)
    out = {r.doc_id: r for r in purify(test, sc).collect()}
    toks = {r.doc_id: r.tokens for r in with_tokens(test).select("doc_id", "tokens").collect()}
    total_masked = 0
    for doc_id, tokens in toks.items():
        m = literal_loop(tokens, weights, Decimal(bias))
        assert out[doc_id].n_masked == sum(m)
        if any(m):
            stars = ["*" * len(t.replace("#", "").replace(" ", "")) if mk else t for t, mk in zip(tokens, m)]
            assert out[doc_id].text == " ".join(stars)
        total_masked += sum(m)
    if bias >= 20:
        assert total_masked > 0  # the comparison must be able to fail
    for r in out.values():  # masked documents end non-toxic or fully masked
        assert r.final_score <= 0 or r.n_masked == len([t for t in toks[r.doc_id] if t != "*"])


@pytest.mark.parametrize("text,weights,bias,expected,n_masked", CASES)
def test_literal_loop_fixtures(spark, text, weights, bias, expected, n_masked):
    from toxscan.operators.purify import purify_with_model
    from toxscan.operators.scorer import AdditiveWeightsLoader

    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = purify_with_model(df, AdditiveWeightsLoader(weights, bias)).collect()[0]
    assert r.text == expected
    assert r.n_masked == n_masked


def test_purify_on_bucketed_documents_has_no_exchange(spark):
    from toxscan.session import bucket_by_doc

    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    sc = scorer_for(spark, {"idiot": 3, "trash": 2, "the": -0.1}, 0)
    bucketed = bucket_by_doc(docs, "docs-bucketed", buckets=4)
    out = purify(bucketed, sc, partitioned=True)
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        out.explain()
    assert "Exchange" not in buf.getvalue().replace("BroadcastExchange", "")
    a = {tuple(r) for r in out.collect()}
    b = {tuple(r) for r in purify(docs, sc).collect()}
    assert a == b and sum(r[5] for r in a) > 0  # equal results, some tokens masked


@pytest.mark.parametrize("labels", [(1, 0), (1, 1)])
def test_rows_that_share_an_id_stay_apart(spark, labels):
    from decimal import Decimal

    from toxscan.operators.scorer import AdditiveScorer, score
    from toxscan.operators.tokens import with_tokens
    from toxscan.session import scratch_path
    from toxscan.streaming.moderate import MODERATED_SCHEMA, moderate_stream

    weights = spark.createDataFrame([("idiot", Decimal("3")), ("nice", Decimal("-9"))], "token string, weight decimal(18,6)")
    scorer = AdditiveScorer(weights, Decimal("0"))
    df = spark.createDataFrame([(0, "you idiot", labels[0]), (0, "nice day", labels[1]), (None, "idiot", 1), (0, "you idiot", labels[0])],
                               "doc_id long, text string, label int")
    want = sorted([("you *****", 1, 1), ("nice day", 0, 0), ("*****", 1, 1), ("you *****", 1, 1)])
    assert sorted((r.text, r.pred, r.n_masked) for r in purify(df, scorer, keep=["label"]).collect()) == want
    assert sorted(r.score for r in score(with_tokens(df), scorer).collect()) == [-9.0, 3.0, 3.0, 3.0]
    got = attribute(df, scorer)
    assert got.count() == 7 and sorted(round(r.prob, 3) for r in got.filter("token = 'nice'").collect()) == [0.0]
    staged, sink = scratch_path(spark, "ids-in"), scratch_path(spark, "ids-out")
    df.select("doc_id", "label", "text").coalesce(1).write.parquet(staged)
    source = spark.readStream.schema("doc_id long, label int, text string").parquet(staged)
    moderate_stream(source, scorer, sink, scratch_path(spark, "ids-ckpt")).awaitTermination()
    out = spark.read.schema(MODERATED_SCHEMA).parquet(sink)
    assert sorted((r.text, r.pred, r.n_masked) for r in out.collect()) == want


def test_purify_shuffles_no_tokens(spark):
    from decimal import Decimal

    from toxscan.operators.scorer import AdditiveScorer

    weights = spark.createDataFrame([("a", Decimal("1"))], "token string, weight decimal(18,6)")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    plan = purify(docs, AdditiveScorer(weights, Decimal("0")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("Generate ") < plan.index("Exchange hashpartitioning")
    assert "Window" not in plan


class CountingModel:
    """The additive model, telling how often it is called and on what."""

    scale = 1

    def __init__(self, weights, bias):
        self.weights, self.bias, self.calls = weights, bias, []

    def __call__(self, tokens, offsets):
        import numpy as np

        self.calls.append(len(offsets) - 1)
        w = np.array([self.weights.get(t, 0) for t in tokens], dtype=np.int64)
        return np.array([self.bias + w[a:b].sum() for a, b in zip(offsets[:-1], offsets[1:])]), w


def test_one_model_call_a_round():
    import numpy as np

    from toxscan.operators.purify import mask_batch

    weights, bias = {"a": 5, "b": 3, "c": -4, "x#y": 2}, -2
    docs = [["a", "b", "c"], [], ["c", "c"], ["b", "a", "a", "*", "x#y"], ["*", "**"], ["b"] * 6, ["x#y", "a"]]
    model = CountingModel(weights, bias)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    tokens = np.array([t for d in docs for t in d], dtype=object)
    first, last, masked = mask_batch(tokens, offsets, model)
    rounds, want = [], []
    for d in docs:
        toks, n = list(d), 0
        while bias + sum(weights.get(t, 0) for t in toks) > 0 and any(t.strip("*") for t in toks):
            best = max((i for i, t in enumerate(toks) if t.strip("*")), key=lambda i: (weights.get(toks[i], 0), -i))
            toks[best] = "*" * len(toks[best].replace("#", ""))
            n += 1
        rounds.append(n)
        want += toks
    assert tokens.tolist() == want and masked.tolist() == rounds and max(rounds) > 3
    assert model.calls == [len(docs), *[sum(r >= k for r in rounds) for k in range(1, max(rounds) + 1)]]
    assert first.tolist() == [bias + sum(weights.get(t, 0) for t in d) for d in docs]
    assert last.tolist() == [bias + sum(weights.get(t, 0) for t in want[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    none = mask_batch(np.zeros(0, object), np.zeros(1, np.int64), model)
    assert [len(x) for x in none] == [0, 0, 0]


def test_direct_stream_restarts_between_batches(spark, tmp_path):
    import time

    from toxscan.operators.purify import purify_with_model
    from toxscan.operators.scorer import AdditiveWeightsLoader
    from toxscan.streaming.moderate import MODERATED_SCHEMA, moderate_stream_direct

    loader = AdditiveWeightsLoader({"idiot": 3, "nice": -1}, 0)
    rows = spark.createDataFrame([(i, i % 2, f"you idiot {i}" if i % 3 else "nice day") for i in range(40)], "doc_id long, label int, text string")
    rows.repartition(8).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink, ckpt = str(tmp_path / "out"), str(tmp_path / "ckpt")
    q = moderate_stream_direct(source, loader, sink, ckpt, available_now=False)
    for _ in range(600):
        if q.lastProgress is not None and q.lastProgress["batchId"] >= 1:
            break
        time.sleep(0.05)
    q.stop()
    part = spark.read.schema(MODERATED_SCHEMA).parquet(sink).count()
    assert 0 < part
    moderate_stream_direct(source, loader, sink, ckpt).awaitTermination()
    columns = [c.split()[0] for c in MODERATED_SCHEMA.split(", ")]
    got = sorted(map(tuple, spark.read.schema(MODERATED_SCHEMA).parquet(sink).select(*columns).collect()))
    batch = purify_with_model(rows, loader, keep=["label"], keep_schema="label int")
    assert got == sorted(map(tuple, batch.select(*columns).collect())) and len(got) == 40

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from toxscan.operators import vectors as V

SF001 = "/root/testdata/sf0.001"


def _numpy_pool(rows, heads=4):
    out = {}
    by = {}
    for vid, emb, lab in rows:
        by.setdefault(lab, []).append((vid, np.array(emb, dtype=np.float64)))
    for lab, items in by.items():
        items.sort()
        q = items[0][1]
        keys = [v for _, v in items[1:]]
        hs = len(q) // heads
        pooled = []
        for h in range(heads):
            sl = slice(h * hs, (h + 1) * hs)
            s = np.array([q[sl] @ k[sl] / math.sqrt(hs) for k in keys])
            p = np.exp(s - s.max())
            p /= p.sum()
            pooled.extend(np.tanh(sum(pi * k[sl] for pi, k in zip(p, keys))))
        out[lab] = pooled
    return out


def test_attention_pool_matches_numpy(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    expected = _numpy_pool([(r.vec_id, r.embedding, r.label) for r in emb.collect()])
    got = {}
    for r in V.attention_pool(emb).collect():
        got.setdefault(r.label, {})[r.dim] = r.value
    for lab, vec in expected.items():
        assert np.allclose([got[lab][d] for d in range(64)], vec, atol=1e-9)


def test_head_split_must_divide():
    with pytest.raises(ValueError):
        V.head_size(64, 5)


def test_combine_layers_matches_numpy(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = emb.collect()
    got = {r.label: r.combined for r in V.combine_layers(emb).collect()}
    for lab in got:
        vs = np.array([r.embedding for r in rows if r.label == lab], dtype=np.float64)
        s = vs.sum(axis=0)
        if len(vs) > 1:
            s = (s - s.mean()) / np.sqrt(s.var() + 1e-12)
        assert np.allclose(got[lab], s, atol=1e-9)


def test_linear_head_argmax(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 1.0],), ([0.5, 0.5],)], "v array<double>")
    weights = spark.createDataFrame([(7, [1.0, 0.0], 0.0), (9, [0.0, 1.0], 0.0)], "class int, w array<double>, b double")
    out = V.linear_head(df, "v", weights).collect()
    assert [r.pred for r in out] == [7, 9, 7] and out[0].logits == [1.0, 0.0]
    spark.conf.set("spark.toxscan.broadcastMaxBytes", "10")
    try:
        with pytest.raises(ValueError):
            V.linear_head(df, "v", weights)
    finally:
        spark.conf.unset("spark.toxscan.broadcastMaxBytes")


def test_attribution_by_attention_matches_numpy(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet").selectExpr("vec_id % 7 as doc_id", "vec_id div 7 as pos", "embedding")
    matrix = V.moment_projection(emb)
    rows = emb.collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    moment, mean = x.T @ x / len(x), x.mean(axis=0)
    assert np.allclose([r.w for r in matrix.orderBy("place").collect()], moment) and matrix.count() == 64
    got = {(r.doc_id, r.pos): r for r in V.attribute_attention(emb, matrix, matrix).collect()}
    y = (x @ moment + mean)[:, :16]
    for doc in {r.doc_id for r in rows}:
        at = sorted((r.pos, i) for i, r in enumerate(rows) if r.doc_id == doc)
        s = np.array([y[at[0][1]] @ y[i] / 4 for _, i in at[1:]])
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        found = [got[doc, pos] for pos, _ in at[1:]]
        assert np.allclose([f.score for f in found], s) and np.allclose([f.prob for f in found], p)
        assert [f.place for f in sorted(found, key=lambda f: (-f.prob, f.pos))] == list(range(len(found)))
    assert len(got) == len(rows) - 7


def test_single_head_scale_and_own_keys(spark):
    df = spark.createDataFrame([(0, 1, [1.0] * 8, [2.0] * 8), (0, 2, [1.0] * 8, [3.0] * 8)], "label int, vec_id int, q array<double>, k array<double>")
    got = V.attention_scores(df, vec_col="q", key_col="k", dim=8, heads=1, scale=math.sqrt(8 / 4)).first()
    assert got.score == pytest.approx(24 / math.sqrt(2)) and got.prob == 1.0
    got = V.attention_scores(df, vec_col="q", dim=8, heads=1).first()
    assert got.score == pytest.approx(8 / math.sqrt(8))


def test_pool_reads_one_row_a_key(spark):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    plan = V.attention_pool(emb)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1  # only the result is exploded, no key is

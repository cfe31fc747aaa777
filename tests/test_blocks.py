"""Lookups by block, and the steps whose cost grew faster than their input."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from toxscan.operators import blocks, joins, purify, scorer
from toxscan.operators import tokens as TK

SF001 = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_array_lookup(spark):
    rows = [(i, ["a"] * (i % 4) + [f"x{i}", None, f"w{i % 3}"]) for i in range(2500)] + [(-1, []), (-1, []), (None, None)]
    table = spark.createDataFrame([("a", 1), ("w0", 2), *[(f"x{i}", 10 + i) for i in range(0, 2500, 2)]], "token string, v long")
    known = {r.token: r.v for r in table.collect()}
    df = spark.createDataFrame(rows, "doc_id long, keys array<string>")
    got = rows_of(blocks.array_lookup(df, "keys", table, "token", "v", "found", keep_keys=True))
    assert got == sorted(((i, k, None if k is None else [known.get(x) for x in k]) for i, k in rows), key=str)
    assert blocks.array_lookup(df.limit(0), "keys", table, "token", "v", "found").columns == ["doc_id", "found"]


def test_encode_and_decode_by_block(spark, monkeypatch):
    """The same rows as by exploded tokens, and no token is a row that is sorted or collected again."""
    docs = TK.with_tokens(spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")).select("doc_id", "tokens")
    docs = joins.write_table(docs.unionAll(spark.createDataFrame([(None, []), (None, ["a"] * 148), (5, ["a"] * 149)], docs.schema)), "test-docs")
    vocab = joins.write_table(TK.build_vocab(TK.token_counts(TK.token_table(docs)), 900), "test-vocab")
    pads = (False, True)
    want = [rows_of(TK.encode(docs, vocab, pad=p)) for p in pads] + [rows_of(TK.decode(TK.encode(docs, vocab), vocab))]
    monkeypatch.setattr(blocks, "BLOCKS_FROM_BYTES", 0)
    assert [rows_of(TK.encode(docs, vocab, pad=p)) for p in pads] + [rows_of(TK.decode(TK.encode(docs, vocab), vocab))] == want
    for made in (TK.encode(docs, vocab), TK.decode(TK.encode(docs, vocab), vocab)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_steps_broadcast_no_large_weights(spark):
    """weights within the bound, which each of the steps would broadcast anew, go by block beyond the step's share of it."""
    from toxscan.operators.logistic import BIAS, _scored, unit_features

    rows = blocks.dealt(unit_features(TK.with_row_key(spark.createDataFrame([(["a", "b"],)], "tokens array<string>")), []))
    weights = spark.createDataFrame([(BIAS, 0.5, None), ("a", 2.0, 1)], "token string, weight double, frequency long")
    spark.conf.set("spark.toxscan.broadcastMaxBytes", "200")
    try:
        assert joins.fits_broadcast(weights.select("token", "weight"))
        made = _scored(rows, weights, [], blocks.block_keys(rows, "tokens", "token"))
        assert "FlatMapCoGroupsInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
        assert made.first().z == pytest.approx(0.5 + 2.0 / np.sqrt(2))
    finally:
        spark.conf.unset("spark.toxscan.broadcastMaxBytes")


def test_few_files(spark):
    """beyond twice a task's share the dataset is not written by one task."""
    from toxscan.sources.files import in_few_files

    df = spark.range(400).select(F.col("id").alias("_id"), F.repeat(F.lit("x"), 1000).alias("document"), F.lit(1).alias("label"))
    assert in_few_files(df).rdd.getNumPartitions() == 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        made = in_few_files(df)
        assert made.rdd.getNumPartitions() == 4 and rows_of(made) == rows_of(df)
        assert max(len(p) for p in made.rdd.glom().collect()) < 200
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stored_weights(monkeypatch):
    """flat arrays instead of a dict; tokens that share a hash stay apart."""
    names = [f"t{i}" for i in range(5000)]
    batches = lambda: [(pa.array(names[a:a + 700]), np.arange(a, min(a + 700, 5000)) - 99) for a in range(0, 5000, 700)]
    asked = np.array([*names[::-1], "none", ""], dtype=object)
    want = [*(np.arange(5000) - 99)[::-1], 0, 0]
    assert scorer.StoredWeights(batches()).of(asked).tolist() == want
    assert scorer.StoredWeights([]).of(asked).tolist() == [0] * len(asked)
    model = scorer.AdditiveStoredModel(scorer.StoredWeights(batches()), 7)
    monkeypatch.setattr(scorer.AdditiveStoredModel, "KEPT_TOKENS", 3)
    for _ in range(2):
        total, w = model(np.array(["t100", "none", "t101", "t102"], dtype=object), np.array([0, 2, 2, 4]))
        assert total.tolist() == [8, 7, 12] and w.tolist() == [1, 0, 2, 3]
    monkeypatch.setattr(scorer.StoredWeights, "_hashes", staticmethod(lambda t: np.array([len(x) % 3 for x in t], np.uint64)))
    assert scorer.StoredWeights(batches()).of(asked).tolist() == want


def test_worker_holds_a_slice(spark, monkeypatch):
    """the strings of a batch's documents are made slice by slice."""
    batch = pa.record_batch({"n": pa.array([3, 0, 9, 1, 1, 0])})
    monkeypatch.setattr(purify, "SLICE_TOKENS", 4)
    assert [s.column(0).to_pylist() for s in purify._slices(batch, batch.column(0).to_numpy())] == [[3, 0, 9], [1, 1, 0]]
    assert list(purify._slices(batch.slice(0, 0), np.zeros(0, np.int64))) == []

"""Lookups beyond the broadcast bound: the frequent part stays in place, the rest moves as distinct pairs."""

import re

import pytest
from pyspark.sql import functions as F

from toxscan.operators.joins import element_lookup, filter_bits, frequency_split, mark_likely
from toxscan.operators.purify import attribute, purify
from toxscan.operators.scorer import score
from toxscan.operators.tokens import decode, encode, token_table_outer, with_row_key, with_tokens
from toxscan.plans import artifacts
from toxscan.plans.dataset import with_text

SF001 = "/root/testdata/sf0.001"
BOUND = "spark.toxscan.broadcastMaxBytes"


@pytest.fixture
def small_bound(spark):
    yield lambda n: spark.conf.set(BOUND, str(n))
    spark.conf.unset(BOUND)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_frequency_split_keeps_the_bound(spark):
    table = spark.range(1000).select(F.concat(F.lit("t"), "id").alias("token"), "id", F.floor(1000 / (F.col("id") + 1)).cast("long").alias("n"))
    table = table.unionByName(spark.createDataFrame([("none", -1, None)], "token string, id long, n long"))
    hot, cold, n_cold = frequency_split(table, "n", 40 * 60)
    assert hot.count() + cold.count() == 1001 and n_cold == cold.count() and hot.columns == ["token", "id"]
    assert {"none", "t0", "t1"} <= {r.token for r in hot.collect()} and 30 < hot.count() < 60
    assert frequency_split(table, "n", 0)[0].count() == 0 and frequency_split(table, "n", 1 << 30)[2] == 0
    assert filter_bits(0) == 23 and filter_bits(10 ** 7) == 27 and filter_bits(10 ** 12) == 29


def test_mark_likely(spark):
    keys = spark.range(50).select((F.col("id") * 7).alias("k"))
    got = {r.k: r.may for r in mark_likely(spark.range(400).select(F.col("id").alias("k")).unionAll(
        spark.createDataFrame([(None,)], "k long")), keys, "k", "may").collect()}
    assert all(got[i * 7] for i in range(50)) and not got[None] and sum(got.values()) < 60 and len(got) == 401


def test_split_lookup_equals_broadcast(spark):
    docs = [(i, ["a"] * (i % 5) + [f"w{i % 7}", "unseen", f"x{i}"], "k") for i in range(60)] + [(60, [], "k"), (60, [], "k"), (None, ["a"] * 400 + [None], "k")]
    df = with_row_key(spark.createDataFrame(docs, "doc_id long, tokens array<string>, kept string"))
    table = spark.createDataFrame([("a", 1, 500), ("rare", 9, 0), *[(f"w{i}", 10 + i, 9) for i in range(7)], *[(f"x{i}", 100 + i, 1) for i in range(50)]],
                                  "token string, id long, n long")
    explode = lambda r: token_table_outer(r, ["_row", "doc_id", "kept"])
    want = rows_of(element_lookup(df, explode, table, "token", ["doc_id", "kept"], "n").select("doc_id", "kept", "pos", "token", "id"))
    for bound in (0, 100, 400, 1500):
        got = element_lookup(df, explode, table, "token", ["doc_id", "kept"], "n", max_bytes=bound)
        assert rows_of(got.select("doc_id", "kept", "pos", "token", "id")) == want
    salted = element_lookup(df, explode, table.drop("n"), "token", ["doc_id", "kept"], max_bytes=0)
    assert rows_of(salted.select("doc_id", "kept", "pos", "token", "id")) == want


def test_text_jobs_beyond_the_bound(spark, small_bound):
    vocab, scorer = artifacts.vocab(spark, SF001), artifacts.scorer(spark, SF001)
    tokens = artifacts.doc_tokens(spark, SF001)
    test = with_text(artifacts.dataset(spark, SF001).test, spark, SF001)

    def all_jobs():
        enc = encode(tokens, vocab)
        return [rows_of(x) for x in (enc, decode(enc, vocab), score(with_tokens(test), scorer, keep=["label"]),
                                     purify(test, scorer, keep=["label"]), attribute(test, scorer).withColumn("prob", F.round("prob", 9)))]

    want = all_jobs()
    for bound in (4096, 1 << 16):
        small_bound(bound)
        assert all_jobs() == want


def test_frequent_tokens_are_in_no_exchange(spark, small_bound):
    """Below every exchange by token lies the filter that lets only keys of the rare part through; the row exchange carries
    arrays."""
    small_bound(1 << 14)
    plan = encode(artifacts.doc_tokens(spark, SF001), artifacts.vocab(spark, SF001))._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if re.search(r"Join (LeftOuter|Inner), \(token", x)]
    assert len(joins) >= 3  # broadcast of the frequent part on both sides, and the rare part
    shuffled = [x for x in joins if "broadcast" not in x]
    assert len(shuffled) == 1
    below = plan[plan.index(shuffled[0]):]
    assert re.search(r"Filter .*isnull\(_hot", below) and "collect_list(struct(pos" in below
    executed = encode(artifacts.doc_tokens(spark, SF001), artifacts.vocab(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    by_pos = [x for x in executed.splitlines() if "Exchange hashpartitioning" in x and re.search(r"hashpartitioning\([^)]*pos#", x)]
    assert not by_pos

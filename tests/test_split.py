import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from toxscan.operators.ranking import exact_rank
from toxscan.operators.split import balanced_train, oversample, shuffle_rows, stratified_split
from toxscan.plans.dataset import labelled_dataset

SF01 = "/root/testdata/sf0.01"


def test_exact_rank_equals_row_number(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang", "n_chars")
    for parts in ([], ["lang"]):
        r = exact_rank(docs, [F.col("n_chars").desc(), "doc_id"], parts, rank_col="rk", count_col="n", num_partitions=7)
        w = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(1))
        chk = r.withColumn("rn", F.row_number().over(w.orderBy(F.col("n_chars").desc(), "doc_id")) - 1)
        chk = chk.withColumn("cnt", F.count(F.lit(1)).over(w))
        assert chk.filter("rn != rk OR cnt != n").count() == 0
        assert r.count() == 1000


def test_exact_rank_sf01_many_partitions(spark):
    # At sf0.1 AQE coalesces shuffle reads differently per branch; ranks must not depend on it.
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    keyed = docs.withColumn("k", F.md5(F.concat_ws(":", F.lit("42"), "doc_id")))
    r = exact_rank(keyed, ["k", "doc_id"], ["lang"], rank_col="rk", num_partitions=32)
    chk = r.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("k", "doc_id")) - 1)
    assert chk.filter("rn != rk").count() == 0 and chk.count() == 10000


def test_labelled_split_matches_fixtures(spark):
    ds = labelled_dataset(spark, SF01)
    c = {(r.split, r.bucket): r.n for r in ds.summary().collect()}
    assert c[("all", 0)] == 299 and c[("all", 1)] == 42
    assert c[("train", 0)] == 224 and c[("train", 1)] == 31
    assert c[("test", 0)] == 75 and c[("test", 1)] == 11
    assert c[("train_balanced", 0)] == 224 and c[("train_balanced", 1)] == 224
    minority = ds.train.filter("bucket = 1")
    agg = minority.agg(F.countDistinct("doc_id").alias("d"), F.sum("copy").alias("s")).first()  # 0-based copies
    assert agg.d == 31 and agg.s == 700
    # train + test = input, positions are a permutation
    assert ds.split.count() == 341
    pos = [r.position for r in ds.train.select("position").collect()]
    assert sorted(pos) == list(range(448))


def _frame(spark, n0, n1):
    rows = [(i, 0) for i in range(n0)] + [(1000 + i, 1) for i in range(n1)]
    df = spark.createDataFrame(rows, "doc_id long, bucket int")
    return stratified_split(df, "bucket", ["doc_id"], test_ratio=0.0)


@pytest.mark.parametrize("n0,n1", [(10, 3), (9, 3), (3, 10), (5, 5)])
def test_oversample_properties(spark, n0, n1):
    split = _frame(spark, n0, n1)
    over = oversample(split).collect()
    assert len(over) == n0  # exactly n0 rows
    ratio = n0 // n1 + 1
    expected = [(c, r) for c in range(ratio) for r in range(n1)][:n0]
    assert sorted((r.copy, r._id) for r in over) == sorted(expected)


def test_oversample_empty_minority_is_an_error(spark):
    with pytest.raises(ValueError):
        oversample(_frame(spark, 4, 0))


def test_shuffle_is_reproducible(spark):
    split = _frame(spark, 20, 6)
    a = [tuple(r) for r in shuffle_rows(balanced_train(split)).orderBy("position").select("doc_id", "copy").collect()]
    b = [tuple(r) for r in shuffle_rows(balanced_train(split)).orderBy("position").select("doc_id", "copy").collect()]
    assert a == b and len(a) == 40


def test_oversample_counts_beyond_32_bits(spark, monkeypatch):
    from toxscan.operators import split

    monkeypatch.setattr(split, "class_counts", lambda *a, **k: {0: 3_000_000_000, 1: 500_000_000})
    train = spark.createDataFrame([(1, 1, 499_999_999), (2, 1, 0)], "doc_id long, bucket int, _id long")
    got = split.oversample(train)
    assert got.count() == 12 and got.agg({"copy": "max"}).first()[0] == 5

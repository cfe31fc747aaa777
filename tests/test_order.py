"""Places in files and permuted orders, without a sort or an exchange of rows."""

import pytest
from pyspark.sql import functions as F

from toxscan.functions.permute import bases, permuted, round_keys
from toxscan.operators.ranking import exact_rank, scan_rank
from toxscan.operators.split import balanced_train, class_counts, random_split_permuted, shuffle_permuted, stratified_split_scan
from toxscan.session import is_scan


def plain_permuted(i, n, seed):
    """The same network in Python."""
    a, b = bases(n)
    low = (1 << 31) - 1

    def h(d, k):
        x = ((d & low) ^ k) * 2654435761
        x = ((x ^ (x >> 29)) & low) * 2246822519
        return (x ^ (x >> 31)) & low

    while True:
        left, right = divmod(i, b)
        for r, k in enumerate(round_keys(seed)):
            if r % 2 == 0:
                left = (left + h(right, k)) % a
            else:
                right = (right + h(left, k)) % b
        i = left * b + right
        if i < n:
            return i


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 1000, 4097, 99991])
def test_permutation_is_a_bijection(spark, n):
    got = [r[0] for r in spark.range(n).coalesce(1).select(permuted(F.col("id"), n, 7)).collect()]
    assert sorted(got) == list(range(n))
    if n > 1:
        assert got[:200] == [plain_permuted(i, n, 7) for i in range(min(n, 200))]
    a, b = bases(n)
    assert a * b >= n and a * b - n < b
    if n == 99991:
        other = [r[0] for r in spark.range(n).coalesce(1).select(permuted(F.col("id"), n, 8)).collect()]
        assert sum(x == y for x, y in zip(got, other)) < 20 and sum(abs(x - i) < 1000 for i, x in enumerate(got)) < 4000


def test_large_places(spark):
    n = 3 * 10 ** 12 + 17
    places = [0, 1, n // 2, n - 1]
    df = spark.createDataFrame([(p,) for p in places], "p long")
    assert [r[0] for r in df.coalesce(1).select(permuted(F.col("p"), n, 42)).collect()] == [plain_permuted(p, n, 42) for p in places]


@pytest.fixture
def files(spark, tmp_path):
    """Rows in three files of several row groups; ids are not in order."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    df = spark.range(3000).select(((F.col("id") * 7919) % 3000).alias("doc_id"), (F.col("id") % 3).cast("int").alias("bucket"))
    df.repartition(3).write.option("parquet.block.size", "2048").parquet(str(tmp_path / "p"))
    yield spark.read.parquet(str(tmp_path / "p"))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def in_file_order(df):
    rows = df.select("*", "_metadata.file_path", "_metadata.row_index").collect()
    return sorted(rows, key=lambda r: (r.file_path, r.row_index))


def test_scan_rank(spark, files):
    want = {r.doc_id: i for i, r in enumerate(in_file_order(files))}
    out = scan_rank(files, count_col="n")
    assert {r.doc_id: r["rank"] for r in out.collect()} == want and {r.n for r in out.collect()} == {3000}
    kept = files.filter("doc_id % 4 != 1")
    seen, places = {}, {}
    for r in in_file_order(kept):
        places[r.doc_id] = seen.get(r.bucket, 0)
        seen[r.bucket] = places[r.doc_id] + 1
    assert {r.doc_id: r._id for r in scan_rank(kept, "bucket", rank_col="_id").collect()} == places
    assert scan_rank(files.filter("doc_id < 0"), "bucket").count() == 0 and scan_rank(files.filter("doc_id < 0")).count() == 0


def test_only_scans_have_places(spark, files):
    assert is_scan(files) and is_scan(files.filter("doc_id > 3").select("doc_id").filter("doc_id < 9"))
    for df in (files.select(F.explode(F.array("doc_id", "doc_id")).alias("d")), files.join(files.select("doc_id"), "doc_id"),
               files.sample(0.5), files.distinct(), files.repartition(2), files.union(files), spark.range(3), files.limit(5)):
        assert not is_scan(df)
        with pytest.raises(ValueError, match="plain scan"):
            scan_rank(df)


def test_no_row_is_exchanged_or_sorted(spark, files):
    for df in (scan_rank(files, "bucket"), random_split_permuted(files), stratified_split_scan(files)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Sort" not in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_permuted_splits(spark, files):
    out = random_split_permuted(files, seed=3).collect()
    assert sorted(r.position for r in out) == list(range(3000)) and sum(r.split == "train" for r in out) == 2250
    two = files.withColumn("bucket", F.least("bucket", F.lit(1))).filter("bucket = 0 or doc_id % 9 = 1")
    split = stratified_split_scan(two)
    n = class_counts(split.filter("split = 'train'"))
    assert n[0] == 750
    rows = shuffle_permuted(balanced_train(split), n[0], n[1]).collect()
    assert sorted(r.position for r in rows) == list(range(1500)) and len({(r.doc_id, r.copy) for r in rows}) == 1500


def test_exact_rank_reads_a_shuffled_input_once(spark, files):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = files.mapInPandas(count, files.schema).groupBy("doc_id").agg(F.max("bucket").alias("bucket"))
    assert exact_rank(df, ["doc_id"]).agg(F.max("rank")).first()[0] == 2999
    assert seen.value == 3000

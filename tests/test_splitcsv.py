"""Dataset files read in blocks: the same rows as one task reading the whole file."""

import csv
import io

import pytest

from toxscan.sources.files import _has_large_file, read_dataset
from toxscan.sources.splitcsv import read_records

SHARE = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_share(spark):
    spark.conf.set(SHARE, "700")
    yield
    spark.conf.unset(SHARE)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def documents(n):
    for i in range(n):
        text = [f"plain {i}", f"two\nlines {i}", 'a "quoted" word, and\n\n"more"\n', "", None, "x" * (i % 900), "\n" * (i % 40), "é日\U0001f600,\t"][i % 8]
        yield i, text, i % 2


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("suffix,sep", [("csv", ","), ("tsv", "\t")])
def test_one_file_in_many_tasks(spark, tmp_path, small_share, suffix, sep, end):
    p = tmp_path / f"one.{suffix}"
    out = io.StringIO()
    w = csv.writer(out, delimiter=sep, lineterminator=end)
    w.writerow(["_id", "document", "label"])
    for i, t, k in documents(300):
        w.writerow([i, t, k])
    p.write_bytes(out.getvalue().encode())
    assert read_records(spark, str(p)).count() == 301
    assert spark.read.option("lineSep", "\n").text(str(p)).rdd.getNumPartitions() >= 8
    got = rows_of(read_dataset(spark, str(p)))
    assert got == rows_of(read_dataset(spark, str(p), split=False)) and len(got) == 300
    kept = {r[0]: r[1] or "" for r in got}
    assert all(kept[i] == (t or "") for i, t, _ in documents(300))


def test_written_dataset_and_a_long_record(spark, tmp_path, small_share):
    rows = [(0, "start", 0), (1, "line\n" * 3000, 1), (2, 'quote "', 0), (3, None, 1), (4, "", 0), (5, "end\n", 1)]
    path = str(tmp_path / "made.csv")
    from toxscan.sources.files import write_dataset

    write_dataset(spark.createDataFrame(rows, "_id long, document string, label int").coalesce(1), path)
    assert rows_of(read_dataset(spark, path)) == rows_of(read_dataset(spark, path, split=False)) == sorted(rows, key=str)


def test_several_files_and_blocks_beyond_the_bound(spark, tmp_path, small_share):
    d = tmp_path / "many.csv"
    d.mkdir()
    for k in range(3):
        text = "_id,document,label\n" + "".join(f'{100 * k + i},"a\nb ""{i}""",0\n' for i in range(60))
        (d / f"part{k}.csv").write_text(text)
    want = rows_of(read_dataset(spark, str(d), split=False))
    assert rows_of(read_dataset(spark, str(d), split=True)) == want and len(want) == 180
    spark.conf.set("spark.toxscan.broadcastMaxBytes", "0")
    try:
        assert rows_of(read_dataset(spark, str(d), split=True)) == want
    finally:
        spark.conf.unset("spark.toxscan.broadcastMaxBytes")


def test_large_files_are_found(spark, tmp_path, small_share):
    p = tmp_path / "a.csv"
    p.write_text("_id,document,label\n" + "1,a,0\n" * 200)
    assert _has_large_file(spark, str(p))
    spark.conf.set(SHARE, "128MB")
    assert not _has_large_file(spark, str(p))


def test_bad_files(spark, tmp_path, small_share):
    p = tmp_path / "open.csv"
    p.write_text('_id,document,label\n1,"never closed\n' + "x\n" * 900)
    with pytest.raises(ValueError, match="inside a quoted field"):
        read_dataset(spark, str(p))
    p = tmp_path / "cell.csv"
    p.write_text("_id,document,label\n" + "1,a,b\n" * 300)
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_dataset(spark, str(p)).collect()
    p = tmp_path / "header.csv"
    p.write_text("_id,document,label\n")
    assert read_dataset(spark, str(p), split=True).count() == 0

"""The posts data source, cache folders, and progress counts observed by the build."""

import json

import pytest
from pyspark.sql import functions as F

from toxscan.functions.keys import url_key
from toxscan.operators import keylookup as KL
from toxscan.plans.dataset import observed_dataset
from toxscan.sources.exported import _passes, read_exported
from toxscan.sources.posts import progress_counts


@pytest.fixture(scope="module")
def posts_rows():
    return [{"_id": i, "string": ["plain", "two\nlines", "", None, "quote \"x\" é日\U0001f600", "y" * (i * 37 % 900)][i % 6],
             "label": [0, 1, -1, 2, None][i % 5], "labeling_confirm": i % 3, "other": {"a": [i]}} for i in range(500)]


@pytest.fixture(scope="module")
def folder(tmp_path_factory, posts_rows):
    d = tmp_path_factory.mktemp("posts")
    for k in range(3):
        lines = [json.dumps(r, ensure_ascii=k == 1) for r in posts_rows[k::3]]
        (d / f"part{k}.json").write_text("\n".join(lines) + ("\n" if k else "") + ("\n\n" if k == 2 else ""), encoding="utf-8")
    (d / "_SUCCESS").write_text("")
    return str(d)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_ranges_hold_every_line_once(spark, folder, posts_rows, size):
    got = read_exported(spark, folder, range_bytes=size)
    assert got.columns == ["doc_id", "string", "label", "labeling_confirm"]
    assert rows_of(got) == sorted((tuple(r[c] for c in ("_id", "string", "label", "labeling_confirm")) for r in posts_rows), key=str)
    if size == 1000:
        assert got.rdd.getNumPartitions() > 20


def test_the_source_takes_the_filters(spark, folder, posts_rows):
    df = read_exported(spark, folder, range_bytes=5000).filter((F.col("label") != -1) & (F.col("labeling_confirm") != 0) & F.col("string").contains("l"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    left = [x for x in plan.splitlines() if "Filter" in x]
    assert len(left) == 1 and "string" in left[0] and "label" not in left[0]
    want = [r for r in posts_rows if r["label"] not in (None, -1) and r["labeling_confirm"] != 0 and "l" in (r["string"] or "")]
    assert sorted(r.doc_id for r in df.collect()) == [r["_id"] for r in want]
    for keep, test in ((F.col("label").isin(0, 2), lambda r: r["label"] in (0, 2)), (F.col("label").isNull(), lambda r: r["label"] is None),
                       (~F.col("label").isin(0, 2), lambda r: r["label"] not in (0, 2, None)), (F.col("labeling_confirm") >= 1, lambda r: r["labeling_confirm"] >= 1),
                       ((F.col("label") == 1) | (F.col("labeling_confirm") == 2), lambda r: r["label"] == 1 or r["labeling_confirm"] == 2)):
        assert sorted(r.doc_id for r in read_exported(spark, folder).filter(keep).collect()) == [r["_id"] for r in posts_rows if test(r)]
    assert _passes  # used by the reader


def test_ids_of_the_store_and_bad_lines(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text('{"_id": {"$oid": "64ab"}, "string": "x", "label": 1, "labeling_confirm": 0}\n{"_id": {"$oid": "64ac"}, "label": 0}\n')
    assert rows_of(read_exported(spark, str(p), id="oid")) == [("64ab", "x", 1, 0), ("64ac", None, 0, None)]
    p = tmp_path / "b.json"
    p.write_text('{"_id": 1, "string": "x", "label": "one"}\n')
    with pytest.raises(Exception, match="label|JSON"):
        read_exported(spark, str(p)).collect()
    (tmp_path / "none").mkdir()
    assert read_exported(spark, str(tmp_path / "none")).count() == 0


def test_cache_folder(spark, tmp_path):
    rows = [("http://a/x", "e1", "one"), ("http://a/x", "e2", "two, longer"), ("http://a/x", None, "plain"), ("http://b", "e9", "b"), ("http://c", "z", "é")]
    df = spark.createDataFrame(rows, "url string, etag string, content string").withColumn("key", url_key("url", "etag"))
    folder = str(tmp_path / "cache")
    assert KL.write_cache(df, folder) == 5 and KL.write_cache(df, folder) == 5  # again: the same files
    assert len(list((tmp_path / "cache").iterdir())) == 10
    key = {(r.url, r.etag): r.key for r in df.collect()}
    (tmp_path / "cache" / "lonely").write_text("no sidecar")
    asked = spark.createDataFrame([(key["http://a/x", "e2"],), (key["http://c", "z"],), ("unknown",), ("lonely",)], "key string")
    assert rows_of(KL.cache_lookup(asked, folder)) == sorted([(key["http://a/x", "e2"], "http://a/x", "e2", 11), (key["http://c", "z"], "http://c", "z", 2)])
    assert rows_of(KL.missing_in_cache(asked, folder)) == [("lonely", "no metadata"), ("unknown", "no file")]
    (tmp_path / "cache" / key["http://a/x", None]).unlink()
    urls = spark.createDataFrame([("http://a/x",), ("http://a/x",), ("http://b",), ("http://nowhere",)], "url string")
    got = {r.url: (r.file_name, r.n_variants) for r in KL.latest_cached(urls, folder).collect()}
    assert got == {"http://a/x": (max(key["http://a/x", "e1"], key["http://a/x", "e2"]), 2), "http://b": (key["http://b", "e9"], 1)}


def test_a_listing_opens_no_file(spark, tmp_path):
    KL.write_cache(spark.createDataFrame([("k", "u", "e", "text")], "key string, url string, etag string, content string"), str(tmp_path / "c"))
    plan = KL.cached_files(spark, str(tmp_path / "c"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<length:bigint>" in plan or "content" not in plan.split("ReadSchema")[1].split(">")[0]
    (tmp_path / "c" / "bad.json").write_text("{not json")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        KL.cached_metadata(spark, str(tmp_path / "c")).collect()


def test_the_build_counts_as_it_reads(spark):
    rows = spark.createDataFrame([(i, i % 4 - 1, i % 3) for i in range(600)], "doc_id long, label int, labeling_confirm int").repartition(4)
    want = progress_counts(rows).first()
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    built, progress = observed_dataset(rows.mapInPandas(count, rows.schema))
    assert tuple(progress.first()) == tuple(want) and seen.value == 600  # one scan
    summary = {(r.split, r.bucket): r.n for r in built.summary(progress).collect()}
    assert summary["kept", None] == want.kept_confirmed and summary["seen", None] == 600
    assert built.split.count() == want.kept_confirmed

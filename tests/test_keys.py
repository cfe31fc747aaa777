from pyspark.sql import functions as F

from toxscan.functions import keys as K
from toxscan.operators.keylookup import latest_version, missing_keys, require_found

import pytest


def test_url_key(spark):
    df = spark.createDataFrame([("u", None), ("u", ""), ("u", "e")], "url string, etag string")
    got = [r.k for r in df.select(K.url_key("url", "etag").alias("k")).collect()]
    h = "0bfe935e70c321c7ca3afc75ce0d0ca2f98b5422e008bb31c00c6d7f1f1c0ad6"
    assert got[0] == h and got[1] == h
    assert got[2].startswith(h + ".") and len(got[2]) == 129


def test_uri_parts(spark):
    rows = [("https://b.example.com/x/y.TXT?q=1",), ("s3://bucket/key/a.tar.gz",), ("/local/.bashrc",),
            ("ftp://h/p",), ("s3://bucket",), ("name.",)]
    df = spark.createDataFrame(rows, "u string")
    out = df.select(K.route_uri("u").alias("r"), K.object_bucket("u").alias("b"), K.object_key("u").alias("k"),
                    K.object_path_valid("u").alias("v"), K.file_extension("u").alias("e"),
                    K.file_extension("u", dot=False, lower=False).alias("e2")).collect()
    assert [r.r for r in out] == ["remote", "remote", "local", "error", "remote", "local"]
    assert (out[1].b, out[1].k, out[1].v) == ("bucket", "key/a.tar.gz", True)
    assert out[4].v is False
    # as os.path.splitext on the raw string: the query stays in the extension
    assert [r.e for r in out] == [".txt?q=1", ".gz", "", "", "", "."]
    assert out[0].e2 == "TXT?q=1"


def test_lookup_and_latest(spark):
    entries = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", None)], "url string, etag string")
    meta = entries.select(K.url_key("url", "etag").alias("key"), "url", "etag")
    keys = spark.createDataFrame([(r.key,) for r in meta.collect()] + [("nope",)], "key string")
    assert [r.key for r in missing_keys(keys, meta).collect()] == ["nope"]
    with pytest.raises(FileNotFoundError):
        require_found(keys, meta)
    lv = {r.url: r for r in latest_version(entries).collect()}
    assert lv["a"].n_variants == 2 and lv["a"].file_name == max(r.key for r in meta.filter("url = 'a'").collect())


def test_plain_entry_comes_first(spark):
    entries = spark.createDataFrame([("u", None), ("u", "e"), ("v", "a"), ("v", "b")], "url string, etag string")
    got = {r.url: r for r in latest_version(entries).collect()}
    assert got["u"].etag is None and got["u"].n_variants == 2 and "." not in got["u"].file_name
    named = {e: K.url_key(F.lit("v"), F.lit(e)) for e in "ab"}
    names = spark.range(1).select(*[c.alias(e) for e, c in named.items()]).first()
    assert got["v"].file_name == max(names)

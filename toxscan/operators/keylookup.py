"""K2, K3: looking up URL keys and picking the latest cached variant, over tables of entries or over a cache folder.

A cache folder holds a file for each key and beside it ``<key>.json`` with ``url`` and ``etag``. Its listing is a scan that reads no content. Spark's
file sources pass over empty files, so a cached file without content counts as missing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toxscan.functions.keys import url_key
from toxscan.session import ship_package


def key_metadata(entries: DataFrame, url_col: str = "url", etag_col: str = "etag") -> DataFrame:
    """``(key, url, etag)`` for cache entries."""
    return entries.select(url_key(url_col, etag_col).alias("key"), F.col(url_col).alias("url"),
                          F.col(etag_col).alias("etag"))


def key_lookup(keys: DataFrame, metadata: DataFrame, key_col: str = "key") -> DataFrame:
    """K2: each requested key with its ``(url, etag)``; a shuffle join on a hash key (uniform)."""
    return keys.join(metadata, keys[key_col] == metadata["key"], "inner").select(keys[key_col].alias("key"), "url", "etag")


def missing_keys(keys: DataFrame, metadata: DataFrame, key_col: str = "key") -> DataFrame:
    """K2: requested keys with no metadata (the reference raises for each of them)."""
    return keys.join(metadata, keys[key_col] == metadata["key"], "left_anti")


def require_found(keys: DataFrame, metadata: DataFrame, key_col: str = "key") -> DataFrame:
    missing = missing_keys(keys, metadata, key_col).limit(1).collect()
    if missing:
        raise FileNotFoundError(f"no metadata for key {missing[0][0]}")
    return key_lookup(keys, metadata, key_col)


def latest_version(entries: DataFrame, url_col: str = "url", etag_col: str = "etag") -> DataFrame:
    """K3: per URL, the cached entry to use without an etag: the plain one if there is one, else the variant whose
    file name ``url_key.etag_key`` is the greatest (a deterministic "last" of the listing).

    A ``groupBy`` with ``max_by`` (partially aggregated), not a window, so a URL with very many
    variants does not land in one task.
    """
    named = entries.select(
        F.sha2(F.col(url_col), 256).alias("url_key"), F.col(url_col).alias("url"),
        url_key(url_col, etag_col).alias("file_name"), F.col(etag_col).alias("etag"),
    ).filter(~F.col("file_name").endswith(".json"))
    rank = F.struct((F.col("file_name") == F.col("url_key")).alias("plain"), F.col("file_name"))
    best = F.max_by(F.struct("url", "file_name", "etag"), rank).alias("best")
    return named.groupBy("url_key").agg(best, F.count(F.lit(1)).alias("n_variants")).select(
        "url_key", "best.url", "best.file_name", "best.etag", "n_variants")


# --- a cache folder --------------------------------------------------------------------------------

SIDECAR = ".json"


def write_cache(entries: DataFrame, folder: str) -> int:
    """Write ``(key, url, etag, content)`` to a cache folder: a file and its sidecar for each row, by the tasks themselves. A file is written
    beside its name and moved there, so a repeated task leaves whole files. Returns the number of files."""
    ship_package(entries.sparkSession)

    def write(batches: Iterator) -> Iterator:
        import json

        import pyarrow as pa
        from pyarrow import fs

        path = folder.removeprefix("file:") if folder.startswith("file:/") and not folder.startswith("file://") else folder
        system, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        system.create_dir(base, recursive=True)

        def put(name: str, content: bytes) -> None:
            import uuid

            part = f"{base}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                f.write(content)
            system.move(part, f"{base}/{name}")

        for batch in batches:
            for key, url, etag, content in zip(*(c.to_pylist() for c in batch.columns)):
                put(key, (content or "").encode())
                put(key + SIDECAR, json.dumps({"url": url, "etag": etag}).encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    done = entries.select("key", "url", "etag", "content").mapInArrow(write, "n long")
    return done.agg(F.sum("n")).first()[0] or 0


def cached_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(file_name, length)`` of the cached files in a folder, sidecars left out. The column of contents is pruned: no file is opened."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select(F.col("_metadata.file_name").alias("file_name"), "length").filter(~F.col("file_name").endswith(SIDECAR))


def cached_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """``(key, url, etag)`` from the sidecars of a folder. One that is no JSON document is an error."""
    told = spark.read.option("wholetext", True).option("pathGlobFilter", "*" + SIDECAR).text(folder)
    name = F.col("_metadata.file_name")
    parsed = told.select(F.substring(name, 1, F.length(name) - len(SIDECAR)).alias("key"),
                         F.from_json("value", "url string, etag string", {"mode": "FAILFAST"}).alias("m"))
    return parsed.select("key", "m.url", "m.etag")


def cache_lookup(keys: DataFrame, folder: str, key_col: str = "key") -> DataFrame:
    """K2 over a cache folder: ``(key, url, etag, length)`` of the requested keys that have both their file and its sidecar."""
    spark = keys.sparkSession
    entries = cached_files(spark, folder).join(cached_metadata(spark, folder).withColumnRenamed("key", "file_name"), "file_name")
    return keys.select(F.col(key_col).alias("key")).join(entries.withColumnRenamed("file_name", "key"), "key").select("key", "url", "etag", "length")


def missing_in_cache(keys: DataFrame, folder: str, key_col: str = "key") -> DataFrame:
    """K2: requested keys without a file, or whose file has no sidecar (the lookup of each is an error), and ``reason``."""
    spark = keys.sparkSession
    asked = keys.select(F.col(key_col).alias("key"))
    files = cached_files(spark, folder).select(F.col("file_name").alias("key"), F.lit(True).alias("_file"))
    told = cached_metadata(spark, folder).select("key", F.lit(True).alias("_told"))
    found = asked.join(files, "key", "left").join(told, "key", "left")
    reason = F.when(F.col("_file").isNull(), "no file").when(F.col("_told").isNull(), "no metadata")
    return found.select("key", reason.alias("reason")).filter(F.col("reason").isNotNull())


def latest_cached(urls: DataFrame, folder: str, url_col: str = "url") -> DataFrame:
    """K3 over a cache folder: for each URL ``(url, url_key, file_name, n_variants)``: the plain file if there is one, else the last of its variants
    by name. The listing is reduced to a row a URL key, partly before its shuffle, before URLs meet it."""
    spark = urls.sparkSession
    files = cached_files(spark, folder).select(F.substring_index("file_name", ".", 1).alias("url_key"), "file_name")
    rank = F.struct((F.col("file_name") == F.col("url_key")).alias("plain"), F.col("file_name"))
    best = files.groupBy("url_key").agg(F.max_by("file_name", rank).alias("file_name"), F.count(F.lit(1)).alias("n_variants"))
    asked = urls.select(F.col(url_col).alias("url"), url_key(url_col).alias("url_key")).distinct()
    return asked.join(best, "url_key").select("url", "url_key", "file_name", "n_variants")

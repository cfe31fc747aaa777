"""The labelled-post table.

``read_posts`` reads a table of posts as such (Parquet or JSON lines with ``string, label, labeling_confirm``).
``scan_posts`` makes posts of the driver tables:

A post is ``(doc_id, string, label, labeling_confirm)``. It is read from the driver tables as
``documents`` joined with ``labels`` on ``doc_id``: ``string`` = text, ``label`` = toxic,
``labeling_confirm`` = quality. Posts without a label row get ``label = -1`` and
``labeling_confirm = 0`` when unlabelled posts are requested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toxscan.session import read_table, spread, write_table

POST_COLUMNS = ("string", "label", "labeling_confirm")


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, string, label, labeling_confirm)`` from a table of posts: JSON lines if the path ends in ``json``,
    else Parquet. A table without ``doc_id`` gets one, by place, and is written once so that it stays.
    A value of the wrong type is an error."""
    if path.rstrip("/").endswith(("json", "jsonl")):
        schema = "doc_id BIGINT, string STRING, label INT, labeling_confirm INT"
        posts = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
        if posts.filter(F.col("doc_id").isNotNull()).limit(1).count() == 0:
            posts = posts.drop("doc_id")
    else:
        posts = spark.read.parquet(path)
    if missing := [c for c in POST_COLUMNS if c not in posts.columns]:
        raise ValueError(f"posts lack the columns {', '.join(missing)}")
    typed = [F.col("string"), F.col("label").cast("int").alias("label"), F.col("labeling_confirm").cast("int").alias("labeling_confirm")]
    if "doc_id" in posts.columns:
        return posts.select("doc_id", *typed)
    return write_table(posts.select(F.monotonically_increasing_id().alias("doc_id"), *typed), "posts")


def scan_posts(spark: SparkSession, sf_dir: str, include_unlabelled: bool = False,
               spread_text: bool = False) -> DataFrame:
    """Full scan of the post collection. Filters applied later reach the parquet scans.
    ``spread_text`` spreads a document scan that has too few partitions, for callers that run the
    text functions on every post."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    if spread_text:
        docs = spread(docs, "doc_id")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    if not include_unlabelled:
        # Plain column references, so that filters on label / labeling_confirm reach the scan.
        joined = docs.join(labels, "doc_id", "inner")
        return joined.select("doc_id", F.col("text").alias("string"), F.col("toxic").cast("int").alias("label"),
                             F.col("quality").cast("int").alias("labeling_confirm"))
    joined = docs.join(labels.withColumn("_found", F.lit(True)), "doc_id", "left")
    return joined.select(
        "doc_id",
        F.col("text").alias("string"),
        # no label row: unlabelled; a label row without a value stays null and is rejected by the filters
        F.when(F.col("_found").isNull(), F.lit(-1)).otherwise(F.col("toxic")).cast("int").alias("label"),
        F.coalesce(F.col("quality"), F.lit(0)).cast("int").alias("labeling_confirm"),
    )


def kept_all(label: str = "label"):
    """Kept by the all-data path: the label is not -1. A null label passes, to be rejected by ``known_label``."""
    return F.col(label).isNull() | (F.col(label) != -1)


def kept_confirmed(label: str = "label", confirm: str = "labeling_confirm"):
    """Kept by the labelled path: confirmed (a missing flag is not 0) and labelled. Written without
    ``coalesce`` so that parquet can take it as a pushed filter."""
    return (F.col(confirm).isNull() | (F.col(confirm) != 0)) & kept_all(label)


def known_label(posts: DataFrame, label: str = "label") -> DataFrame:
    """Reject a null label: the job fails and says why, as the reference does on a label that is no number."""
    told = F.raise_error(F.lit("a post that is kept has no label")).cast("int")
    return posts.withColumn(label, F.when(F.col(label).isNull(), told).otherwise(F.col(label)))


def progress_columns() -> list:
    """Aggregates: rows kept by each path, and rows seen."""
    return [F.count_if(F.coalesce(kept_all(), F.lit(False))).alias("kept_all"),
            F.count_if(F.coalesce(kept_confirmed(), F.lit(False))).alias("kept_confirmed"),
            F.count(F.lit(1)).alias("seen")]


def progress_counts(posts: DataFrame) -> DataFrame:
    """Rows kept by each path and rows seen, in one aggregation pass."""
    return posts.agg(*progress_columns())

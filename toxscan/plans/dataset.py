"""Dataset build (lifecycle A): posts -> confirmed -> dataset -> class split -> balanced train.

All frames stay narrow (ids and labels); text is joined back by ``doc_id`` only where it is read,
so the rank shuffles never carry documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from toxscan.operators.filters import class_bucket, confirmed_only, drop_unlabelled
from toxscan.operators.joins import likely_in
from toxscan.operators.split import (
    DEFAULT_SEED,
    DEFAULT_TEST_RATIO,
    balanced_train,
    random_split,
    shuffle_rows,
    split_summary,
    stratified_split,
)
from toxscan.session import read_table, spread, write_table
from toxscan.sources.posts import progress_columns, scan_posts


@dataclass
class LabelledDataset:
    split: DataFrame  # doc_id, label, bucket, _id (position in class), split
    train: DataFrame  # balanced train: doc_id, label, bucket, _id, copy, position (shuffled order)
    test: DataFrame  # doc_id, label, bucket, _id, copy = 0, position (shuffled order)

    def summary(self, progress: DataFrame | None = None) -> DataFrame:
        return split_summary(self.split, self.train, progress=progress)


def labelled_dataset(spark: SparkSession, sf_dir: str | None, test_ratio: float = DEFAULT_TEST_RATIO,
                     seed: int = DEFAULT_SEED, materialize: bool = False, posts: DataFrame | None = None) -> LabelledDataset:
    """From the driver tables under ``sf_dir``, or from a table of ``posts``. ``materialize`` writes the split, then builds train and test from the written split and
    writes them too: each rank is computed once and later readers start from files."""
    posts = confirmed_only(scan_posts(spark, sf_dir) if posts is None else posts).select("doc_id", "label")
    split = stratified_split(class_bucket(posts), "bucket", ["doc_id"], test_ratio)
    if materialize:
        split = write_table(split, "dataset-split")
    train = shuffle_rows(balanced_train(split), seed)
    test = shuffle_rows(split.filter(F.col("split") == "test").withColumn("copy", F.lit(0)), seed)
    if materialize:
        train, test = write_table(train, "dataset-train"), write_table(test, "dataset-test")
    return LabelledDataset(split, train, test)


def observed_dataset(posts: DataFrame, test_ratio: float = DEFAULT_TEST_RATIO, seed: int = DEFAULT_SEED) -> tuple[LabelledDataset, DataFrame]:
    """The build over a table of all posts, unlabelled ones too, and the progress counts of that very build (S6): rows are counted by an
    ``Observation`` as they pass to the filter, so kept and seen cost no second reading."""
    progress = Observation("progress")
    counted = posts.select("doc_id", "label", "labeling_confirm").observe(progress, *progress_columns())
    kept = confirmed_only(counted).select("doc_id", "label")
    split = stratified_split(class_bucket(kept), "bucket", ["doc_id"], test_ratio)
    split = write_table(split, "dataset-split")
    train = write_table(shuffle_rows(balanced_train(split), seed), "dataset-train")
    test = write_table(shuffle_rows(split.filter(F.col("split") == "test").withColumn("copy", F.lit(0)), seed), "dataset-test")
    found = progress.get
    row = [(found["kept_all"], found["kept_confirmed"], found["seen"])]
    return LabelledDataset(split, train, test), posts.sparkSession.createDataFrame(row, "kept_all long, kept_confirmed long, seen long")


def all_data_split(spark: SparkSession, sf_dir: str, test_ratio: float = DEFAULT_TEST_RATIO,
                   seed: int = DEFAULT_SEED) -> DataFrame:
    """The all-data path: every labelled post, shuffled and split 75/25."""
    posts = drop_unlabelled(scan_posts(spark, sf_dir, include_unlabelled=True)).select("doc_id", "label")
    return random_split(posts, test_ratio, seed)


def with_text(df: DataFrame, spark: SparkSession, sf_dir: str, out: str = "text") -> DataFrame:
    """Join the document text by ``doc_id`` (a unique key: no skew). Texts whose id ``df`` cannot have are
    dropped next to the scan, by bitmaps of fixed size, so the shuffle carries little but the texts asked for."""
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias(out)))
    return df.join(likely_in(docs, df, "doc_id"), "doc_id", "inner")


def with_post_text(df: DataFrame, posts: DataFrame, out: str = "text") -> DataFrame:
    """The same for a table of posts."""
    docs = posts.select("doc_id", F.col("string").alias(out))
    return df.join(likely_in(docs, df, "doc_id"), "doc_id", "inner")

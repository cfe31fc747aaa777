"""Inference (lifecycle C): a test file -> clean -> score -> purify -> report lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toxscan.functions.text import format_report
from toxscan.operators.purify import purify
from toxscan.operators.scorer import AdditiveScorer
from toxscan.sources.files import head_sample, read_dataset


def moderate(df: DataFrame, scorer: AdditiveScorer, id_col: str = "doc_id", text_col: str = "text",
             keep=("label",), partitioned: bool = False) -> DataFrame:
    """Purified documents with first-pass probabilities and a report line. ``partitioned=True`` for
    documents bucketed by the id (``session.bucket_by_doc``): the whole job runs without an exchange."""
    out = purify(df, scorer, id_col, text_col, keep=list(keep), partitioned=partitioned)
    if "label" in keep:
        out = out.withColumn("report", format_report("label", "pred", "p0", "p1"))
    return out


def moderate_file(spark: SparkSession, path: str, scorer: AdditiveScorer, n: int | None = None) -> DataFrame:
    """Read a dataset file (``_id, document, label``), and moderate all rows, or the first ``n`` in
    file order."""
    df = read_dataset(spark, path)
    if n is not None:
        df = head_sample(df, n, "_id")
    return moderate(df.select(F.col("_id").alias("doc_id"), F.col("document").alias("text"), "label"), scorer)

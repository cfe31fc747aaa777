"""The corpus pipeline: from ``documents`` to packed sequences, each stage by one operator.

A stage gets the documents its predecessor kept and returns those it keeps itself, with the columns of
``documents``; the last returns the pieces of packed sequences. ``run`` writes each stage's result to the shared
folder and reads it again, so a lost executor repeats a part of one stage; a result is deleted when the next one is written.

Edge cases: a null or empty text is kept by the quality stage (there is nothing to judge), is one text to the exact stage (the
row with the least id stays, a null id last), has the fingerprint zero, matches no benchmark item, and is packed as its end id. Rows
that come again are copies: one stays. Ties are decided as each operator says. Extra columns, whatever their names, are carried up to the last
stage. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from toxscan.llm.common import table, written
from toxscan.llm.decontaminate import without_contaminated
from toxscan.llm.exact_dedup import without_copies
from toxscan.llm.packing import pack
from toxscan.llm.quality_lm import trusted_ids, without_rejected
from toxscan.llm.simhash import without_near_copies
from toxscan.session import discard, scratch_path


#: Fewer than packing alone keeps, and given up with each task: workers go on to serve other stages.
PACKING_SEGMENTS = 300_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_rejected(docs, trusted_ids(table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_copies(docs, words=4, distance=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, cache_segments=PACKING_SEGMENTS, keep_segments=False)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL cannot express the quality, near-dedup and packing stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        docs = written(stage(spark, docs, sf_dir), "", path=path)
        if before is not None:
            discard(spark, before)
        before = path
    return docs

"""Moderation and progress counts as Structured Streaming queries.

X1 runs the batch ``purify`` inside ``foreachBatch``: its per-document windows are not allowed
directly on a stream (only time windows are), and each document arrives whole in one micro-batch,
so the batch result per micro-batch is the streaming result. Each micro-batch is written to its own
``batch_id=N`` folder with overwrite, so a replayed batch after a failure rewrites the same files
(exactly-once output with the checkpointed offsets).

``moderate_stream_direct`` is X1 without ``foreachBatch``: an append-mode plan without state, each document moderated inside its
row by the batch model of ``purify_with_model``, into Spark's own file sink, whose commit log makes a replayed batch count once.

X2 keeps running counts per label with a stream-static join and a complete-mode aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toxscan.operators.purify import purify, purify_with_model
from toxscan.operators.scorer import AdditiveModelLoader, AdditiveScorer
from toxscan.plans import artifacts
from toxscan.plans.dataset import with_text
from toxscan.session import read_table, scratch_path
from toxscan.sources.posts import kept_confirmed

MODERATED_SCHEMA = "doc_id long, label int, p0 double, p1 double, pred int, text string, n_masked long, final_score double"


def moderate_stream(source: DataFrame, scorer: AdditiveScorer, sink_path: str, checkpoint: str,
                    keep=("label",), available_now: bool = True):
    """Start the moderation stream over ``source`` (``doc_id, text, *keep``); returns the query."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = purify(batch, scorer, keep=list(keep))
        out.write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")

    writer = source.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def moderate_stream_direct(source: DataFrame, load_model, sink_path: str, checkpoint: str, keep=("label",),
                           keep_schema: str = "label int", available_now: bool = True):
    """Start a moderation stream with a model of batches over ``source`` (``doc_id, text, *keep``); returns the query. Started
    again with the same ``checkpoint`` it goes on behind the last batch that the sink has committed."""
    out = purify_with_model(source, load_model, keep=list(keep), keep_schema=keep_schema)
    writer = out.writeStream.format("parquet").outputMode("append").option("path", sink_path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="0 seconds")
    return writer.start()


#: Files of one micro-batch: enough for every task slot of a large job to have some.
FILES_PER_BATCH = 256


def _stage(df: DataFrame, name: str, files: int | None) -> str:
    """Write ``df`` as the stream's input folder, in its own partitions (or as ``files`` files)."""
    path = scratch_path(df.sparkSession, name)
    (df if files is None else df.repartition(files)).write.parquet(path)
    return path


def stream_moderate_test(spark: SparkSession, sf_dir: str, files: int | None = None,
                         files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The test split streamed, ``files_per_batch`` files a micro-batch; returns the sink."""
    ds = artifacts.dataset(spark, sf_dir)
    staged = _stage(with_text(ds.test, spark, sf_dir).select("doc_id", "label", "text"), "stream-in", files)
    source = (spark.readStream.schema("doc_id long, label int, text string")
              .option("maxFilesPerTrigger", files_per_batch).parquet(staged))
    sink, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    q = moderate_stream(source, artifacts.scorer(spark, sf_dir), sink, ckpt)
    q.awaitTermination()
    return spark.read.schema(MODERATED_SCHEMA).parquet(sink).select(*[c.split()[0] for c in MODERATED_SCHEMA.split(", ")])


def stream_moderate_direct(spark: SparkSession, sf_dir: str, files: int | None = None,
                           files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The test split through ``moderate_stream_direct``; returns the sink."""
    ds = artifacts.dataset(spark, sf_dir)
    staged = _stage(with_text(ds.test, spark, sf_dir).select("doc_id", "label", "text"), "direct-in", files)
    source = (spark.readStream.schema("doc_id long, label int, text string")
              .option("maxFilesPerTrigger", files_per_batch).parquet(staged))
    sink, ckpt = scratch_path(spark, "direct-out"), scratch_path(spark, "direct-ckpt")
    loader = AdditiveModelLoader(artifacts.scorer_path(spark, sf_dir), token_model=True)
    moderate_stream_direct(source, loader, sink, ckpt).awaitTermination()
    return spark.read.schema(MODERATED_SCHEMA).parquet(sink).select(*[c.split()[0] for c in MODERATED_SCHEMA.split(", ")])


def stream_progress(spark: SparkSession, sf_dir: str, files: int | None = None,
                    files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Running counts per label (``-1`` = unlabelled) over the document stream: rows ``seen`` and rows ``kept`` by the
    labelled path; returns the final complete-mode state ``(label, seen, kept)``."""
    staged = _stage(read_table(spark, sf_dir, "documents").select("doc_id"), "progress-in", files)
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    docs = spark.readStream.schema("doc_id long").option("maxFilesPerTrigger", files_per_batch).parquet(staged)
    posts = docs.join(labels, "doc_id", "left").select(
        F.coalesce(F.col("toxic"), F.lit(-1)).cast("int").alias("label"),
        F.coalesce(F.col("quality"), F.lit(0)).alias("labeling_confirm"))
    counts = posts.groupBy("label").agg(F.count(F.lit(1)).alias("seen"), F.count_if(kept_confirmed()).alias("kept"))
    sink, ckpt = scratch_path(spark, "progress-out"), scratch_path(spark, "progress-ckpt")

    def write_state(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    q = (counts.writeStream.outputMode("complete").foreachBatch(write_state)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(sink)

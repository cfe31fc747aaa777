"""Exact dedup: stateful streaming deduplication, DataFrame and SQL functions only.

Texts are equal when they are identical without white space (space, U+0009 to U+000D). The steps:

1. *Records.* One narrow row per input row: id, digest of the normalised text, length of the original,
   content locator (file and row in it; an input that is no scan is written first). They are written to the shared folder.
2. *State.* A Structured Streaming job reads the records in micro-batches into a keyed state on disk
   (RocksDB, checkpointed in the shared folder, no watermark, so nothing expires). By digest it holds the
   number of rows and the row that stays so far: most code points, then smallest id, with its locator. Each
   micro-batch writes the keys it changed to its own folder, which a replay overwrites. The last change of a
   key is its final state.
3. *Hits.* Every row whose digest is held more than once is compared, all of its normalised bytes, with the
   text at the locator. Rows that differ (a digest that clashes) are grouped by their full text instead.

Texts that are held once don't move: bitmaps of fixed size tell which digests may be held more often. The state is
partially aggregated before its shuffle, so a text that a third of the rows share sends one
row a task. In step 3 the kept text of a group of ``LARGE`` rows or more is copied over ``salts`` keys and the hits are dealt over them, so no
task gets a whole large group. Nothing of the corpus goes to the driver but two counts.

Edge cases: a null text counts as empty, and empty texts equal each other and texts of white space alone.
A null id sorts after all others. Ids are integers of any width; others are an error. Of rows that tie in length and id, the one with the
greatest locator stays, so repeated rows give one row that stays and copies with the same ``keep_id``. An empty table
gives an empty result. Result columns come first; columns of the input are not carried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toxscan.llm.common import SPACE_CLASS, anchored, quoted, unused, written
from toxscan.operators.joins import likely_in, mark_likely
from toxscan.session import scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State store settings of the streaming job: on disk, memory of all stores of an executor bounded.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKS,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.compactOnCommit": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each partition reserves megabytes
}
SALTS = 16
#: Rows of a digest from which on its hits are dealt over salts; smaller groups meet under one.
LARGE = 1000


def normalised(c: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), SPACE_CLASS + "+", "")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def located(df: DataFrame, name: str = "_at") -> DataFrame:
    """``df``, a scan, with a column ``name``: the file of each row and its place in the file."""
    place = df.metadataColumn("_metadata")
    return df.withColumn(name, F.struct(place["file_path"].alias("file"), place["row_index"].alias("row")))


def records(df: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return located(df).select(
        F.col(id_col).alias("id"), digest(normalised(text_col)).alias("digest"),
        F.length(text).cast("long").alias("n_chars"), F.col("_at").alias("at"))


def _stays() -> Column:
    """Greatest for the row that stays: more code points, then smaller id, then greater locator."""
    return F.struct(
        F.col("n_chars"), F.col("id").isNotNull().alias("has_id"), F.bitwise_not("id").alias("least_id"), F.col("id"), F.col("at"))


def run_state(spark: SparkSession, path: str, schema, checkpoint: str, out: str, files_per_batch: int) -> DataFrame:
    """Run the records under ``path`` through the keyed state and return its final content: ``digest``,
    ``group_size``, ``keep``. A later call with the same ``checkpoint`` and ``out`` goes on from there: it
    reads only record files that came since."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        held = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
                .groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(_stays()).alias("keep")))

        def changed(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = (held.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).foreachBatch(changed).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    changes = spark.read.schema(held.schema).parquet(out)
    return changes.groupBy("digest").agg(F.max(F.struct("group_size", "keep")).alias("s")).select(
        "digest", "s.group_size", "s.keep")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000,
                salts: int = SALTS) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, and
    the locator ``file``, ``row``."""
    spark = df.sparkSession
    df = anchored(df, id_col, text_col)
    path = scratch_path(spark, "exact-dedup-records")
    rows = written(records(df, id_col, text_col, digest), "", path=path)
    if not rows.head(1):
        state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(_stays()).alias("keep"))
    else:
        state = written(run_state(spark, path, rows.schema, scratch_path(spark, "exact-dedup-checkpoint"),
                                  scratch_path(spark, "exact-dedup-changes"), files_per_batch), "exact-dedup-state")
    hit = state.filter("group_size > 1")
    texts = located(df).select(
        F.col("_at").alias("at"), normalised(text_col).alias("body")).withColumn("digest", digest(F.col("body")))
    texts = likely_in(texts, hit.select("digest"), "digest")
    # Bitmaps tell which digests are dealt over salts: those of large groups and, by clashes, a few others; both sides ask the same.
    large = hit.filter(F.col("group_size") >= LARGE).select("digest")
    texts = mark_likely(texts, large, "digest", "dealt").withColumn(
        "salt", F.when(F.col("dealt"), F.pmod(F.xxhash64("at"), F.lit(salts))).otherwise(0).cast("int")).drop("dealt")
    every_salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    keyed = mark_likely(hit, large, "digest", "dealt").select(
        "digest", F.col("keep.at").alias("keep_at"), F.when(F.col("dealt"), salts).otherwise(1).alias("salts"))
    hits = texts.join(keyed.select("digest", "keep_at", "salts", every_salt), ["digest", "salt"])
    kept_text = hits.filter(F.col("at") == F.col("keep_at")).select("digest", F.col("body").alias("kept_body"), every_salt)
    clash = written(hits.filter(F.col("at") != F.col("keep_at")).join(kept_text, ["digest", "salt"])
                    .filter(F.encode("body", "utf-8") != F.encode("kept_body", "utf-8"))
                    .select("digest").distinct(), "exact-dedup-clashes")

    joined = rows.join(state, "digest")
    if clash.head(1):
        sound = joined.join(clash, "digest", "left_anti")
        joined = sound.unionByName(_by_full_text(df, rows, clash, text_col))
    same = F.col("at") == F.col("keep.at")
    sha = F.col("digest") if digest is sha256 else F.col("sha")
    if digest is not sha256:
        true_sha = located(df).select(F.col("_at").alias("at"), sha256(normalised(text_col)).alias("sha"))
        joined = joined.join(true_sha, "at")
    return joined.select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"),
                         F.col("group_size").cast("long").alias("group_size"), same.alias("kept"),
                         sha.alias("text_sha256"), F.col("at.file").alias("file"), F.col("at.row").alias("row"))


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, all columns."""
    df = anchored(df, *df.columns)
    at = unused(df, "_at")
    gone = exact_dedup(df, id_col, text_col).filter(~F.col("kept")).select(F.struct("file", "row").alias(at))
    return located(df, at).join(gone, at, "left_anti").select(*[F.col(quoted(c)) for c in df.columns])


def _by_full_text(df: DataFrame, rows: DataFrame, clash: DataFrame, text_col: str) -> DataFrame:
    """The rows of clashing digests, grouped by their whole normalised text."""
    bodies = located(df).select(F.col("_at").alias("at"), normalised(text_col).alias("body"))
    members = rows.join(clash, "digest").join(bodies, "at")
    groups = members.groupBy("body").agg(F.count(F.lit(1)).alias("group_size"), F.max(_stays()).alias("keep"))
    return members.join(groups, "body").select(*rows.columns, "group_size", "keep")

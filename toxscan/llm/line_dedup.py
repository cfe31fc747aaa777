"""Line dedup over levelled sorted runs of line hashes, DataFrame and SQL functions only.

A line's key is the line without white space at both ends, A-Z in lower case; two 64-bit hashes stand for
it. ``LineRuns`` keeps what earlier batches held as sorted runs: tables bucketed and sorted by the hashes, so
that a batch meets the runs without an exchange of a run. A new batch is aggregated by key (partly before its shuffle) and merge-joined
with all runs. Keys that no run has are fresh (the anti-join); the others take over the number of documents and the greatest id that the runs
know of them and add their own. So a row of a run tells how matters stand after its batch, a key's verdict is that of its last batch, and
the batch is a run of level 0 itself. When a level has ``fan_out`` runs they are merged into one of the next.

``dedup_lines`` deals documents into batches by id, so that a document is in one batch, feeds the batches to
the runs, and takes from each what has reached ``min_docs`` documents. Such a key's lines go from every document but the
one with the greatest id. The records of lines tell row and place, so a row's lost places are gathered and its lines are gone
through once. A key that a third of the documents hold is one row a task after the partial aggregation; its lines meet the verdict
in a join that Spark splits when it is skewed.

Edge cases: a null or empty text is one empty line; keys of fewer than ``min_chars`` code points never count;
a key twice in a document counts once; rows with the same id are one document and lose the same lines; a
null id is no document of its own: its lines count for nothing, and it loses the lines of keys that go. An
empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toxscan.llm.common import anchored, written
from toxscan.session import scratch_path

HASHES = ["h1", "h2"]
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(c: str = "text") -> Column:
    return F.split(F.coalesce(F.col(c), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, LOWER)


def key_hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def line_records(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``doc``, ``row`` (a hash of the place in the files, for ids that come again), ``line`` (its number), ``h1``, ``h2``: one row for each line
    whose key counts. ``df`` is a scan."""
    keys = F.transform(lines_of(text_col), line_key)
    ex = df.select(F.col(id_col).alias("doc"), row_hash(df).alias("row"), F.posexplode(keys).alias("line", "key"))
    return (ex.filter(F.length("key") >= min_chars).withColumn("h", key_hashes(F.col("key")))
            .select("doc", "row", "line", "h.h1", "h.h2"))


def row_hash(df: DataFrame) -> Column:
    place = df.metadataColumn("_metadata")
    return F.xxhash64(place["file_path"], place["row_index"])


class LineRuns:
    """Levelled sorted runs. ``levels[i]`` lists the run tables of level i."""

    def __init__(self, spark: SparkSession, fan_out: int = 4):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self.schema = None

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def add(self, records: DataFrame) -> DataFrame:
        """Add a batch of ``doc``, ``h1``, ``h2``; return its run: ``n_docs`` and ``max_doc`` of each of its keys over all batches so far, and
        ``fresh``: no earlier run has the key."""
        batch = records.distinct().groupBy(*HASHES).agg(
            F.count("doc").alias("own_docs"), F.max("doc").alias("own_max"))
        tables = self.tables()
        for i, t in enumerate(tables):  # merge joins with the runs as they lie
            known = self.spark.table(t).select(*HASHES, F.col("n_docs").alias(f"n{i}"), F.col("max_doc").alias(f"max{i}"))
            batch = batch.join(known, HASHES, "left")
        # What is known of a key only grows from run to run, so the greatest is the last. ``greatest`` passes over nulls.
        known = [F.greatest(*[F.col(f"{c}{i}") for i in range(len(tables))], F.lit(None)) if tables else F.lit(None).cast("long") for c in ("n", "max")]
        batch = batch.withColumn("known_docs", known[0]).withColumn("known_max", known[1]).withColumn("fresh", F.col("known_docs").isNull())
        taken = F.when(F.col("fresh"), F.col("own_docs")).otherwise(F.col("own_docs") + F.col("known_docs"))
        run = self._run(batch.select(*HASHES, taken.alias("n_docs"), F.greatest("own_max", F.when(~F.col("fresh"), F.col("known_max"))).alias("max_doc"),
                                     "fresh"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        out = self.spark.read.schema(self.schema).parquet(self.paths[run])
        self._compact()
        return out

    def drop(self) -> None:
        for t in self.paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.paths, self.levels = {}, []

    def _compact(self) -> None:
        for i in range(64):
            if i >= len(self.levels) or len(self.levels[i]) < self.fan_out:
                return
            merged = self._run(self._merged(self.levels[i]))
            self.levels[i] = []
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(merged)

    def _merged(self, tables: list[str]) -> DataFrame:
        """The runs as one. They are read as plain files: Spark 4.1 gives wrong groups for a union of bucketed
        tables that it takes for partitioned, so the few numbers of a key meet in an exchange."""
        rows = self.spark.read.schema(self.schema).parquet(*[self.paths[t] for t in tables])
        merged = rows.groupBy(*HASHES).agg(F.max("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
        return merged.withColumn("fresh", F.lit(True))

    def _run(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, name)
        self.schema = self.schema or df.schema
        (df.write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES)
         .option("path", self.paths[name]).saveAsTable(name))
        return name


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 40,
                min_docs: int = 5, batches: int = 6, fan_out: int = 4) -> DataFrame:
    """Per row of ``df``: ``id_col``, ``kept`` (its lines that stay), ``n_lines``, ``n_dropped``."""
    spark = df.sparkSession
    df = anchored(df, id_col, text_col)
    records = line_records(df, id_col, text_col, min_chars).withColumn(
        "batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))
    records = written(records, "line-records", partition_by=["batch"])
    runs = LineRuns(spark, fan_out)
    passed = scratch_path(spark, "line-passed")
    try:
        for b in range(batches):
            run = runs.add(records.filter(F.col("batch") == b).select("doc", *HASHES))
            run.filter(F.col("n_docs") >= min_docs).select(*HASHES, "n_docs", "max_doc").write.mode("overwrite").parquet(f"{passed}/after={b}")
        verdicts = spark.read.schema(runs.schema).parquet(passed)
        going = written(verdicts.groupBy(*HASHES).agg(F.max("max_doc").alias("max_doc")), "line-verdicts")
    finally:
        runs.drop()

    lost = (records.join(going, HASHES).filter(~F.col("doc").eqNullSafe(F.col("max_doc")))
            .groupBy("doc", "row").agg(F.collect_list("line").alias("lost")))
    docs = df.select(F.col(id_col).alias("_id"), row_hash(df).alias("_row"), F.col(text_col).alias("_text"))
    same = docs["_id"].eqNullSafe(lost["doc"]) & (docs["_row"] == lost["row"])
    joined = docs.join(lost, same, "left").select("_id", lines_of("_text").alias("lines"), "lost")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    kept = F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.transform(places, lambda i: F.col("lines")[i]))
    return (joined.select("_id", "lines", kept.alias("kept"))
            .select(F.col("_id").alias(id_col), F.col("kept"), F.size("lines").cast("long").alias("n_lines"),
                    (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped")))

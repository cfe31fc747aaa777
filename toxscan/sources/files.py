"""Dataset files and line sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toxscan.functions.text import lines, rstrip_unicode
from toxscan.session import write_table
from toxscan.sources.splitcsv import read_split

DATASET_COLUMNS = ("_id", "document", "label")


def dataset_separator(path: str) -> str:
    """Dispatch on the path suffix: ``csv`` is comma separated, ``tsv`` and ``txt`` tab separated."""
    p = path.rstrip("/")
    if p.endswith("csv"):
        return ","
    if p.endswith("tsv") or p.endswith("txt"):
        return "\t"
    raise ValueError(f"{path}: a dataset file ends in csv, tsv or txt")


def _csv_options(sep: str) -> dict:
    # Quotes are escaped by doubling; values with separators, quotes or line breaks are quoted, so
    # multi-line documents survive. '' is written as a quoted empty field and null as an unquoted
    # empty field; the reader has no null marker (nullValue unset), which keeps the two apart.
    return {"header": "true", "sep": sep, "quote": '"', "escape": '"', "multiLine": "true"}


def _task_bytes(spark: SparkSession) -> int:
    """What one task reads of a file."""
    told = spark.conf.get("spark.sql.files.maxPartitionBytes")
    return spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(told)


def _has_large_file(spark: SparkSession, path: str) -> bool:
    """Whether a file is larger than what one task reads. Only lengths are listed, no content is read."""
    return (spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0] or 0) > _task_bytes(spark)


def in_few_files(df: DataFrame, text_col: str = "document") -> DataFrame:
    """``df``, written once, in as few partitions as give files of about twice a task's share at most: one, unless it is larger."""
    staged = write_table(df, "dataset-staged")
    total = staged.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = -(-total // (2 * _task_bytes(df.sparkSession)))
    return staged.repartition(n, F.xxhash64(*df.columns)) if n > 1 else staged.coalesce(1)


def read_dataset(spark: SparkSession, path: str, split: bool | None = None) -> DataFrame:
    """``(_id, document, label)`` from a dataset file, by the names in its header, in whatever order; other columns
    are ignored. ``document`` and ``label`` must be there; without ``_id`` it is null. A cell of the wrong type
    is an error.

    Spark reads a file with multi-line records in one task. A file larger than one task's share (or any, if ``split``) is
    read in blocks instead (``splitcsv``), with the same rows for files whose quotes are balanced."""
    options = _csv_options(dataset_separator(path))
    header = spark.read.options(**options).csv(path).columns
    if missing := [c for c in ("document", "label") if c not in header]:
        raise ValueError(f"{path}: the header lacks {', '.join(missing)}")
    kinds = {"_id": T.LongType(), "label": T.IntegerType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in header])
    if _has_large_file(spark, path) if split is None else split:
        rows = read_split(spark, path, schema, options)
    else:
        rows = spark.read.schema(schema).options(**options, mode="FAILFAST", enforceSchema="false").option("nullValue", None).csv(path)
    if "_id" not in header:
        rows = rows.withColumn("_id", F.lit(None).cast("long"))
    return rows.select(*DATASET_COLUMNS)


def write_dataset(df: DataFrame, path: str, columns=DATASET_COLUMNS) -> None:
    """S3: header, ``_id`` index column first; overwrite (a retried job rewrites the same output)."""
    opts = _csv_options(dataset_separator(path))
    opts.update({"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    df.select(*columns).write.mode("overwrite").options(**opts).csv(path)


def read_line_set(spark: SparkSession, path: str) -> DataFrame:
    """One item per line, right-stripped, de-duplicated (an empty line gives '')."""
    return spark.read.text(path).select(rstrip_unicode("value").alias("item")).distinct()


def line_set(df: DataFrame, text_col: str = "text") -> DataFrame:
    """S4 over a text column: every line of every text, right-stripped, de-duplicated. The distinct
    is a partially aggregated shuffle, so a line repeated in many texts is combined map-side."""
    items = df.select(F.explode_outer(lines(text_col)).alias("item")).filter(F.col("item").isNotNull())
    return items.select(rstrip_unicode("item").alias("item")).distinct()


def head_sample(df: DataFrame, n: int = 100, order_by: str = "position") -> DataFrame:
    """The first ``n`` rows in file order (the shuffled ``position``). A top-n: each task keeps
    its own first ``n`` before one small merge."""
    return df.orderBy(order_by).limit(n)

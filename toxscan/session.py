"""Session creation and the shared folder used for written tables and stream checkpoints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None, app: str = "toxscan",
              extra_conf: dict | None = None) -> SparkSession:
    """A session with the settings the library relies on (AQE with skew-join splitting, UTC, no UI).

    Master, memory and the number of shuffle partitions are those of spark-submit; a caller on one machine may
    give the last here, and driver memory in ``TOXSCAN_DRIVER_MEMORY``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory := os.environ.get("TOXSCAN_DRIVER_MEMORY"):
        builder = builder.config("spark.driver.memory", memory)
    for key, value in (extra_conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    It is read from the session; only when it is unset on one machine (local tests) a folder of our own is created
    and registered, so that ``DataFrame.checkpoint`` and written tables land in one place. On a cluster an unset
    folder is an error: no executor could read what another wrote.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc._jsc.sc().isLocal():
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="toxscan-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/toxscan/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared folder and read it back.

    Cuts the lineage (a lost executor re-reads the files instead of recomputing the plan) and gives
    the optimizer exact sizes for the next join.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Delete what this application wrote under the shared folder for its own use. Call it when the results
    that read it are written."""
    for t in spark.catalog.listTables():
        if t.name.startswith("toxscan_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/toxscan")
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that is no longer read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition ``df`` (by ``keys`` when given) only when it has fewer partitions than the
    cluster has task slots, e.g. a text table stored as one large row group. A scan of a large
    table already has thousands of partitions and is returned unchanged (no extra shuffle).

    Apply it to a file scan only: the partition count of a plan with a shuffle is known only after
    AQE has run that shuffle, so asking for it would execute part of the plan."""
    spark = df.sparkSession
    if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism:
        return df
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys) if keys else df.repartition(n)


def bucket_by_doc(df: DataFrame, name: str, buckets: int | None = None, key: str = "doc_id") -> DataFrame:
    """Write ``df`` once as a table bucketed (and sorted) by ``key`` in the shared folder and return
    its scan. The scan reports hash partitioning on ``key``, so per-document windows, aggregates
    and joins on ``key`` run without any exchange; every later per-document job reuses the one
    write instead of shuffling the text again."""
    spark = df.sparkSession
    n = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    table = "toxscan_" + "".join(ch if ch.isalnum() else "_" for ch in name) + "_" + uuid.uuid4().hex[:12]
    (df.write.mode("overwrite").bucketBy(n, key).sortBy(key)
       .option("path", scratch_path(spark, name)).saveAsTable(table))
    return spark.table(table)


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a scan of files with filters and projections at most: each row lies at one place in a file, and two readings
    deal the rows out alike."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName().startswith("LogicalRelation") or node.nodeName().startswith("Relation")


_shipped: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (what ``--py-files`` does on submit): zip it once per application in
    a temporary folder of the driver and add it to the context, which sends it to the executors."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    import shutil

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="toxscan-zip-")
    archive = shutil.make_archive(os.path.join(staging, "toxscan"), "zip", os.path.dirname(pkg_dir), "toxscan")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

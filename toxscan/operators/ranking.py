"""Exact 0-based positions without a single-task window.

Positional slicing (``df[:n]``) needs the exact position of every row in a total order.
``row_number()`` over a whole table (or over two classes) runs in one or two tasks. Instead:

1. range-partition on (group, order keys) and sort inside each partition: partition ``p`` holds a
   contiguous slice of the order;
2. the row number inside the partition comes from ``monotonically_increasing_id`` minus the
   partition's base (it is deterministic because the sort keys are unique);
3. these numbered rows are written once to the shared folder. Partition ids are only meaningful
   inside one read of the shuffle (AQE may coalesce two reads of the same exchange differently),
   so the offsets and the final join must both start from the same written rows;
4. a small table of per-(partition, group) counts gives each partition's offset through a running
   sum. It has at most ``partitions x groups`` rows; it is written too, so that Spark knows its size and
   broadcasts it back only below its own threshold.

The order keys must be unique within a group, so that a retried task rebuilds the same positions.
Pass narrow frames (ids and keys): every column is written once. An input with a shuffle of its own is written before
the range exchange too, which samples its input and so would run it twice.

``scan_rank`` numbers rows as they lie in files: no row moves and nothing is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from toxscan.session import is_scan, write_table

_ROW_BITS = 33  # monotonically_increasing_id = partition index << 33 | row number in partition


def exact_rank(
    df: DataFrame,
    order_by: Sequence,
    partition_by: Sequence[str] = (),
    rank_col: str = "rank",
    count_col: str | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``rank_col`` = 0-based position by ``order_by`` inside each ``partition_by`` group and,
    optionally, ``count_col`` = the group size. ``partition_by`` must be low-cardinality (a class
    label); for many small groups use ``row_number`` over a window."""
    groups = list(partition_by)
    if not is_scan(df):
        df = write_table(df, "exact-rank-input")
    keys = [F.col(c) for c in groups] + [F.col(c) if isinstance(c, str) else c for c in order_by]
    # Without an explicit count the range exchange uses spark.sql.shuffle.partitions and AQE may
    # coalesce neighbouring ranges; the numbering below is written once, so that is safe.
    by_range = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    ranged = (
        by_range
        .sortWithinPartitions(*keys)
        .withColumn("_rk_pid", F.spark_partition_id())
        .withColumn(
            "_rk_row",
            F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), _ROW_BITS),
        )
    )
    ranged = write_table(ranged, "exact-rank")
    stats = ranged.groupBy("_rk_pid", *groups).agg(
        F.count(F.lit(1)).alias("_rk_n"), F.min("_rk_row").alias("_rk_first")
    )
    before = Window.partitionBy(*groups).orderBy("_rk_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_rk_offset", F.coalesce(F.sum("_rk_n").over(before), F.lit(0)))
    if count_col:
        stats = stats.withColumn("_rk_total", F.sum("_rk_n").over(Window.partitionBy(*groups)))
    stats = stats.select(
        F.col("_rk_pid").alias("_rk_spid"),
        *[F.col(g).alias(f"_rk_g{i}") for i, g in enumerate(groups)],
        "_rk_offset",
        "_rk_first",
        *(["_rk_total"] if count_col else []),
    )
    cond = [F.col("_rk_pid") == F.col("_rk_spid")] + [
        F.col(g).eqNullSafe(F.col(f"_rk_g{i}")) for i, g in enumerate(groups)
    ]
    joined = ranged.join(write_table(stats, "exact-rank-offsets"), cond, "inner")
    rank = (F.col("_rk_offset") + F.col("_rk_row") - F.col("_rk_first")).cast("long").alias(rank_col)
    extra = [F.col("_rk_total").cast("long").alias(count_col)] if count_col else []
    return joined.select(*[F.col(c) for c in df.columns], rank, *extra)


MAX_CLASSES = 1000


def scan_rank(scan: DataFrame, per: str | None = None, rank_col: str = "rank", count_col: str | None = None) -> DataFrame:
    """Add ``rank_col``: the 0-based place of a row in input order (files by path, rows as they lie), in each class of ``per`` if
    given, and optionally ``count_col``, the number of rows of its class.

    ``scan`` is a scan of files with filters and projections. Each task numbers the rows of its blocks of files as it reads them,
    a class at a time (a class is one filtered reading, at most ``MAX_CLASSES``); these rows are written once. A table with
    one row a block and class gives the number of rows before each block. Pass narrow frames."""
    if not is_scan(scan):
        raise ValueError("scan_rank: the input is no plain scan of files")
    if per is None:
        parts = [scan]
    else:
        classes = [r[0] for r in scan.select(per).distinct().limit(MAX_CLASSES + 1).collect()]
        if len(classes) > MAX_CLASSES:
            raise ValueError(f"scan_rank: more than {MAX_CLASSES} classes")
        parts = [scan.filter(F.col(per).eqNullSafe(F.lit(c))) for c in classes]
    place = [F.col("_metadata.file_path").alias("_sr_file"), F.col("_metadata.file_block_start").alias("_sr_block"),
             F.monotonically_increasing_id().alias("_sr_row")]
    parts = [p.select(*scan.columns, *place) for p in parts] or [scan.filter(F.lit(False)).select(*scan.columns, *place)]
    numbered = parts[0]
    for p in parts[1:]:
        numbered = numbered.unionAll(p)
    numbered = write_table(numbered, "scan-rank")
    groups = ["_sr_file", "_sr_block", *([per] if per else [])]
    stats = numbered.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.min("_sr_row").alias("_first"))
    of_class = Window.partitionBy(*([per] if per else []))
    before = of_class.orderBy("_sr_file", "_sr_block").rowsBetween(Window.unboundedPreceding, -1)
    stats = write_table(stats.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_first",
                                     F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                                     F.sum("_n").over(of_class).alias("_total")), "scan-rank-offsets")
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    total = [F.col("_total").alias(count_col)] if count_col else []
    return numbered.join(stats, same, "inner").select(
        *scan.columns, (F.col("_before") + F.col("_sr_row") - F.col("_first")).cast("long").alias(rank_col), *total)

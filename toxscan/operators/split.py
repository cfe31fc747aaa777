"""Splits, oversampling, union, shuffle and the split summary.

Positional slices of the reference (``df[:n]``) become comparisons with an exact rank (R7).
Unseeded shuffles become an order by ``md5(seed:keys)``: reproducible, and a retried task gives the
same rows. The forms in file order (``*_scan``) and by a keyed permutation (``*_permuted``) neither sort nor exchange rows:
a row's place comes from where it lies, its shuffled position from its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toxscan.functions.permute import permuted
from toxscan.operators.ranking import exact_rank, scan_rank

DEFAULT_SEED = 42
DEFAULT_TEST_RATIO = 0.25


def shuffle_key(seed: int, *cols) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def _n_train(count_col: str, test_ratio: float) -> Column:
    return F.floor(F.col(count_col) * F.lit(1.0 - test_ratio)).cast("long")


def random_split(df: DataFrame, test_ratio: float = DEFAULT_TEST_RATIO, seed: int = DEFAULT_SEED,
                 key_cols: Sequence[str] = ("doc_id",), out: str = "split") -> DataFrame:
    """Shuffle everything, the first ``int(n * (1 - test_ratio))`` rows are train."""
    keyed = df.withColumn("_skey", shuffle_key(seed, *key_cols))
    ranked = exact_rank(keyed, ["_skey", *key_cols], rank_col="_srank", count_col="_sn")
    return ranked.withColumn(
        out, F.when(F.col("_srank") < _n_train("_sn", test_ratio), F.lit("train")).otherwise(F.lit("test"))
    ).drop("_skey", "_srank", "_sn")


def stratified_split(df: DataFrame, class_col: str = "bucket", order_by: Sequence[str] = ("doc_id",),
                     test_ratio: float = DEFAULT_TEST_RATIO, out: str = "split", rank_col: str = "_id") -> DataFrame:
    """R2: per class, in input order (no shuffle first), the first ``int(n_c * (1 - test_ratio))``
    rows are train. ``rank_col`` keeps the 0-based position inside the class."""
    ranked = exact_rank(df, list(order_by), [class_col], rank_col=rank_col, count_col="_sn")
    return ranked.withColumn(
        out, F.when(F.col(rank_col) < _n_train("_sn", test_ratio), F.lit("train")).otherwise(F.lit("test"))
    ).drop("_sn")


def random_split_permuted(scan: DataFrame, test_ratio: float = DEFAULT_TEST_RATIO, seed: int = DEFAULT_SEED,
                          out: str = "split", position_col: str = "position") -> DataFrame:
    """R1 over a scan of files: the position in a random order is computed from the place in the files."""
    placed = scan_rank(scan, rank_col="_place", count_col="_sn")
    n = (placed.agg(F.max("_sn")).first()[0]) or 0
    position = permuted(F.col("_place"), n, seed)
    return placed.select(*scan.columns, position.alias(position_col), "_sn").withColumn(
        out, F.when(F.col(position_col) < _n_train("_sn", test_ratio), F.lit("train")).otherwise(F.lit("test"))).drop("_sn")


def stratified_split_scan(scan: DataFrame, class_col: str = "bucket", test_ratio: float = DEFAULT_TEST_RATIO, out: str = "split",
                          rank_col: str = "_id") -> DataFrame:
    """R2 over a scan of files, in the order in which its rows lie."""
    ranked = scan_rank(scan, class_col, rank_col=rank_col, count_col="_sn")
    return ranked.withColumn(
        out, F.when(F.col(rank_col) < _n_train("_sn", test_ratio), F.lit("train")).otherwise(F.lit("test"))).drop("_sn")


def shuffle_permuted(balanced: DataFrame, n_major: int, n_minor: int, seed: int = DEFAULT_SEED, class_col: str = "bucket",
                     rank_col: str = "_id", copy_col: str = "copy", out: str = "position") -> DataFrame:
    """R5 of a balanced train table: majority rows lie at ``0..n_major-1`` by their rank, minority rows behind them by copy and
    rank, as the union has them; the shuffled position is a permutation of these places, computed by row. ``n_major`` and
    ``n_minor`` count the train rows of each class before oversampling."""
    place = F.when(F.col(class_col) == 0, F.col(rank_col)).otherwise(
        F.lit(n_major).cast("long") + F.col(copy_col).cast("long") * F.lit(n_minor).cast("long") + F.col(rank_col))
    return balanced.withColumn(out, permuted(place, 2 * n_major, seed))


def class_counts(df: DataFrame, class_col: str = "bucket") -> dict[int, int]:
    """Row count per class: a few scalars, read on the driver."""
    return {r[0]: r[1] for r in df.groupBy(class_col).count().collect()}


def oversample(train: DataFrame, class_col: str = "bucket", rank_col: str = "_id", copy_col: str = "copy",
               majority: int = 0, minority: int = 1) -> DataFrame:
    """The minority class repeated ``ratio = n0 // n1 + 1`` times, then cut to ``n0`` rows.

    The repeated frame is copy 0 in input order, then copy 1, ...; a row at 0-based position ``r``
    in copy ``c`` is kept when ``c * n1 + r < n0``. ``rank_col`` must hold the position inside the
    minority class (``stratified_split`` provides it). When ``n1 > n0`` the ratio is 1 and the class
    is cut to ``n0``. An empty minority class is an error.
    """
    counts = class_counts(train, class_col)
    n0, n1 = counts.get(majority, 0), counts.get(minority, 0)
    if n1 == 0:
        raise ValueError("oversample: the minority class has no training rows")
    ratio = n0 // n1 + 1
    rows = train.filter(F.col(class_col) == minority)
    rows = rows.withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.lit(ratio - 1).cast("int"))))
    return rows.filter(F.col(copy_col).cast("long") * F.lit(n1).cast("long") + F.col(rank_col) < F.lit(n0))


def union_classes(*frames: DataFrame) -> DataFrame:
    """Bag union by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def balanced_train(split_df: DataFrame, class_col: str = "bucket", rank_col: str = "_id", copy_col: str = "copy",
                   split_col: str = "split") -> DataFrame:
    """Train rows of the majority class (copy 0) plus the oversampled minority class."""
    train = split_df.filter(F.col(split_col) == "train")
    major = train.filter(F.col(class_col) == 0).withColumn(copy_col, F.lit(0))
    return union_classes(major, oversample(train, class_col, rank_col, copy_col))


def shuffle_rows(df: DataFrame, seed: int = DEFAULT_SEED, key_cols: Sequence[str] = ("doc_id", "copy"),
                 out: str = "position") -> DataFrame:
    """A random order, as an exact 0-based ``position`` by ``md5(seed:keys)``."""
    keyed = df.withColumn("_skey", shuffle_key(seed, *key_cols))
    return exact_rank(keyed, ["_skey", *key_cols], rank_col=out).drop("_skey")


def split_summary(split_df: DataFrame, balanced: DataFrame, class_col: str = "bucket",
                  split_col: str = "split", progress: DataFrame | None = None) -> DataFrame:
    """Rows per (split, class) for all, train, test and the balanced train table; with ``progress`` (from
    ``progress_counts``) also the rows ``kept`` and ``seen`` (no class)."""
    parts = [
        split_df.groupBy(F.lit("all").alias("split"), F.col(class_col).alias("bucket")).count(),
        split_df.groupBy(F.col(split_col).alias("split"), F.col(class_col).alias("bucket")).count(),
        balanced.groupBy(F.lit("train_balanced").alias("split"), F.col(class_col).alias("bucket")).count(),
    ]
    if progress is not None:
        told = F.explode(F.array(F.struct(F.lit("kept").alias("split"), F.col("kept_confirmed").alias("count")),
                                 F.struct(F.lit("seen").alias("split"), F.col("seen").alias("count"))))
        parts.append(progress.select(told.alias("x")).select("x.split", F.lit(None).cast("int").alias("bucket"), "x.count"))
    return union_classes(*parts).withColumnRenamed("count", "n")

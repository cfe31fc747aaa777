"""Helpers shared by the operators: tables, the shared folder, byte-balanced batches."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toxscan.session import is_scan, scratch_path, ship_package

#: White space of the contracts: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, *, path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as parquet in the shared folder, read back: lineage ends there, a lost executor re-reads
    the files, and the next join knows the size."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def python_ready(spark: SparkSession) -> None:
    """Make this package importable in Python workers."""
    ship_package(spark)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def anchored(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``df`` as a scan of Parquet files: ``df`` if it is one, with filters and projections at most, else it is written
    to the shared folder. So each row has a place in a file of its own, and two reads deal the rows out alike."""
    if is_scan(df):
        try:
            df.select(df.metadataColumn("_metadata")["row_index"])
            return df
        except AnalysisException:
            pass
    return written(df.select(*columns), "anchored")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it until ``df`` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: What Python workers keep from task to task, by operator, and how to give it up.
_kept: dict[str, Callable[[], None]] = {}


def keeps(operator: str, give_up: Callable[[], None] | None = None) -> None:
    """Tell, at the start of a task, that the worker now serves ``operator``: what it keeps for others goes, so the
    memory of a worker that serves one stage after another is that of the greatest stage, not of all."""
    for other in [k for k in _kept if k != operator]:
        _kept.pop(other)()
    if give_up is not None:
        _kept[operator] = give_up


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``task`` over Arrow batches; behind it the worker gives freed memory back to the machine. Spark keeps idle workers, and
    what their allocators hold counts against the executor while others run."""
    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Return freed memory of this worker to the machine, where its allocators can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def byte_batches(texts: Iterable[str], limit: int = 1 << 20, sizes: Iterable[int] | None = None) -> Iterator[list[str]]:
    """Consecutive texts in lists of about ``limit`` bytes, where ``sizes`` tells those of each, else characters, so that a
    list costs about the same whether it holds thousands of short texts or one long text."""
    batch: list[str] = []
    held = 0
    for t, n in zip(texts, sizes) if sizes is not None else ((t, len(t)) for t in texts):
        batch.append(t)
        held += n
        if held >= limit:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


class KeyFilter:
    """Which keys may be among a set: one bit for each of ``2**bits`` hash values. Its size is fixed, so it can
    be sent to every task whatever the set holds. A fuller filter lets more keys through that a join drops later;
    it never holds back a key of the set."""

    def __init__(self, keys: DataFrame, key_hash: Column, bits: int = 25):
        import numpy as np

        self.mask = np.uint64((1 << bits) - 1)
        spot = key_hash.bitwiseAND((1 << bits) - 1)
        maps = (keys.select(spot.alias("at")).groupBy(F.expr("bitmap_bucket_number(at + 1)").alias("k"))
                .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at + 1))").alias("bits")).collect())
        size = (1 << 15) // 8  # bytes of one of Spark's bitmaps
        self.held = np.zeros(max(1, (1 << bits) // 8 // size) * size, dtype=np.uint8)
        for k, found in maps:
            self.held[(k - 1) * size:k * size] = np.frombuffer(found, dtype=np.uint8)

    def may_hold(self, hashes):
        """By hash (any 64-bit integers): whether the set may have it."""
        import numpy as np

        at = hashes.view(np.uint64) & self.mask
        return (self.held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

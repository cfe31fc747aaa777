"""Lookup joins with a checked broadcast and a skew-safe fallback.

A lookup table (vocabulary, token weights, per-group statistics) is broadcast only after its size in
bytes is checked against a bound. Beyond the bound the join shuffles, and because a single key
(a very common token, one large group) may hold a large share of the probe rows, the probe side is
salted: each probe row gets one of ``salt_buckets`` salts from a hash of its row key, and the
lookup side is replicated once per salt. A hot key is then spread over ``salt_buckets`` tasks; AQE
skew-join splitting remains on for what is left.

For elements of rows (tokens of documents) against a table with frequencies, ``element_lookup`` splits the table
instead: its most frequent keys, as many as the bound allows, are broadcast, so their elements stay where their rows are. Of the
others, only the distinct keys of each row are shuffled, and none of them is frequent.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toxscan.session import write_table

DEFAULT_BROADCAST_MAX_BYTES = 64 << 20
#: Bits of a key filter: 256 bitmaps of 4 KB. Where the number of keys is known, eight bits a key, up to 64 MB.
FILTER_BITS, MAX_FILTER_BITS = 23, 29
DEFAULT_SALT_BUCKETS = 32


def _conf_int(df: DataFrame, key: str, default: int) -> int:
    return int(df.sparkSession.conf.get(key, str(default)))


def broadcast_bound(table: DataFrame, max_bytes: int | None = None) -> int:
    return _conf_int(table, "spark.toxscan.broadcastMaxBytes", DEFAULT_BROADCAST_MAX_BYTES) if max_bytes is None else max_bytes


def _width(table: DataFrame):
    """The bytes of a row of ``table``."""
    width = F.lit(16 + 8 * len(table.columns))
    for name, kind in table.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return width.cast("long")


def table_bytes(table: DataFrame) -> int:
    """All rows of a lookup table, at their widths. One aggregation over the table; one number reaches the driver."""
    return table.agg(F.sum(_width(table))).first()[0] or 0


def fits_broadcast(table: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether all rows of a lookup table, at their widths, lie below the bound."""
    return table_bytes(table) <= broadcast_bound(table, max_bytes)


def filter_bits(n_keys: int) -> int:
    """Bits for a filter of that many keys."""
    return min(MAX_FILTER_BITS, max(FILTER_BITS, math.ceil(math.log2(8 * n_keys + 1))))


def _filtered(df: DataFrame, keys: DataFrame, on: str, bits: int, how: str):
    """``df`` joined with the bitmaps of ``keys``, and whether ``on`` is marked there."""
    spot = F.xxhash64(on).bitwiseAND((1 << bits) - 1)
    maps = (keys.select(spot.alias("_p")).groupBy(F.expr("bitmap_bucket_number(_p + 1)").alias("_k"))
            .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_p + 1))").alias("_bits")))
    byte = "cast(conv(hex(substring(_bits, cast((_p % 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
    spotted = df.withColumn("_p", spot).withColumn("_k", F.expr("bitmap_bucket_number(_p + 1)"))
    return spotted.join(F.broadcast(maps), "_k", how), F.expr(f"shiftright({byte}, cast(_p % 8 as int)) & 1 = 1")


def mark_likely(df: DataFrame, keys: DataFrame, on: str, out: str, bits: int = FILTER_BITS) -> DataFrame:
    """``df`` and ``out``: whether ``on`` may be among ``keys``. Every task gets bitmaps of ``2**bits`` bits in all; the more
    keys, the more others pass. A row that matches always passes; a null never."""
    spotted, marked = _filtered(df, keys, on, bits, "left")
    return spotted.select(*df.columns, (F.coalesce(marked, F.lit(False)) & F.col(on).isNotNull()).alias(out))


def likely_in(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of ``df`` whose ``on`` may be among ``keys``: a prefilter for an inner or semi join, so that rows
    which cannot match are not shuffled. Every task gets bitmaps of a fixed total size; the more keys, the
    more rows pass that the join drops later. A row that matches always passes."""
    spotted, marked = _filtered(df, keys, on, FILTER_BITS, "inner")
    return spotted.filter(marked).select(*df.columns)


def checked_lookup(
    probe: DataFrame,
    table: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    row_keys: Sequence[str] = (),
    max_bytes: int | None = None,
    salt_buckets: int | None = None,
) -> DataFrame:
    """Join ``probe`` with the lookup ``table`` on ``on``.

    ``row_keys`` identify a probe row (for example ``doc_id, pos``); they spread a hot join key over
    the salts in the shuffle fallback.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits_broadcast(table, max_bytes):
        return probe.join(F.broadcast(table), keys, how)
    n_salt = salt_buckets or _conf_int(probe, "spark.toxscan.saltBuckets", DEFAULT_SALT_BUCKETS)
    spread = [F.col(c) for c in (row_keys or probe.columns)]
    salted_probe = probe.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(n_salt)).cast("int"))
    salted_table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n_salt - 1))))
    return salted_probe.join(salted_table, keys + ["_salt"], how).drop("_salt")


# --- elements of rows against a table with frequencies ----------------------------------------------

def frequency_split(table: DataFrame, frequency: str, max_bytes: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """``table`` (without ``frequency``) in two parts and the number of keys of the second: first the rows from a power of two of
    ``frequency`` on, as low a power as the bound in bytes allows. A null frequency counts as the greatest.

    The driver reads one row for each power of two, 65 at most."""
    power = F.when(F.col(frequency).isNull(), 64).when(F.col(frequency) < 1, 0).otherwise(F.floor(F.log2(frequency))).cast("int")
    leveled = table.withColumn("_power", power)
    sizes = sorted(leveled.groupBy("_power").agg(F.sum(_width(table)), F.count(F.lit(1))).collect(), reverse=True)
    left, least, n_cold = broadcast_bound(table, max_bytes), 65, sum(r[2] for r in sizes)
    for level, size, n in sizes:
        if size > left:
            break
        left, least, n_cold = left - size, level, n_cold - n
    hot, cold = leveled.filter(F.col("_power") >= least), leveled.filter(F.col("_power") < least)
    return hot.drop("_power", frequency), cold.drop("_power", frequency), n_cold


def split_lookup(elements: DataFrame, table: DataFrame, on: str, frequency: str, row_key: str, keep: Sequence[str],
                 max_bytes: int | None = None) -> DataFrame:
    """``elements`` (``row_key``, ``keep``, ``on`` and what else an element has), hash-partitioned by ``row_key``, with the
    columns of ``table``; the result is partitioned alike.

    Elements whose key is in the frequent part, or surely not in the table, get their values in place and are gathered by row.
    Each row's distinct other keys, with the places of their elements, are shuffled to the rare part and back to
    their row. Both meet by a join of one row each."""
    hot, cold, n_cold = frequency_split(table, frequency, max_bytes)
    values = [c for c in hot.columns if c != on]
    own = [c for c in elements.columns if c not in (row_key, on, *keep)]
    marked = elements.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    marked = mark_likely(marked, cold, on, "_may", filter_bits(n_cold))
    sent = F.col("_hot").isNull() & F.col("_may")
    stay = marked.groupBy(row_key, *keep).agg(F.collect_list(F.when(~sent, F.struct(*own, on, *values))).alias("_here"))
    pairs = marked.filter(sent).groupBy(row_key, on).agg(F.collect_list(F.struct(*own)).alias("_at"))
    found = pairs.join(cold, on, "left").groupBy(row_key).agg(F.collect_list(F.struct(on, *values, "_at")).alias("_found"))
    back = F.flatten(F.transform("_found", lambda f: F.transform(f["_at"], lambda a: F.struct(
        *[a[c].alias(c) for c in own], *[f[c].alias(c) for c in (on, *values)]))))
    found = found.select(row_key, back.alias("_there"))
    both = stay.join(found, row_key, "left").select(row_key, *keep, F.explode_outer(
        F.when(F.col("_there").isNull(), F.col("_here")).otherwise(F.concat("_here", "_there"))).alias("_x"))
    return both.select(row_key, *keep, *[f"_x.{c}" for c in (*own, on, *values)])


def element_lookup(rows: DataFrame, explode: Callable[[DataFrame], DataFrame], table: DataFrame, on: str, keep: Sequence[str],
                   frequency: str | None = None, row_key: str = "_row", max_bytes: int | None = None) -> DataFrame:
    """The elements of ``rows``, as ``explode`` gives them (an outer explode: a row without elements keeps one with a null
    ``on``), with the columns of ``table`` but ``frequency``.

    A table within the bound is broadcast, and partitions stay as they are. Beyond, with a ``frequency``, ``rows`` (keyed by
    ``row_key``) are written once, so that two readings have the same keys, dealt by key, and looked up by
    ``split_lookup``. Without one the join is salted."""
    plain = table.drop(frequency) if frequency else table
    if fits_broadcast(plain, max_bytes):
        return explode(rows).join(F.broadcast(plain), on, "left")
    if frequency is None:
        elements = explode(rows)
        return checked_lookup(elements, plain, on, how="left", row_keys=[c for c in elements.columns if c != on], max_bytes=max_bytes)
    dealt = write_table(rows, "lookup-rows").repartition(row_key)
    return split_lookup(explode(dealt), table, on, frequency, row_key, keep, max_bytes)

"""Arrays of keys against a lookup table of any size, block by block.

Exploding every element to meet a large table, and collecting it again by row, sorts all elements and writes them to disk
several times. Here the rows stay where they are, in blocks of consecutive rows:

1. ``dealt`` writes the rows once, bucketed by block, so that no later step shuffles them;
2. ``block_keys`` are the distinct keys of each block, made inside its bucket. A very frequent key is one row a block;
3. they meet the table in a shuffle by key, and go to their block with their value;
4. ``filled`` puts the values into the arrays, a block at a time, by Arrow's hash lookup.

What is shuffled are the distinct keys of the blocks, and no part of the table is sent to the driver but what Spark broadcasts by its own
threshold. A task holds one block of rows, and its keys, at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toxscan.operators.joins import table_bytes
from toxscan.session import bucket_by_doc, ship_package

#: A block is so many rows, as a power of two.
BLOCK_BITS = 10
#: From these bytes of a lookup table on its lookups go by block.
BLOCKS_FROM_BYTES = 4 << 20


def by_blocks(table: DataFrame) -> bool:
    """Whether lookups in ``table`` go by block."""
    return table_bytes(table) > BLOCKS_FROM_BYTES


def dealt(rows: DataFrame, name: str = "lookup-blocks", buckets: int | None = None) -> DataFrame:
    """``rows`` and ``_block``, written once and bucketed by it."""
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    return bucket_by_doc(rows.withColumn("_block", block), name, buckets, key="_block")


def block_keys(rows: DataFrame, keys: str, on: str) -> DataFrame:
    """``(_block, on)``: the distinct keys in the arrays ``keys`` of each block of ``rows``."""
    return rows.select("_block", F.explode(keys).alias(on)).filter(F.col(on).isNotNull()).distinct()


def filled(rows: DataFrame, found: DataFrame, keys: str, on: str, value: str, out: str, keep_keys: bool = False) -> DataFrame:
    """``rows`` (as ``dealt`` gives them) and ``out``: for each element of ``keys`` the ``value`` that ``found`` (``_block, on, value``; a
    key once a block) has for it, else null; null for a null array. ``keys`` itself stays with ``keep_keys`` only."""
    ship_package(rows.sparkSession)
    kept = [f for f in rows.schema.fields if keep_keys or f.name != keys]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(found.schema[value].dataType))])
    names = [f.name for f in kept]

    def fill(block, known):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        arrays = block.column(keys).combine_chunks()
        arrays = arrays if isinstance(arrays, pa.Array) else pa.concat_arrays(arrays.chunks)
        at = pc.index_in(arrays.flatten(), value_set=known.column(on))
        values = known.column(value).combine_chunks().take(at)
        values = values if isinstance(values, pa.Array) else pa.concat_arrays(values.chunks)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
        offsets = pa.array(np.concatenate([np.zeros(1, np.int32), ends]), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, values, mask=arrays.is_null() if arrays.null_count else None)
        return pa.table([*(block.column(n) for n in names), lists], names=[*names, out])

    return rows.groupBy("_block").cogroup(found.select(F.col("_block").alias("_of"), on, value).groupBy("_of")).applyInArrow(fill, schema)


def array_lookup(rows: DataFrame, keys: str, table: DataFrame, on: str, value: str, out: str, keep_keys: bool = False) -> DataFrame:
    """``rows`` and ``out``, as ``filled`` gives it, from ``table`` (``on, value``; a key once)."""
    blocks = dealt(rows)
    found = block_keys(blocks, keys, on).join(table.select(on, value), on)
    return filled(blocks, found, keys, on, value, out, keep_keys).drop("_block")

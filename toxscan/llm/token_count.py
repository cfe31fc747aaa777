"""Token counts (batch encoding that returns lengths only).

Arrow batches reach the task, are dealt into lists of about equal bytes, long texts are cut at safe
places, and only the lengths leave the task.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows give repeated results; a null
id stays null; an empty table gives an empty result; other columns of the input are ignored, so a
column named like a result cannot clash. No text is truncated.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toxscan.llm.common import byte_batches, python_ready
from toxscan.llm.tokenizing import LOOKUP_CHARS, encoder


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                 tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """Per row of ``df``: ``id_col``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit``)."""
    python_ready(df.sparkSession)
    picked = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType([T.StructField("_id", picked.schema["_id"].dataType),
                           T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def lengths(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        encode = encoder(tokenizer)
        for batch in batches:
            text = batch.column(1)
            size = pc.binary_length(text).cast(pa.int64())
            n = [k for part in byte_batches(text.to_pylist(), LOOKUP_CHARS, size.to_pylist()) for k in encode.batch(part)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(n, pa.int64())],
                names=["_id", "n_bytes", "n_tokens"])

    return picked.mapInArrow(lengths, schema).select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

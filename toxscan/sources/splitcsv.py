"""Records of delimited files whose quoted fields hold line breaks, read in parallel from files of any size.

Such a file cannot be cut at any line break: whether a line begins a record depends on all quotes before it. So the state is
computed by a segmented prefix scan:

1. each block of a file (the part that one task reads) sums its quotes; the running parity over these sums, block by block,
   tells whether the block begins inside a quoted field. That table has one row a block;
2. each task runs the parity over its lines, from its block's beginning, and joins the lines of a record. Records that lie whole in
   a block leave the task as they are;
3. what a block holds before its first and behind its last whole record are pieces of records that others began or end, two
   a block at most. They meet by file in the order of the blocks, numbered by a running count of beginnings.

Quotes must be balanced as RFC 4180 and usual writers have them (a quote inside a field is doubled, and the field is
quoted); a file that ends inside a quoted field is an error. Records end in a line feed, with or without a carriage
return before it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from toxscan.operators.joins import checked_lookup, fits_broadcast
from toxscan.session import ship_package, write_table

RECORDS = "file string, block long, part string, line long, record string"
#: What an unquoted empty field reads as before it becomes null, so that a quoted one stays empty: code points that no text has.
NO_VALUE = "\ufdd0\ufdd1"
#: Characters of lines joined at once.
BATCH_CHARS = 1 << 22


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value"))


def read_records(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """``(file, place, record)``: each record of the files at ``path``, with its line breaks; ``place`` grows in a file in the order
    of its records. One line of a file may be of any length a task can hold, as may a record."""
    ship_package(spark)
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote), F.lit("")))
    sums = lines.groupBy("file", "block").agg((F.sum(quotes.cast("long")) % 2).alias("odd"))
    in_order = Window.partitionBy("file").orderBy("block")
    states = write_table(sums.select(
        "file", "block", (F.coalesce(F.sum("odd").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1).alias("opens"),
        (F.sum("odd").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) % 2 == 1).alias("unbalanced")), "csv-blocks")
    bad = states.filter("unbalanced").select("file").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0][0]} ends inside a quoted field")
    states = states.drop("unbalanced")
    if fits_broadcast(states):  # keeps the lines in the order in which their task reads them
        stated = lines.join(F.broadcast(states), ["file", "block"])
    else:  # the lines of a block meet in one task, and are put in order again
        stated = lines.withColumn("_line", F.monotonically_increasing_id()).join(states, ["file", "block"]).repartition(
            "file", "block").sortWithinPartitions("file", "block", "_line")

    def assemble(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at = None  # the block at hand: file, block, inside a quoted field, met a record's beginning, lines before that, open record
        number, head, held, inside, begun = 0, [], [], False, False

        def ends():
            out = []
            if at is not None and head:
                out.append((*at, "head", -1, "\n".join(head)))
            if at is not None and held:
                out.append((*at, "tail", number, "\n".join(held)))
            return out

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)] if rows else [],
                                              names=["file", "block", "part", "line", "record"])

        for batch in batches:
            rows, size = [], 0
            for file, block, value, opens in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (file, block):
                    rows += ends()
                    at, number, head, held, inside, begun = (file, block), 0, [], [], opens, not opens
                (held if begun else head).append(value)
                if value.count(quote) % 2:
                    inside = not inside
                if not inside:
                    if begun:
                        rows.append((file, block, "whole", number, "\n".join(held)))
                        size += len(value)
                        number += 1
                        held = []
                    begun = True
                if size > BATCH_CHARS:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)
        rows = ends()
        if rows:
            yield packed(rows)

    found = write_table(stated.select("file", "block", "value", "opens").mapInArrow(assemble, RECORDS), "csv-records")
    whole = found.filter("part = 'whole'").select("file", F.struct("block", "line").alias("place"), "record")
    pieces = found.filter("part <> 'whole'")
    begun = F.sum((F.col("part") == "tail").cast("int")).over(
        Window.partitionBy("file").orderBy("block", F.col("part") == "tail").rowsBetween(Window.unboundedPreceding, 0))
    pieces = pieces.withColumn("n", begun).groupBy("file", "n").agg(
        F.array_sort(F.collect_list(F.struct("block", (F.col("part") == "tail").alias("last"), "line", "record"))).alias("x"))
    crossing = pieces.select("file", F.struct(F.col("x")[0]["block"].alias("block"), F.col("x")[0]["line"].alias("line")).alias("place"),
                             F.array_join(F.transform("x", lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(crossing).withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def read_split(spark: SparkSession, path: str, schema, options: dict) -> DataFrame:
    """The rows of delimited files, as columns of ``schema``. The first record of each file is its header, the same in all files.
    Empty records are left out, as Spark's reader does."""
    records = read_records(spark, path, options["quote"])
    first = write_table(records.groupBy("file").agg(F.min_by("record", "place").alias("header"), F.min("place").alias("begin")), "csv-headers")
    if first.select("header").distinct().limit(2).count() > 1:
        raise ValueError(f"{path}: the files have different headers")
    body = checked_lookup(records, first, "file", how="inner", row_keys=["record"])
    body = body.filter((F.col("place") > F.col("begin")) & (F.col("record") != ""))
    told = {k: v for k, v in options.items() if k not in ("header", "multiLine")} | {"nullValue": NO_VALUE}
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return body.select(F.from_csv("record", ddl, {**told, "mode": "FAILFAST"}).alias("r")).select("r.*")

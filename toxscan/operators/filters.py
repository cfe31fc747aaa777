"""Filters and projections on posts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toxscan.functions.text import clean_text, null_as_text, tokenize
from toxscan.operators.joins import checked_lookup
from toxscan.operators.ranking import exact_rank
from toxscan.session import write_table
from toxscan.sources.posts import kept_all, kept_confirmed, known_label

# A small English word list used as the default lexicon. The reference labels posts
# with a banned-word list it does not publish; any list can be passed instead.
DEFAULT_LEXICON = ("idiot", "moron", "pathetic", "scum", "trash", "worthless")


def drop_unlabelled(posts: DataFrame) -> DataFrame:
    """Drop ``label == -1``. A null label is an error."""
    return known_label(posts.filter(kept_all()))


def confirmed_only(posts: DataFrame) -> DataFrame:
    """Drop unconfirmed or unlabelled posts. A null label among the confirmed is an error."""
    return known_label(posts.filter(kept_confirmed()))


def project_dataset(posts: DataFrame) -> DataFrame:
    """``string`` becomes ``document``; the label is an int."""
    return posts.select("doc_id", F.col("string").alias("document"), F.col("label").cast("int").alias("label"))


def class_bucket(df: DataFrame, label: str = "label", out: str = "bucket") -> DataFrame:
    """Label 0 is bucket 0, any other label is bucket 1."""
    return df.withColumn(out, F.when(F.col(label) == 0, F.lit(0)).otherwise(F.lit(1)))


def with_index(df: DataFrame, order_by: str = "doc_id", per: Iterable[str] = ("bucket",), out: str = "_id") -> DataFrame:
    """P5: 0-based index in input order, restarting per class."""
    return exact_rank(df, [order_by], list(per), rank_col=out)


def null_text(df: DataFrame, col: str = "text", out: str = "text") -> DataFrame:
    """A missing text becomes ``nan``."""
    return df.withColumn(out, null_as_text(col))


def lexicon_label(df: DataFrame, text_col: str = "document", lexicon=DEFAULT_LEXICON, out: str = "lexicon_label",
                  id_col: str = "doc_id") -> DataFrame:
    """1 when any cleaned token is in the lexicon, else 0.

    A word list given in code is a bounded literal array, tested per row with ``arrays_overlap``:
    no explode, no join, no shuffle. A lexicon DataFrame (a word-list file of any size) goes through
    an exploded semi join whose build side is broadcast only after its size is checked.
    """
    tokens = tokenize(clean_text(text_col))
    if not isinstance(lexicon, DataFrame):
        words = sorted({w.lower() for w in lexicon})
        hit = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]).cast("array<string>"))
        return df.withColumn(out, F.coalesce(hit, F.lit(False)).cast("int"))
    words = write_table(lexicon.select(F.lower(F.col(lexicon.columns[0])).alias("token")).distinct(), "lexicon")
    exploded = df.select(id_col, F.explode_outer(tokens).alias("token")).filter(F.col("token").isNotNull())
    hits = checked_lookup(exploded, words, "token", how="left_semi", row_keys=[id_col]).select(id_col).distinct()
    hits = hits.withColumn(out, F.lit(1))
    return df.join(hits, id_col, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))

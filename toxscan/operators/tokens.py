"""Token table, vocabulary, encode, model inputs, decode.

The vocabulary keeps every token unless a caller asks for a cap; ids follow (count desc, token) and
come from ``exact_rank``, so no task numbers the whole vocabulary. A small one is looked up by ``element_lookup``, a larger one
by blocks of documents (``blocks.array_lookup``): their arrays are filled where they lie, and no token is a row of its own. Counting is a ``groupBy`` with map-side partial
aggregation, so a very frequent token never piles up in one task.

Per-document steps group by a key of the row, never by a caller's id: ids may repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toxscan.functions.text import MASK_CHAR, clean_text, tokenize
from toxscan.operators.blocks import array_lookup, by_blocks
from toxscan.operators.joins import element_lookup
from toxscan.operators.ranking import exact_rank

# Reserved ids. Pad, unknown, start and end marks, and the mask character.
PAD_ID, UNK_ID, CLS_ID, SEP_ID, MASK_ID = 0, 1, 2, 3, 4
SPECIAL_TOKENS = (("[PAD]", PAD_ID), ("[UNK]", UNK_ID), ("[CLS]", CLS_ID), ("[SEP]", SEP_ID), (MASK_CHAR, MASK_ID))
FIRST_WORD_ID = 5
DEFAULT_MAX_LENGTH = 150


def with_tokens(df: DataFrame, text_col: str = "text", out: str = "tokens", cleaned: str | None = None) -> DataFrame:
    """Clean and tokenize once; optionally keep the cleaned text as ``cleaned``."""
    if cleaned:
        return df.withColumn(cleaned, clean_text(text_col)).withColumn(out, tokenize(cleaned))
    return df.withColumn(out, tokenize(clean_text(text_col)))


def token_table(df: DataFrame, id_cols=("doc_id",), tokens_col: str = "tokens", keep=()) -> DataFrame:
    """One row per token: ``(*id_cols, *keep, pos, token)`` with 0-based ``pos``.

    ``posexplode_outer`` plus a filter above it, not ``posexplode``: for a plain explode Catalyst
    infers ``size(tokens) > 0`` and pushes it below the shuffle into the scan, where it would run
    the whole cleaning and tokenizing chain a second time."""
    ex = df.select(*id_cols, *keep, F.posexplode_outer(tokens_col).alias("pos", "token"))
    return ex.filter(F.col("pos").isNotNull())


def token_counts(tokens: DataFrame, weight_col: str | None = None) -> DataFrame:
    """``(token, count)``; ``weight_col`` counts a row that many times (oversampled copies)."""
    w = F.col(weight_col) if weight_col else F.lit(1)
    return tokens.groupBy("token").agg(F.sum(w).cast("long").alias("count"))


def build_vocab(counts: DataFrame, vocab_size: int | None = None, with_specials: bool = True) -> DataFrame:
    """V1: ``(token, id, count)``. Tokens by (count desc, token) get ids from ``FIRST_WORD_ID`` on; the
    mask character keeps its reserved id. ``vocab_size`` is an optional cap: rarer tokens are left out."""
    learned = counts.filter(F.col("token") != MASK_CHAR)
    ranked = exact_rank(learned, [F.desc("count"), "token"], rank_col="_rank")
    if vocab_size is not None:
        ranked = ranked.filter(F.col("_rank") < vocab_size)
    vocab = ranked.select("token", (F.col("_rank") + FIRST_WORD_ID).alias("id"), "count")
    if with_specials:
        spark = counts.sparkSession
        specials = spark.createDataFrame(
            [(t, i, None) for t, i in SPECIAL_TOKENS], "token string, id long, count long"
        )
        vocab = specials.unionByName(vocab)
    return vocab


def with_frequency(vocab: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of the vocabulary and ``frequency``: its counts, for lookups that treat frequent tokens apart."""
    count = F.col("count") if "count" in vocab.columns else F.lit(0).cast("long")
    return vocab.select(*columns, count.alias("frequency"))


def with_row_key(df: DataFrame, partitioned: bool = False) -> DataFrame:
    """``df`` with ``_row``, unique per row, hash-partitioned by it: what is exploded from a row and grouped
    by ``_row`` again needs no exchange. ``partitioned``: the input is hash-partitioned by an id that
    the grouping keys include, so no shuffle is needed either."""
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    return keyed if partitioned else keyed.repartition("_row")


def encode(docs: DataFrame, vocab: DataFrame, id_cols=("doc_id",), max_length: int = DEFAULT_MAX_LENGTH,
           pad: bool = False, tokens_col: str = "tokens") -> DataFrame:
    """Ids with start and end marks, at most ``max_length`` ids per row including both marks.

    The whole text is encoded: a document longer than ``max_length - 2`` tokens gives several rows
    (``chunk`` 0, 1, ...), each a complete model input. ``pad`` fills to ``max_length`` with the pad
    id (training form). ``docs`` has one row per document with its tokens; those arrays are shuffled
    once, by row, and not the tokens, or are written by block.
    """
    content = max_length - 2
    if by_blocks(vocab.select("token", "id")):
        ids = array_lookup(docs.select(*id_cols, tokens_col), tokens_col, vocab.select("token", F.col("id").cast("long").alias("id")),
                           "token", "id", "_ids").withColumn("_ids", F.coalesce("_ids", F.array().cast("array<long>")))
        last = F.greatest(F.floor((F.size("_ids") - 1) / content), F.lit(0)).cast("int")
        chunks = ids.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
        body = F.transform(F.slice("_ids", F.col("chunk") * content + 1, F.lit(content)), lambda i: F.coalesce(i, F.lit(UNK_ID).cast("long")))
        return _marked(chunks.select(*id_cols, "chunk", body.alias("_body")), id_cols, max_length, pad)
    rows = with_row_key(docs.select(*id_cols, tokens_col))
    ids = element_lookup(rows, lambda r: token_table_outer(r, ["_row", *id_cols], tokens_col), with_frequency(vocab, "token", "id"),
                         "token", id_cols, "frequency")
    ids = ids.withColumn("id", F.coalesce(F.col("id"), F.lit(UNK_ID)))
    ids = ids.withColumn("chunk", F.coalesce(F.floor(F.col("pos") / content), F.lit(0)).cast("int"))
    grouped = ids.groupBy("_row", *id_cols, "chunk").agg(
        F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "id")))).alias("items")
    )
    body = F.transform("items", lambda x: x["id"])
    return _marked(grouped.select(*id_cols, "chunk", body.alias("_body")), id_cols, max_length, pad)


def _marked(chunks: DataFrame, id_cols, max_length: int, pad: bool) -> DataFrame:
    """``input_ids`` of the ids ``_body`` of each chunk: marked, and padded with ``pad``."""
    mark = [F.array(F.lit(i).cast("long")) for i in (CLS_ID, SEP_ID)]
    out = chunks.select(*id_cols, "chunk", F.concat(mark[0], "_body", mark[1]).alias("input_ids"))
    if pad:
        out = out.withColumn(
            "input_ids",
            F.concat("input_ids", F.array_repeat(F.lit(PAD_ID).cast("long"), F.lit(max_length) - F.size("input_ids"))),
        )
    return out


def token_table_outer(df: DataFrame, id_cols=("doc_id",), tokens_col: str = "tokens") -> DataFrame:
    """Like ``token_table`` but an empty document keeps one row with null ``pos`` and ``token``."""
    return df.select(*id_cols, F.posexplode_outer(tokens_col).alias("pos", "token"))


def model_inputs(encoded: DataFrame, ids_col: str = "input_ids") -> DataFrame:
    """``token_type_ids`` all 0; ``attention_mask`` 1 for every id that is not padding."""
    return encoded.withColumn("token_type_ids", F.array_repeat(F.lit(0), F.size(ids_col))).withColumn(
        "attention_mask", F.transform(ids_col, lambda x: F.when(x == PAD_ID, 0).otherwise(1))
    )


def decode(encoded: DataFrame, vocab: DataFrame, id_cols=("doc_id", "chunk"), ids_col: str = "input_ids") -> DataFrame:
    """Ids back to text, pad / unknown / start / end dropped, tokens joined by one space."""
    if by_blocks(vocab.select("id", "token")):
        ids = encoded.select(*id_cols, F.col(ids_col).cast("array<long>").alias("_ids"))
        named = vocab.filter(F.col("id") >= MASK_ID).select(F.col("id").cast("long").alias("id"), "token")
        texts = array_lookup(ids, "_ids", named, "id", "token", "_tokens")
        return texts.select(*id_cols, F.coalesce(F.array_join("_tokens", " "), F.lit("")).alias("text"))
    rows = with_row_key(encoded.select(*id_cols, ids_col))
    words = with_frequency(vocab.filter(F.col("id") >= MASK_ID), "id", "token")
    joined = element_lookup(rows, lambda r: r.select("_row", *id_cols, F.posexplode_outer(ids_col).alias("i", "id")), words, "id",
                            id_cols, "frequency")
    grouped = joined.groupBy("_row", *id_cols).agg(
        F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("i", "token")))).alias("items")
    )
    return grouped.select(*id_cols, F.array_join(F.transform("items", lambda x: x["token"]), " ").alias("text"))

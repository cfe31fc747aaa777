"""M1, the fitted alternative: sparse logistic regression as iterated joins and partial sums.

A document is the vector of the tokens that it holds, scaled to length 1, and a bias of 1 under the empty token (no text has it). The
model is a table ``(token, weight)`` over all tokens of the training rows. A step of gradient descent is one job:

1. the features' items are looked up in the weights and summed by row: the row's score, its probability and, against its label, its
   error. Weights within the step's share of the broadcast bound are broadcast; beyond, they meet the distinct tokens of each block of
   features (``blocks``), so what passes the driver does not grow with the steps;
2. the items times the error are summed by token. The sums are partial before the shuffle, so it carries about one row
   for each distinct token of a task, and a frequent token is no hot key;
3. the weights move against the sums and are written, so a lost executor repeats a step and not the fit.

The features are written once, bucketed by block of rows, so that no step shuffles them. Nothing is capped, and the number of steps is fixed:
the same rows give the same weights up to the order of summation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from toxscan.functions.text import MASK_CHAR
from toxscan.operators.blocks import block_keys, dealt, filled
from toxscan.operators.joins import broadcast_bound, element_lookup, fits_broadcast, likely_in
from toxscan.operators.tokens import with_row_key, with_tokens
from toxscan.session import spread, write_table

BIAS = ""
STEPS = 12
RATE = 4.0
PENALTY = 1e-4
#: Training documents a bucket.
BUCKET_ROWS = 50_000


def unit_features(rows: DataFrame, keep: Sequence[str], tokens_col: str = "tokens") -> DataFrame:
    """``(_row, *keep, tokens, x)``: each distinct token of a row, the bias first, and the value that each but the bias has. Made
    inside the row; a row without tokens has the bias alone."""
    held = F.array_distinct(F.filter(tokens_col, lambda t: t.isNotNull() & (t != MASK_CHAR)))
    return rows.select("_row", *keep, F.concat(F.array(F.lit(BIAS)), held).alias("tokens")).withColumn(
        "x", 1.0 / F.sqrt(F.greatest(F.size("tokens") - 1, F.lit(1))))


def _items(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    ex = rows.select("_row", *keep, "x", F.posexplode_outer("tokens").alias("pos", "token"))
    return ex.withColumn("x", F.when(F.col("pos") == 0, 1.0).otherwise(F.col("x")))


def _scored(rows: DataFrame, weights: DataFrame, keep: Sequence[str], pairs: DataFrame | None = None) -> DataFrame:
    """``rows`` (dealt by ``_row`` or ``_block``) with ``z``, the score, and their items; ``weights`` has ``token, weight, frequency``.
    ``pairs``: the tokens of each block, where ``rows`` are ``dealt``."""
    if not fits_broadcast(weights.select("token", "weight"), broadcast_bound(weights) // STEPS):
        if pairs is None:
            rows = dealt(rows, "logistic-rows")
            pairs = block_keys(rows, "tokens", "token")
        looked = filled(rows, pairs.join(weights.select("token", "weight"), "token"), "tokens", "token", "weight", "_w", keep_keys=True)
        w = F.transform("_w", lambda v: F.coalesce(v, F.lit(0.0)))
        z = F.aggregate(F.slice(w, F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))), F.lit(0.0), lambda a, v: a + v) * F.col("x") + w[0]
        items = F.transform("tokens", lambda t, i: F.struct(t.alias("token"), F.when(i == 0, 1.0).otherwise(F.col("x")).alias("x")))
        return looked.select("_row", *keep, z.alias("z"), items.alias("items"))
    found = element_lookup(rows, lambda r: _items(r, keep), weights, "token", keep, "frequency")
    return found.groupBy("_row", *keep).agg(
        F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("x")).alias("z"), F.collect_list(F.struct("token", "x")).alias("items"))


def _probability(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def fit_logistic(train: DataFrame, docs: DataFrame, class_col: str = "bucket", id_col: str = "doc_id", text_col: str = "text",
                 steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> DataFrame:
    """``(token, weight, frequency)`` after ``steps`` steps; ``frequency`` counts the training documents that hold the token (null for
    the bias, which all hold and which is not penalised). The balanced table's copies are the weight of a document."""
    copies = train.groupBy(id_col, class_col).agg(F.count(F.lit(1)).cast("double").alias("copies"))
    texts = copies.join(likely_in(spread(docs.select(id_col, text_col)), copies, id_col), id_col, "inner")
    rows = with_row_key(with_tokens(texts, text_col).select(F.col(class_col).cast("double").alias("y"), "copies", "tokens"))
    buckets = max(rows.sparkSession.sparkContext.defaultParallelism, -(-copies.count() // BUCKET_ROWS))
    features = dealt(unit_features(rows, ["y", "copies"]), "logistic", buckets)
    n = features.agg(F.sum("copies")).first()[0]
    if not n or features.select("y").distinct().count() < 2:
        raise ValueError("fit_logistic: both classes need training rows")
    weights = write_table(features.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).select(
        "token", F.lit(0.0).alias("weight"), F.when(F.col("token") != BIAS, F.col("n")).alias("frequency")), "logistic-0")
    pairs = write_table(block_keys(features, "tokens", "token"), "logistic-tokens")
    for step in range(steps):
        scored = _scored(features, weights, ["_block", "y", "copies"], pairs)
        error = F.col("copies") * (_probability(F.col("z")) - F.col("y")) / F.lit(n)
        pulls = scored.select(error.alias("e"), F.explode("items").alias("i")).groupBy(F.col("i.token").alias("token")).agg(
            F.sum(F.col("e") * F.col("i.x")).alias("g"))
        shrink = F.when(F.col("token") == BIAS, 0.0).otherwise(F.lit(penalty) * F.col("weight"))
        moved = weights.join(pulls, "token").select(
            "token", (F.col("weight") - F.lit(rate) * (F.col("g") + shrink)).alias("weight"), "frequency")
        weights = write_table(moved, f"logistic-{step + 1}")
    return weights


def score_logistic(df: DataFrame, weights: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens",
                   keep: Sequence[str] = ()) -> DataFrame:
    """``(id, *keep, score, pred, p1)`` of rows with tokens."""
    features = unit_features(with_row_key(df.select(id_col, *keep, tokens_col)), [id_col, *keep], tokens_col)
    scored = _scored(features, weights, [id_col, *keep])
    return scored.select(id_col, *keep, F.col("z").alias("score"), (F.col("z") > 0).cast("int").alias("pred"), _probability(F.col("z")).alias("p1"))

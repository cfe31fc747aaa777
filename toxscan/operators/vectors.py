"""M3 (on vectors), M5-M8: attention attribution, attention pooling, head split, layer combination and a linear head on vector rows.

A group (all vectors with one ``label``) may hold a large share of the table, so no group is ever
gathered into one task: every per-group quantity (query row, maximum score, softmax denominator,
weighted sums, vector sums) is a ``groupBy`` aggregate with map-side partial aggregation, and the
per-group results are joined back through a checked lookup join.

Pooling follows the attribution layer: the group's first row (smallest id) is the query and is left
out of the keys, as the start mark is; keys and values are the vectors themselves; scores are
``q . k / sqrt(d_head)`` per head, softmax over the keys of the group, the pooled vector is
``tanh(sum p v)`` per head.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from toxscan.operators.joins import checked_lookup, fits_broadcast
from toxscan.session import write_table

LAYER_NORM_EPS = 1e-12


def as_double_array(c: str) -> Column:
    return F.transform(F.col(c), lambda x: x.cast("double"))


def head_size(dim: int, heads: int) -> int:
    if dim % heads != 0:
        raise ValueError(f"{heads} heads cannot share {dim} values evenly")
    return dim // heads


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def split_heads(df: DataFrame, vec_col: str = "embedding", dim: int = 64, heads: int = 4,
                out: str = "head_vec") -> DataFrame:
    """M6: one row per (row, head) with the head's slice of ``dim / heads`` values."""
    hs = head_size(dim, heads)
    ex = df.withColumn("head", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))))
    return ex.withColumn(out, F.slice(as_double_array(vec_col), F.col("head") * hs + 1, F.lit(hs)))


def _scored(df: DataFrame, group_col: str, id_col: str, columns: tuple[str, str, str], dim: int, heads: int,
            scale: float | None) -> tuple[DataFrame, DataFrame]:
    """Key rows with ``query_id``, ``_v`` and ``_e`` (``exp(score - maximum)`` by head) and ``_s`` (scores by head), one row
    per key; and the query table."""
    hs = head_size(dim, heads)
    q, k, v = (as_double_array(c) for c in columns)
    vecs = df.select(group_col, id_col, q.alias("_q0"), k.alias("_k"), v.alias("_v"))
    # One row per group, written once: the vectors are not read again for the size check and the join.
    query = write_table(vecs.groupBy(group_col).agg(
        F.min(id_col).alias("query_id"), F.min_by("_q0", F.col(id_col)).alias("_q")
    ), "attention-query")
    keys = checked_lookup(vecs.drop("_q0"), query, group_col, how="inner", row_keys=[id_col])
    keys = keys.filter(F.col(id_col) != F.col("query_id"))
    div = F.lit(math.sqrt(hs) if scale is None else float(scale))
    score = F.array(*[dot(F.slice("_q", h * hs + 1, hs), F.slice("_k", h * hs + 1, hs)) / div for h in range(heads)])
    scored = keys.select(group_col, id_col, "query_id", "_v", score.alias("_s"))
    tops = [F.max(F.element_at("_s", h + 1)).alias(f"_m{h}") for h in range(heads)]
    maxima = write_table(scored.groupBy(group_col).agg(*tops), "attention-max")
    scored = checked_lookup(scored, maxima, group_col, how="inner", row_keys=[id_col])
    e = F.array(*[F.exp(F.element_at("_s", h + 1) - F.col(f"_m{h}")) for h in range(heads)])
    return scored.select(group_col, id_col, "query_id", "_v", "_s", e.alias("_e")), query


def attention_scores(df: DataFrame, group_col: str = "label", id_col: str = "vec_id", vec_col: str = "embedding",
                     dim: int = 64, heads: int = 4, query_col: str | None = None, key_col: str | None = None,
                     scale: float | None = None) -> DataFrame:
    """M5 (scores) + M6: ``(group, head, id, query_id, score, prob)`` for every key row.

    ``query_col`` and ``key_col`` default to ``vec_col``. ``scale`` divides the products (default: the root of the
    head's size); a model that does not split but scales by its configured heads passes it with ``heads=1``."""
    columns = (query_col or vec_col, key_col or vec_col, vec_col)
    scored, _ = _scored(df, group_col, id_col, columns, dim, heads, scale)
    sums = write_table(scored.groupBy(group_col).agg(
        *[F.sum(F.element_at("_e", h + 1)).alias(f"_z{h}") for h in range(heads)]), "attention-z")
    joined = checked_lookup(scored.drop("_v"), sums, group_col, how="inner", row_keys=[id_col])
    z = F.array(*[F.col(f"_z{h}") for h in range(heads)])
    probs = F.zip_with("_e", z, lambda e, t: e / t)
    ex = joined.select(group_col, id_col, "query_id", F.posexplode(F.arrays_zip(F.col("_s").alias("s"), probs.alias("p"))).alias("head", "x"))
    return ex.select(group_col, "head", id_col, "query_id", F.col("x.s").alias("score"), F.col("x.p").alias("prob"))


def attention_pool(df: DataFrame, group_col: str = "label", id_col: str = "vec_id", vec_col: str = "embedding",
                   dim: int = 64, heads: int = 4, query_col: str | None = None, key_col: str | None = None,
                   scale: float | None = None) -> DataFrame:
    """M5: ``(group, dim, value)``: the pooled vector ``tanh(sum_k p_k v_k)`` per head, all heads
    concatenated. One row per key reaches the aggregate, whose sums (one per value position and one per head) are
    combined before the shuffle. ``vec_col`` holds the values; see ``attention_scores`` for the rest."""
    hs = head_size(dim, heads)
    scored, _ = _scored(df, group_col, id_col, (query_col or vec_col, key_col or vec_col, vec_col), dim, heads, scale)
    sums = [F.sum(F.element_at("_e", h + 1)).alias(f"_z{h}") for h in range(heads)]
    sums += [F.sum(F.element_at("_e", j // hs + 1) * F.element_at("_v", j + 1)).alias(f"_s{j}") for j in range(dim)]
    per = scored.groupBy(group_col).agg(*sums)
    pooled = F.array(*[F.tanh(F.col(f"_s{j}") / F.col(f"_z{j // hs}")) for j in range(dim)])
    return per.select(group_col, F.posexplode(pooled).alias("dim", "value"))


def layer_norm(v: Column, eps: float = LAYER_NORM_EPS) -> Column:
    """``(x - mean) / sqrt(var + eps)`` over the values of one vector (weight 1, bias 0)."""
    n = F.size(v).cast("double")
    mean = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / n
    var = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)) / n
    return F.transform(v, lambda x: (x - mean) / F.sqrt(var + F.lit(eps)))


def combine_layers(df: DataFrame, group_cols: Sequence[str] = ("label",), vec_col: str = "embedding", dim: int = 64,
                   eps: float = LAYER_NORM_EPS) -> DataFrame:
    """M7: the sum of the selected vectors of each group, layer-normalised when more than one was
    summed. ``(group, n, combined)``; the sums are partial aggregates per value position."""
    v = as_double_array(vec_col)
    per = df.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.element_at(v, j + 1)).alias(f"_s{j}") for j in range(dim)]
    )
    summed = F.array(*[F.col(f"_s{j}") for j in range(dim)])
    combined = F.when(F.col("n") > 1, layer_norm(summed, eps)).otherwise(summed)
    return per.select(*group_cols, "n", combined.alias("combined"))


def centroid_head(df: DataFrame, class_col: str = "label", vec_col: str = "embedding", dim: int = 64) -> DataFrame:
    """Weights of a linear head that picks the nearest class mean: ``(class, w, b)`` with ``w`` the mean vector of a
    class and ``b = -|w|^2 / 2``."""
    v = as_double_array(vec_col)
    means = df.groupBy(F.col(class_col).alias("class")).agg(*[F.avg(F.element_at(v, j + 1)).alias(f"_m{j}") for j in range(dim)])
    w = F.array(*[F.col(f"_m{j}") for j in range(dim)])
    return means.select("class", w.alias("w"), (dot(w, w) * F.lit(-0.5)).alias("b"))


def _model(weights: DataFrame, order: str) -> Column:
    """The rows of a bounded model in the order of ``order``, as one array: a scalar subquery, run once, whose value every task gets. A
    model beyond the broadcast bound is an error, not a cut."""
    weights = write_table(weights, "model")
    if not fits_broadcast(weights):
        raise ValueError("the model is larger than spark.toxscan.broadcastMaxBytes")
    return weights.agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in weights.columns if c != order])))).scalar()


def with_projection(df: DataFrame, vec: Column, matrix: DataFrame, out: str) -> DataFrame:
    """``df`` and ``out``: ``W x + b``; ``matrix`` has a row ``(place, w, b)`` for each value of the result."""
    held = df.withColumn("_vec", vec).withColumn("_matrix", _model(matrix.select("place", "w", "b"), "place"))
    return held.select(*df.columns, F.transform("_matrix", lambda r: dot(F.col("_vec"), r["w"]) + r["b"]).alias(out))


def moment_projection(df: DataFrame, vec_col: str = "embedding", dim: int = 64, rows: int | None = None) -> DataFrame:
    """A projection from the data: the first ``rows`` rows of the second-moment matrix of the vectors, ``b`` their means. Partial sums by
    place, no vector is shuffled."""
    places = F.slice(as_double_array(vec_col), 1, rows or dim)
    ex = df.select(as_double_array(vec_col).alias("_v"), F.posexplode(places).alias("place", "_x"))
    sums = ex.groupBy("place").agg(F.avg("_x").alias("b"), *[F.avg(F.col("_x") * F.element_at("_v", j + 1)).alias(f"_w{j}") for j in range(dim)])
    return sums.select("place", F.array(*[f"_w{j}" for j in range(dim)]).alias("w"), "b")


def attribute_attention(df: DataFrame, query_matrix: DataFrame, key_matrix: DataFrame, doc_col: str = "doc_id", pos_col: str = "pos",
                        vec_col: str = "embedding", dim: int = 64, heads: int = 4) -> DataFrame:
    """M3 on token vectors: ``(doc, pos, score, prob, place)``. Query and key are projections of the vectors (``(place, w, b)``, the
    rows of head 0 are used: only that head decides what is masked). A document's first row is its query and is no
    candidate; scores are ``q . k / sqrt(head size)``, ``prob`` their softmax over the document's other rows, ``place`` the 0-based
    order in which the mask loop takes them (prob descending, then position)."""
    hs = head_size(dim, heads)
    x = as_double_array(vec_col)
    head0 = F.col("place") < hs
    projected = with_projection(df.select(doc_col, pos_col, vec_col), x, query_matrix.filter(head0), "_query")
    projected = with_projection(projected, x, key_matrix.filter(head0), "_key")
    found = attention_scores(projected, doc_col, pos_col, vec_col, dim=hs, heads=1, query_col="_query", key_col="_key", scale=math.sqrt(hs))
    order = Window.partitionBy(doc_col).orderBy(F.desc("prob"), pos_col)  # the tokens of one document
    return found.select(doc_col, pos_col, "score", "prob", (F.row_number().over(order) - 1).alias("place"))


def linear_head(df: DataFrame, vec_col: str, weights: DataFrame) -> DataFrame:
    """M8: adds ``logits`` (``W x + b`` in order of class) and ``pred``, the class of the greatest (ties: the first). ``weights``:
    ``(class, w, b)``, a model within the broadcast bound."""
    held = df.withColumn("_model", _model(weights.select("class", "w", "b"), "class"))
    out = held.withColumn("logits", F.transform("_model", lambda r: dot(F.col(vec_col), r["w"]) + r["b"]))
    best = F.array_position("logits", F.array_max("logits"))
    return out.withColumn("pred", F.element_at(F.col("_model")["class"], best.cast("int"))).drop("_model")

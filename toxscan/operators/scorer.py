"""An additive token scorer fitted and applied with DataFrame operators.

The pretrained encoder of the reference is not available, so the capability is re-aimed at a model
Spark can fit and apply at scale: every token has a weight, a document scores ``bias + sum of its
token weights``, and it is toxic when the score is above 0. Weights are smoothed log-odds (naive
Bayes) of the token in class 1 against class 0, rounded to ``decimal(18,6)`` so that sums, ties and
the purify closed form are exact and engine-independent.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toxscan.functions.text import MASK_CHAR
from toxscan.operators.tokens import token_table_outer, with_tokens
from toxscan.operators.blocks import array_lookup
from toxscan.operators.joins import element_lookup, fits_broadcast, likely_in
from toxscan.session import scratch_path, ship_package, spread, write_table

WEIGHT_TYPE = "decimal(18,6)"


@dataclass
class AdditiveScorer:
    """``weights``: ``(token string, weight decimal(18,6))``, one row per token; ``bias``: a scalar."""

    weights: DataFrame
    bias: Decimal

    @property
    def micro_bias(self) -> int:
        """The bias in whole millionths."""
        return int(self.bias.scaleb(6))

    def save(self, path: str) -> None:
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        spark = self.weights.sparkSession
        spark.createDataFrame([(self.bias,)], f"bias {WEIGHT_TYPE}").write.mode("overwrite").parquet(f"{path}/bias")

    @staticmethod
    def load(spark: SparkSession, path: str) -> AdditiveScorer:
        bias = spark.read.parquet(f"{path}/bias").first()[0]
        return AdditiveScorer(spark.read.parquet(f"{path}/weights"), Decimal(bias))

    def materialized(self, name: str = "scorer") -> tuple[AdditiveScorer, str]:
        """Written to the shared folder and read back: lineage cut, exact size known."""
        path = scratch_path(self.weights.sparkSession, name)
        self.save(path)
        return AdditiveScorer.load(self.weights.sparkSession, path), path


def _round6(x: float) -> Decimal:
    return Decimal(repr(x)).quantize(Decimal("0.000001"))


def class_token_counts(train: DataFrame, docs: DataFrame, class_col: str = "bucket", id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``(token, c0, c1)``: occurrences per class, each oversampled copy counted.

    The balanced table repeats minority rows; instead of exploding repeated text, each document is
    tokenized once and its token counts are multiplied by its number of copies.
    """
    copies = train.groupBy(id_col, class_col).agg(F.count(F.lit(1)).alias("_copies"))
    texts = copies.join(likely_in(spread(docs.select(id_col, text_col)), copies, id_col), id_col, "inner")
    toks = with_tokens(texts, text_col)
    rows = toks.select(class_col, "_copies", F.explode_outer("tokens").alias("token")).filter(F.col("token").isNotNull())
    return rows.groupBy("token").agg(
        F.sum(F.when(F.col(class_col) == 0, F.col("_copies")).otherwise(0)).cast("long").alias("c0"),
        F.sum(F.when(F.col(class_col) == 1, F.col("_copies")).otherwise(0)).cast("long").alias("c1"),
    )


def fit_scorer(train: DataFrame, docs: DataFrame, class_col: str = "bucket", vocab_size: int | None = None,
               alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> AdditiveScorer:
    """M1: smoothed log-odds per token, over all tokens or the ``vocab_size`` most frequent ones.

    ``w(t) = ln((c1 + a) / (T1 + a V)) - ln((c0 + a) / (T0 + a V))``, ``bias = ln(N1 / N0)`` with
    ``N`` the rows per class (0 once the classes are balanced). The mask character has weight 0.
    """
    counts = class_token_counts(train, docs, class_col, id_col, text_col)
    counts = counts.filter(F.col("token") != MASK_CHAR)
    if vocab_size is not None:
        counts = counts.orderBy(F.desc(F.col("c0") + F.col("c1")), F.asc("token")).limit(vocab_size)
    # Written once: the counting job is not repeated for the totals and the weights, and a lost executor
    # re-reads files instead of re-counting the corpus.
    vocab = write_table(counts, "scorer-vocab")
    totals = vocab.agg(F.sum("c0"), F.sum("c1"), F.count(F.lit(1))).first()
    t0, t1, v = (totals[0] or 0), (totals[1] or 0), totals[2]
    a = float(alpha)
    w = F.log((F.col("c1") + a) / F.lit(t1 + a * v)) - F.log((F.col("c0") + a) / F.lit(t0 + a * v))
    weights = vocab.select("token", w.cast(WEIGHT_TYPE).alias("weight"), "c0", "c1")
    n = {r[0]: r[1] for r in train.groupBy(class_col).count().collect()}  # one row per class
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if n0 == 0 or n1 == 0:
        raise ValueError("fit_scorer: both classes need training rows")
    return AdditiveScorer(weights, _round6(math.log(n1 / n0)))


def micro_weights(scorer: AdditiveScorer) -> DataFrame:
    """``(token, w, frequency)``: weights in whole millionths, so that sums are exact integers, and occurrences in training
    (0 for weights without counts)."""
    counted = {"c0", "c1"} <= set(scorer.weights.columns)
    frequency = F.col("c0") + F.col("c1") if counted else F.lit(0).cast("long")
    return scorer.weights.select("token", (F.col("weight") * F.lit(1_000_000)).cast("long").alias("w"), frequency.alias("frequency"))


def token_weights(df: DataFrame, scorer: AdditiveScorer, id_col: str = "doc_id", tokens_col: str = "tokens",
                  keep: Sequence[str] = ()) -> DataFrame:
    """``(_row, id, *keep, pos, token, w)``, ``w`` in millionths; an empty document keeps one row with null
    token and w = 0. ``_row`` tells rows of ``df`` apart whatever their ids."""
    rows = df.select(id_col, *keep, tokens_col).withColumn("_row", F.monotonically_increasing_id())
    weights = micro_weights(scorer)
    if not fits_broadcast(weights.select("token", "w")):
        both = array_lookup(rows, tokens_col, weights, "token", "w", "_w", keep_keys=True)
        items = F.arrays_zip(F.col(tokens_col).alias("token"), F.col("_w").alias("w"))
        out = both.select("_row", id_col, *keep, F.posexplode_outer(items).alias("pos", "_x"))
        return out.select("_row", id_col, *keep, "pos", "_x.token", F.coalesce("_x.w", F.lit(0).cast("long")).alias("w"))
    joined = element_lookup(rows, lambda r: token_table_outer(r, ["_row", id_col, *keep], tokens_col), weights, "token",
                            [id_col, *keep], "frequency")
    return joined.withColumn("w", F.coalesce("w", F.lit(0).cast("long")))


def probabilities(score: Column) -> tuple[Column, Column]:
    """Softmax over the logits (0, score): ``p0 = 1 / (1 + e^s)``, ``p1 = 1 / (1 + e^-s)``."""
    s = score.cast("double")
    return 1.0 / (1.0 + F.exp(s)), 1.0 / (1.0 + F.exp(-s))


def score(df: DataFrame, scorer: AdditiveScorer, id_col: str = "doc_id", tokens_col: str = "tokens",
          keep: Sequence[str] = ()) -> DataFrame:
    """M2: ``(id, *keep, score, pred, p0, p1)``.

    Tokens are exploded next to the scan, looked up in the broadcast weights, and summed per
    document; the sum is partially aggregated before the shuffle, so the shuffle carries about one
    row per document and map task, not one per token.
    """
    tw = token_weights(df, scorer, id_col, tokens_col, keep)
    agg = tw.groupBy("_row", id_col, *keep).agg(F.sum("w").alias("_s"))  # partial sums before the shuffle
    total = (F.lit(scorer.micro_bias) + F.col("_s")) / F.lit(1e6)
    p0, p1 = probabilities(F.col("score"))
    return (
        agg.select(id_col, *keep, total.alias("score"))
        .withColumn("pred", (F.col("score") > 0).cast("int"))
        .withColumn("p0", p0)
        .withColumn("p1", p1)
    )


def cross_entropy(score_col: str = "score", label_col: str = "label") -> Column:
    """M9: row loss ``logsumexp(z) - z[label]`` for the logits ``z = (0, score)``."""
    s = F.col(score_col).cast("double")
    m = F.greatest(F.lit(0.0), s)
    lse = m + F.log(F.exp(-m) + F.exp(s - m))
    return lse - F.when(F.col(label_col) == 1, s).otherwise(F.lit(0.0))


# --- U1: a pluggable batch scorer -------------------------------------------------------------

BatchModel = Callable[[pd.DataFrame], pd.DataFrame]


def batch_score(df: DataFrame, load_model: Callable[[], BatchModel], schema: str) -> DataFrame:
    """Apply a Python model to Arrow batches with ``mapInPandas``.

    ``load_model`` runs once per task (not per batch or row) and returns a function from a pandas
    batch to a pandas batch with ``schema``. Use it for models that DataFrame expressions cannot
    state; the additive scorer itself runs as ``score`` above.
    """

    ship_package(df.sparkSession)

    def run(batches):
        model = load_model()
        for pdf in batches:
            yield model(pdf)

    return df.mapInPandas(run, schema)


class AdditiveTokenModel:
    """The additive scorer as a model of batches for ``purify_with_model``: scores and attributions
    in integer micro-units (exact), a token made only of mask characters weighs 0."""

    scale = 1_000_000

    def __init__(self, micro: dict, bias: int):
        self.micro, self.bias = micro, bias

    def __call__(self, tokens, offsets):
        import numpy as np

        w = np.fromiter((self.micro.get(t, 0) for t in tokens), dtype=np.int64, count=len(tokens))
        sums = np.concatenate([[0], np.cumsum(w)])
        return self.bias + sums[offsets[1:]] - sums[offsets[:-1]], w


class AdditiveWeightsLoader:
    """Loader for ``purify_with_model`` from weights given in code: ``{token: weight}`` and a
    bias, kept as integer micro-units."""

    def __init__(self, weights: dict, bias=0):
        self.micro = {t: int(Decimal(str(w)).scaleb(6)) for t, w in weights.items()}
        self.bias = int(Decimal(str(bias)).scaleb(6))

    def __call__(self) -> AdditiveTokenModel:
        return AdditiveTokenModel(self.micro, self.bias)


class StoredWeights:
    """Integer weights by token in flat arrays, some 40 bytes a token: tokens and weights in the order of the tokens' 64-bit hashes. A token
    is found by its hash and compared; of tokens that share a hash, those behind the first are kept by name."""

    def __init__(self, batches):
        """``batches``: Arrow arrays of tokens, with their weights in whole millionths as numpy arrays."""
        import numpy as np
        import pyarrow as pa

        names, hashes, weights = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for token, weight in batches:
            names.append(token.cast(pa.large_string()))
            hashes.append(self._hashes(token.to_numpy(zero_copy_only=False)))
            weights.append(weight)
        hashes, weights = np.concatenate(hashes), np.concatenate(weights)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.weights = hashes[order], weights[order]
        self.tokens = pa.concat_arrays([pa.array([], pa.large_string()), *names]).take(pa.array(order))
        later = np.flatnonzero(self.hashes[1:] == self.hashes[:-1]) + 1
        self.shared = {self.tokens[i].as_py(): int(self.weights[i]) for i in later.tolist()}

    @staticmethod
    def _hashes(tokens):
        return pd.util.hash_array(tokens, categorize=False)

    def of(self, tokens):
        """The weight of each of ``tokens`` (an object array of strings), 0 for those that have none."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out = np.zeros(len(tokens), np.int64)
        if not len(tokens) or not len(self.hashes):
            return out
        hashes = self._hashes(tokens)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hits = np.flatnonzero(self.hashes[at] == hashes)
        at = at[hits]
        same = pc.equal(self.tokens.take(pa.array(at)), pa.array(tokens[hits], pa.large_string())).to_numpy(zero_copy_only=False).astype(bool)
        out[hits[same]] = self.weights[at[same]]
        for i in hits[~same].tolist():
            out[i] = self.shared.get(tokens[i], 0)
        return out


class AdditiveStoredModel(AdditiveTokenModel):
    """The same from ``StoredWeights``. The weights of tokens met of late are kept by name, as a batch is scored again and again."""

    KEPT_TOKENS = 100_000

    def __init__(self, stored: StoredWeights, bias: int):
        super().__init__({}, bias)
        self.stored = stored

    def __call__(self, tokens, offsets):
        import numpy as np

        missing = set(tokens).difference(self.micro)
        if missing and len(self.micro) + len(missing) > self.KEPT_TOKENS:
            self.micro.clear()
            missing = set(tokens)
        if missing:
            names = np.array(list(missing), dtype=object)
            self.micro.update(zip(names.tolist(), self.stored.of(names).tolist()))
        return super().__call__(tokens, offsets)


class AdditiveModelLoader:
    """Loads saved scorer weights from the shared folder inside the task (pyarrow filesystem), as ``StoredWeights``."""

    def __init__(self, path: str, id_col: str = "doc_id", tokens_col: str = "tokens", token_model: bool = False):
        self.path, self.id_col, self.tokens_col, self.token_model = path, id_col, tokens_col, token_model

    def __call__(self) -> BatchModel:
        import pyarrow.dataset as ds

        import pyarrow as pa
        import pyarrow.compute as pc

        million = pa.scalar(Decimal(1_000_000), pa.decimal128(7, 0))
        weights = ds.dataset(f"{self.path}/weights", format="parquet").to_batches(
            columns=["token", "weight"], batch_size=1 << 16, batch_readahead=1, fragment_readahead=1)
        stored = StoredWeights((b.column(0), pc.multiply(b.column(1).cast(pa.decimal128(18, 6)), million).cast(pa.int64()).to_numpy())
                               for b in weights)
        bias_tab = ds.dataset(f"{self.path}/bias", format="parquet").to_table()
        bias = int(Decimal(bias_tab.column("bias")[0].as_py()).scaleb(6))
        if self.token_model:
            return AdditiveStoredModel(stored, bias)
        id_col, tokens_col = self.id_col, self.tokens_col

        def model(pdf: pd.DataFrame) -> pd.DataFrame:
            toks = pdf[tokens_col].explode()
            per_tok = pd.Series(0, index=toks.index, dtype="int64")
            held = toks.notna().to_numpy()
            per_tok[held] = stored.of(toks.to_numpy(dtype=object)[held])
            sums = per_tok.groupby(level=0).sum().reindex(pdf.index, fill_value=0)
            total = sums + bias
            s = total / 1e6
            return pd.DataFrame({id_col: pdf[id_col].values, "score": s.values,
                                 "pred": (total > 0).astype("int32").values})

        return model

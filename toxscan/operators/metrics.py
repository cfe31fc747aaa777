"""A1-A3: classification metrics, per-batch metrics and the epoch loss.

Positive class 1; a ratio with a zero denominator is 0 (no error). F1 is ``2 tp / (2 tp + fp + fn)``,
which equals ``2 p r / (p + r)`` and is exact for integer counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def confusion_aggs(y_true: str = "label", y_pred: str = "pred") -> list[Column]:
    t, p = F.col(y_true) == 1, F.col(y_pred) == 1
    return [
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    ]


def with_ratios(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        df.withColumn("accuracy", _ratio(tp + tn, tp + fp + fn + tn))
        .withColumn("precision", _ratio(tp, tp + fp))
        .withColumn("recall", _ratio(tp, tp + fn))
        .withColumn("f1", _ratio(2 * tp, 2 * tp + fp + fn))
    )


def binary_metrics(df: DataFrame, y_true: str = "label", y_pred: str = "pred") -> DataFrame:
    """A1: one row ``(tp, fp, fn, tn, accuracy, precision, recall, f1)`` over the whole set; a
    global aggregate with map-side partial counts."""
    return with_ratios(df.agg(*confusion_aggs(y_true, y_pred)))


def with_batch(df: DataFrame, position: str = "position", batch_size: int = 16, out: str = "batch_id") -> DataFrame:
    return df.withColumn(out, F.floor(F.col(position) / batch_size).cast("long"))


def batch_metrics(df: DataFrame, position: str = "position", batch_size: int = 16, report_cycle: int = 100,
                  y_true: str = "label", y_pred: str = "pred", loss: str = "loss") -> DataFrame:
    """A2: the four metrics and the mean loss per batch of ``batch_size`` rows (by exact position),
    kept for batches whose index is a multiple of ``report_cycle``."""
    batched = with_batch(df, position, batch_size)
    per = batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), *confusion_aggs(y_true, y_pred), F.avg(loss).alias("loss")
    )
    return with_ratios(per).filter(F.col("batch_id") % report_cycle == 0)


def epoch_loss(df: DataFrame, position: str = "position", batch_size: int = 16, loss: str = "loss") -> DataFrame:
    """A3: the mean of per-batch mean losses (a short last batch weighs as much as a full one)."""
    per = with_batch(df, position, batch_size).groupBy("batch_id").agg(F.avg(loss).alias("_bl"))
    return per.agg(F.avg("_bl").alias("epoch_loss"), F.count(F.lit(1)).alias("n_batches"))

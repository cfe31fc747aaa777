"""Training (lifecycle B): balanced train table -> fitted scorer -> validation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from toxscan.operators.metrics import batch_metrics, binary_metrics, epoch_loss
from toxscan.operators.scorer import AdditiveScorer, cross_entropy, fit_scorer, score
from toxscan.operators.tokens import with_tokens
from toxscan.plans.dataset import LabelledDataset


def train(spark: SparkSession, ds: LabelledDataset, model_path: str, docs: DataFrame,
          vocab_size: int | None = None) -> AdditiveScorer:
    """Fit on the balanced train table and the texts ``docs`` (``doc_id, text``); save the model (weights + bias) at
    ``model_path``."""
    fitted = fit_scorer(ds.train, docs, vocab_size=vocab_size)
    fitted.save(model_path)
    return AdditiveScorer.load(spark, model_path)


def validate(test: DataFrame, scorer: AdditiveScorer, batch_size: int = 16, report_cycle: int = 100) -> dict[str, DataFrame]:
    """Validation outputs for the test rows with their text: whole-set metrics with the epoch loss, and per-batch metrics."""
    test = with_tokens(test)
    scored = score(test, scorer, keep=["label", "position"]).withColumn("loss", cross_entropy())
    overall = binary_metrics(scored)
    loss = epoch_loss(scored, batch_size=batch_size).select(F.col("epoch_loss").alias("val_loss"))
    return {
        "metrics": overall,
        "val_loss": loss,
        "batches": batch_metrics(scored, batch_size=batch_size, report_cycle=report_cycle),
    }

import pytest
from pyspark.sql import functions as F

from toxscan.operators.metrics import batch_metrics, binary_metrics, epoch_loss


def _rows(tp, fp, fn, tn):
    return [(1, 1)] * tp + [(0, 1)] * fp + [(1, 0)] * fn + [(0, 0)] * tn


def test_published_metrics(spark):
    df = spark.createDataFrame(_rows(1158, 309, 270, 4439), "label int, pred int")
    r = binary_metrics(df).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1158, 309, 270, 4439)
    assert r.accuracy == 0.90625
    assert r.precision == 0.7893660531697342
    assert r.recall == 0.8109243697478992
    assert r.f1 == 0.8


def test_no_positive_prediction(spark):
    r = binary_metrics(spark.createDataFrame(_rows(0, 0, 3, 5), "label int, pred int")).first()
    assert r.precision == 0.0 and r.f1 == 0.0 and r.recall == 0.0


def test_epoch_loss_is_mean_of_batch_means(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 5.0)], "position long, loss double")
    assert epoch_loss(df, batch_size=2).first().epoch_loss == 3.5


def test_batch_metrics_report_cycle(spark):
    df = spark.range(64).select(F.col("id").alias("position"), (F.col("id") % 2).cast("int").alias("label"),
                                F.lit(1).alias("pred"), F.lit(0.5).alias("loss"))
    out = batch_metrics(df, batch_size=16, report_cycle=2).orderBy("batch_id").collect()
    assert [r.batch_id for r in out] == [0, 2]
    assert all(r.n == 16 and r.precision == 0.5 for r in out)

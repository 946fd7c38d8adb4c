"""Evaluation of (truth, prediction) columns, each metric one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-7


def same(a: Column, b: Column | float) -> Column:
    """Equality of doubles within 1e-7."""
    return F.abs(a - b) < TOLERANCE


def _need(df: DataFrame, what: str) -> None:
    if df.isEmpty():
        raise ValueError(f"{what} of no rows")


def error_rate_of(label: Column, prediction: Column) -> Column:
    return F.avg((label != prediction).cast("double"))


def rmse_of(label: Column, prediction: Column) -> Column:
    return F.sqrt(F.avg((label - prediction) * (label - prediction)))


def accuracy_of(truth: Column, prediction: Column) -> Column:
    return F.avg(same(truth, prediction).cast("double"))


def _share(hits: Column, of: Column) -> Column:
    """Share of rows in ``of`` that are in ``hits``; 1 where there are none."""
    n = F.count_if(of)
    return F.when(n == 0, 1.0).otherwise(F.count_if(hits & of) / n)


def precision_of(truth: Column, prediction: Column) -> Column:
    return _share(same(truth, 1.0), same(prediction, 1.0))


def recall_of(truth: Column, prediction: Column) -> Column:
    return _share(same(prediction, 1.0), same(truth, 1.0))


def classification_report(df: DataFrame, truth: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy, precision, recall in a single pass."""
    t, p = F.col(truth), F.col(prediction)
    return df.agg(accuracy_of(t, p).alias("accuracy"), precision_of(t, p).alias("precision"), recall_of(t, p).alias("recall"))


def rmse(df: DataFrame, truth: str = "label", prediction: str = "prediction") -> float:
    _need(df, "the error")
    return df.agg(rmse_of(F.col(truth), F.col(prediction))).first()[0]


def accuracy(df: DataFrame, truth: str = "label", prediction: str = "prediction") -> float:
    _need(df, "the accuracy")
    return df.agg(accuracy_of(F.col(truth), F.col(prediction))).first()[0]


def auc_frame(df: DataFrame, truth: str = "label", prediction: str = "prediction", thresholds: int = 100) -> DataFrame:
    """One row with ``auc``: trapezoids under the ROC points of the thresholds 1/n to n/n (strictly above), closed to (1, 1).

    Rows are counted once by how many thresholds they exceed, so the data is read once whatever the number of thresholds;
    all that follows works on as many rows as there are thresholds. null if a class is missing.
    """
    t, p = F.col(truth), F.col(prediction)
    steps = F.transform(F.sequence(F.lit(1), F.lit(thresholds)), lambda i: i / float(thresholds))
    above = F.size(F.filter(steps, lambda x: p > x))
    counts = df.select(same(t, 1.0).alias("pos"), same(t, 0.0).alias("neg"), above.alias("k")).groupBy("k").agg(F.count_if("pos").alias("pos"), F.count_if("neg").alias("neg"))
    grid = df.sparkSession.range(thresholds + 1).select(F.col("id").cast("int").alias("k"))
    every = grid.join(counts, "k", "left").fillna(0, ["pos", "neg"])
    down = Window.orderBy(F.desc("k"))
    whole = Window.partitionBy()
    roc = every.select("k", F.try_divide(F.sum("pos").over(down), F.sum("pos").over(whole)).alias("tpr"), F.try_divide(F.sum("neg").over(down), F.sum("neg").over(whole)).alias("fpr"))
    step = roc.select("k", "tpr", "fpr", F.lead("tpr").over(down).alias("tpr2"), F.lead("fpr").over(down).alias("fpr2"))
    return step.where("k > 0").agg(F.sum(F.when(F.col("k") == 1, (1 - F.col("fpr")) * (1 + F.col("tpr")) / 2).otherwise((F.col("fpr2") - F.col("fpr")) * (F.col("tpr2") + F.col("tpr")) / 2)).alias("auc"))


def auc(df: DataFrame, truth: str = "label", prediction: str = "prediction") -> float:
    value = auc_frame(df, truth, prediction).first()[0]
    if value is None:
        raise ValueError("the area under the curve needs both classes")
    return value

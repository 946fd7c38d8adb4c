"""Residuals, scores and losses of boosting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def residual(label: Column, score: Column) -> Column:
    return label - score


def negative_gradient(label: Column, score: Column) -> Column:
    """Of the squared error: twice the residual."""
    return F.lit(-2.0) * (score - label)


def squared_error(label: Column, score: Column) -> Column:
    return (score - label) * (score - label)


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores, shifted by the largest so that nothing overflows."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def softmax_residuals(label: Column, scores: Column) -> Column:
    """1 - p for the own class and -p for the others."""
    return F.transform(softmax(scores), lambda p, k: F.when(k == label.cast("int"), 1.0 - p).otherwise(-p))


def arg_max(scores: Column) -> Column:
    """Position of the largest score, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def update_score(score: Column, tree: Column, rate: float = 1.0) -> Column:
    return score + F.lit(float(rate)) * tree

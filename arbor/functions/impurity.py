"""Impurities: what a histogram sums, and the impurity and prediction of such sums as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Impurity of an empty node in the distributed dialect.
EMPTY_VARIANCE = 1.7976931348623157e308 / 10
EMPTY_GINI = 1.0
Get = Callable[[str], Column]


class Impurity(Protocol):
    """stats: names of the sums; sums(y, w): what is summed under each name; value, predict: of sums by name."""

    stats: tuple[str, ...]

    def sums(self, y: Column, w: Column) -> dict[str, Column]: ...

    def value(self, of: Get) -> Column: ...

    def predict(self, of: Get) -> Column: ...


@dataclass(frozen=True)
class Variance:
    """Mean squared deviation; a leaf predicts the mean, an empty one 0."""

    empty: float = EMPTY_VARIANCE
    stats: tuple[str, ...] = ("n", "s", "q")

    def sums(self, y: Column, w: Column) -> dict[str, Column]:
        return {"n": w, "s": w * y, "q": w * y * y}

    def value(self, of: Get) -> Column:
        return F.when(of("n") > 0, (of("q") - of("s") * of("s") / of("n")) / of("n")).otherwise(F.lit(self.empty))

    def predict(self, of: Get) -> Column:
        return F.when(of("n") > 0, of("s") / of("n")).otherwise(0.0)


@dataclass(frozen=True)
class Logistic:
    """Variance of the residuals of one of ``classes`` classes; a leaf predicts the Newton step of multi-class logistic loss."""

    classes: int
    empty: float = EMPTY_VARIANCE
    stats: tuple[str, ...] = ("n", "s", "q", "h")

    def sums(self, y: Column, w: Column) -> dict[str, Column]:
        return {"n": w, "s": w * y, "q": w * y * y, "h": w * F.abs(y) * (1 - F.abs(y))}

    def value(self, of: Get) -> Column:
        return Variance(self.empty).value(of)

    def predict(self, of: Get) -> Column:
        return F.when((of("n") > 0) & (of("h") != 0), F.lit((self.classes - 1) / self.classes) * of("s") / of("h")).otherwise(0.0)


@dataclass(frozen=True)
class Gini:
    """1 less the sum of squared shares; a leaf predicts the label of most weight, the smallest of equals."""

    labels: tuple[float, ...]
    empty: float = EMPTY_GINI

    @property
    def stats(self) -> tuple[str, ...]:
        return ("n", *(f"c{i}" for i in range(len(self.labels))))

    def sums(self, y: Column, w: Column) -> dict[str, Column]:
        return {"n": w} | {f"c{i}": F.when(y == F.lit(v), w).otherwise(0) for i, v in enumerate(self.labels)}

    def value(self, of: Get) -> Column:
        out = F.lit(1.0)
        for i in range(len(self.labels)):
            out = out - (of(f"c{i}") / of("n")) * (of(f"c{i}") / of("n"))
        return F.when(of("n") > 0, out).otherwise(F.lit(self.empty))

    def predict(self, of: Get) -> Column:
        best, top = F.lit(float(self.labels[0]) if self.labels else 0.0), of("c0") if self.labels else F.lit(0)
        for i, v in list(enumerate(self.labels))[1:]:
            best, top = F.when(of(f"c{i}") > top, float(v)).otherwise(best), F.greatest(top, of(f"c{i}"))
        return best


def weighted(nl: Column, il: Column, nr: Column, ir: Column) -> Column:
    """Impurity of two children by their weights."""
    return (nl * il + nr * ir) / (nl + nr)

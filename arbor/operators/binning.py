"""Split thresholds by equal frequency, and discretisation, as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.functions.literals import array_literal
from arbor.functions.sampling import bernoulli, binning_fraction

#: One row of doubles per feature; strictly increasing.
Thresholds = list[list[float]]
#: Up to so many thresholds are conditions of a plan; more are searched in array literals.
MOST_CONDITIONS = 1024


def long_form(points: DataFrame) -> DataFrame:
    """``(f, v)`` for every feature value of ``points(features array<double>)``."""
    return points.select(F.posexplode("features").alias("f", "v"))


def value_histogram(points: DataFrame) -> DataFrame:
    """``(f, v, count)``: how often a feature has a value."""
    return long_form(points).groupBy("f", "v").agg(F.count("*").alias("count"))


def _emit_right(vs: Column, bins: int) -> Column:
    """Distributed rule: exactly ``bins - 1`` thresholds, each the first value of its right side."""
    m = F.size(vs)
    n = F.aggregate(vs, F.lit(0.0), lambda a, x: a + x["c"])
    start = F.struct(
        F.lit(1).alias("i"), F.get(vs, F.lit(0))["c"].cast("double").alias("acc"), (n / bins).alias("target"), F.abs(n / bins - F.get(vs, F.lit(0))["c"]).alias("bias"), F.array().cast("array<double>").alias("out")
    )

    def step(a: Column, x: Column) -> Column:
        free, left = bins - 1 - F.size(a["out"]), m - a["i"]
        acc = a["acc"] + x["c"]
        bias = F.abs(a["target"] - acc)
        worse = bias > a["bias"]
        target = a["target"] + n / bins
        grow = F.struct((a["i"] + 1).alias("i"), acc.alias("acc"), a["target"].alias("target"), bias.alias("bias"), a["out"].alias("out"))
        emit = F.struct((a["i"] + 1).alias("i"), acc.alias("acc"), target.alias("target"), F.abs(target - acc).alias("bias"), F.concat(a["out"], F.array(x["v"])).alias("out"))
        force = F.struct((a["i"] + 1).alias("i"), a["acc"].alias("acc"), a["target"].alias("target"), a["bias"].alias("bias"), F.concat(a["out"], F.array(x["v"])).alias("out"))
        return F.when(free < left, F.when(worse, emit).otherwise(grow)).otherwise(force)

    folded = F.aggregate(F.slice(vs, F.lit(2), F.greatest(m - 1, F.lit(0))), start, step, lambda a: a["out"])
    return F.when(m <= bins, F.transform(F.slice(vs, F.lit(2), F.greatest(m - 1, F.lit(0))), lambda x: x["v"])).otherwise(folded)


def _emit_left(vs: Column, bins: int) -> Column:
    """Local rule: at most ``bins - 1`` thresholds, each the last value of its left side."""
    m = F.size(vs)
    n = F.aggregate(vs, F.lit(0.0), lambda a, x: a + x["c"])
    first = F.get(vs, F.lit(0))
    start = F.struct(first["c"].cast("double").alias("acc"), (n / bins).alias("target"), first["v"].alias("last"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        acc = a["acc"] + x["c"]
        emit = (F.abs(a["target"] - a["acc"]) < F.abs(a["target"] - acc)) & (F.size(a["out"]) < bins - 1)
        return F.struct(
            acc.alias("acc"), F.when(emit, a["target"] + n / bins).otherwise(a["target"]).alias("target"), x["v"].alias("last"), F.when(emit, F.concat(a["out"], F.array(a["last"]))).otherwise(a["out"]).alias("out")
        )

    folded = F.aggregate(F.slice(vs, F.lit(2), F.greatest(m - 1, F.lit(0))), start, step, lambda a: a["out"])
    return F.when(m <= bins - 1, F.transform(F.slice(vs, F.lit(1), F.greatest(m - 1, F.lit(0))), lambda x: x["v"])).otherwise(folded)


def split_thresholds(points: DataFrame, max_bins: int = 32, dialect: str = "distributed") -> DataFrame:
    """``(f, thresholds array<double>)`` from all rows of ``points``; the values of a feature meet in one row, so give it a sample."""
    sorted_values = F.array_sort(F.collect_list(F.struct("v", F.col("count").cast("double").alias("c"))))
    each = value_histogram(points).groupBy("f").agg(sorted_values.alias("vs"))
    emit = _emit_right if dialect == "distributed" else _emit_left
    return each.select("f", emit(F.col("vs"), max_bins).alias("thresholds"))


def find_thresholds(points: DataFrame, n_features: int, max_bins: int, bin_samples: int, dialect: str, seed: int, rows: int, key: Column | None = None) -> Thresholds:
    """Thresholds by feature from a sample of about ``max(max_bins^2, bin_samples)`` rows, drawn by ``key`` if there is one; as
    many values as features and bins come to the driver. NaN is refused: its order differs between binning and scoring. The
    local dialect refuses constants.
    """
    bins = max_bins if dialect == "distributed" else max(2, min(max_bins, rows))
    sample = bernoulli(points, binning_fraction(bins, bin_samples, rows), seed, key).select("features")
    found = {r["f"]: list(r["thresholds"]) for r in split_thresholds(sample, bins, dialect).collect()}
    if any(v != v for t in found.values() for v in t):
        raise ValueError("a feature holds NaN")
    if dialect == "local" and (flat := [f for f in range(n_features) if not found.get(f)]):
        raise ValueError(f"features {flat} are constant")
    return [found.get(f, []) for f in range(n_features)]


def splits_frame(points: DataFrame, max_bins: int = 32, dialect: str = "distributed") -> DataFrame:
    """``(f, s, threshold)``, a row for each split."""
    return split_thresholds(points, max_bins, dialect).select("f", F.posexplode("thresholds").alias("s", "threshold"))


def bin_of(value: Column, thresholds: Column, dialect: str = "distributed") -> Column:
    """Number of thresholds at or below a value (distributed), or below it (local)."""
    return F.size(F.filter(thresholds, (lambda t: t <= value) if dialect == "distributed" else (lambda t: t < value)))


def bin_by_search(value: Column, thresholds: list[float], dialect: str = "distributed") -> Column:
    """:func:`bin_of` as a binary search of conditions, which is compiled; the expression grows with the thresholds."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        t = F.lit(float(thresholds[mid]))
        return F.when(t <= value if dialect == "distributed" else t < value, search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(thresholds))


def binned(features: Column, thresholds: Thresholds, dialect: str = "distributed") -> Column:
    """Bins of an array of feature values. While all features have few thresholds in total, they are searched by conditions."""
    few = sum(map(len, thresholds)) <= MOST_CONDITIONS and max(map(len, thresholds), default=0) <= 255
    of = (lambda v, t: bin_by_search(v, t, dialect)) if few else (lambda v, t: bin_of(v, array_literal(t, "double"), dialect))
    return F.array(*(of(F.get(features, F.lit(f)), t) for f, t in enumerate(thresholds)))

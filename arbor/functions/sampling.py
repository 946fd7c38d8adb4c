"""Seeded sampling as hash expressions: the same row is drawn alike in any partitioning and on any retry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_M, _A, _C = 2147483648, 1103515245, 12345
#: The stream of draws for samples; trees draw from streams of their numbers.
SAMPLE_STREAM = 104729


def uniform(key: Column, seed: int, stream: Column | int = 0) -> Column:
    """A number in [0, 1) from an integer key by two linear congruential steps, which SQL engines share."""
    first = F.pmod(F.pmod(key.cast("long"), F.lit(_M)) * _A + F.lit(seed * _C) + F.lit(7919) * stream, F.lit(_M))
    return F.pmod(F.pmod(first * _A + _C, F.lit(_M)) * _A + _C, F.lit(_M)) / F.lit(float(_M))


def uniform_sql(key: str, seed: int, stream: str = "0") -> str:
    """:func:`uniform` in SQL, for keys from 0."""
    return f"((((({key} % {_M}) * {_A} + {seed * _C} + 7919 * {stream}) % {_M}) * {_A} + {_C}) % {_M} * {_A} + {_C}) % {_M} / {float(_M)}"


def uniform_value(key: int, seed: int, stream: int = 0) -> float:
    """:func:`uniform` on the driver."""
    first = ((key % _M) * _A + seed * _C + 7919 * stream) % _M
    return (((first * _A + _C) % _M) * _A + _C) % _M / _M


def poisson_thresholds(mean: float, most: int = 16) -> list[float]:
    """Cumulative probabilities of 0, 1, ... below ``most`` draws."""
    out, term, total = [], math.exp(-mean), 0.0
    for k in range(most):
        total += term
        out.append(round(total, 12))
        term *= mean / (k + 1)
    return out


def poisson_weight(key: Column, rate: float, seed: int, tree: Column | int = 0) -> Column:
    """Bootstrap weight: Poisson of mean ``rate`` by inversion where rate < 1, else 1. Rows of weight 0 stay."""
    if rate >= 1:
        return F.lit(1)
    u = uniform(key, seed, tree)
    cuts = poisson_thresholds(rate)
    out = F.when(u < cuts[0], 0)  # most rows are done after a comparison or two
    for k, t in enumerate(cuts[1:], start=1):
        out = out.when(u < t, k)
    return out.otherwise(len(cuts))


def subset_size(n_features: int, col_rate: float) -> int:
    """How many features a node looks at."""
    return math.ceil(n_features * col_rate)


def feature_subset(n_features: int, col_rate: float, seed: int, tree: int, node: int) -> list[int]:
    """The features of a node: the first of them by hash, ties by number; all where col_rate is 1."""
    if col_rate >= 1 - 1e-6:
        return list(range(n_features))
    order = sorted(range(n_features), key=lambda f: (uniform_value(node * 4099 + f, seed, tree), f))
    return sorted(order[: subset_size(n_features, col_rate)])


def binning_fraction(max_bins: int, bin_samples: int, rows: int) -> float:
    """Share of the rows from which split thresholds are found."""
    wanted = max(max_bins * max_bins, bin_samples)
    return 1.0 if rows <= wanted else wanted / rows


def bernoulli(df: DataFrame, fraction: float, seed: int, key: Column | None = None) -> DataFrame:
    """Rows drawn without replacement with probability ``fraction``: each for itself, however many are equal.

    By a hash of ``key``, a row id, alike in any partitioning. Without one by the engine's sample, which draws by the place of a
    row in its partition and so alike on a retry.
    """
    if fraction >= 1:
        return df
    if key is None:
        return df.sample(False, fraction, seed)
    return df.where(uniform(key, seed, SAMPLE_STREAM) < fraction)


def hash_split(df: DataFrame, key: Column, weights: list[float], seed: int) -> list[DataFrame]:
    """Disjoint parts of ``df`` in proportion to ``weights``, by a hash of ``key``."""
    total, edge, out = sum(weights), 0.0, []
    u = uniform(key, seed)
    for i, w in enumerate(weights):
        top = 1.0 if i == len(weights) - 1 else edge + w / total
        out.append(df.where((u >= edge) & (u < top)))
        edge = top
    return out

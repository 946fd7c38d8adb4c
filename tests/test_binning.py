"""Split thresholds and bins against known values and a direct restatement."""

import random

import pytest
from pyspark.sql import functions as F

from arbor.operators import binning as b

A, B = [1, 1, 2, 3, 3, 3, 4, 5], [1] * 50 + list(range(2, 12))
GOLDEN = [
    (A, 3, "distributed", [3, 4]),
    (A, 3, "local", [2, 3]),
    (B, 4, "distributed", [2, 3, 4]),
    (B, 4, "local", [1, 2, 3]),
    ([1, 2, 3, 4], 4, "distributed", [2, 3, 4]),
    ([1, 2, 3, 4], 4, "local", [1, 2, 3]),
    (list(range(1, 11)), 5, "distributed", [3, 5, 7, 9]),
    (list(range(1, 11)), 5, "local", [2, 4, 6, 8]),
    ([7, 7, 7], 4, "distributed", []),
]


def frame(spark, values):
    return spark.createDataFrame([([float(v)],) for v in values], "features array<double>")


@pytest.mark.parametrize("values,bins,dialect,want", GOLDEN)
def test_known_thresholds(spark, values, bins, dialect, want):
    assert b.find_thresholds(frame(spark, values), 1, bins, 1 << 30, dialect, 1, len(values) + 100) == [want]


def test_local_refuses_constants_and_both_refuse_nan(spark):
    with pytest.raises(ValueError, match="constant"):
        b.find_thresholds(frame(spark, [7, 7]), 1, 4, 10, "local", 1, 2)
    with pytest.raises(ValueError, match="NaN"):
        b.find_thresholds(frame(spark, [1, 2, float("nan")]), 1, 4, 10, "distributed", 1, 3)


def restated(values, bins):
    kinds = sorted(set(values))
    if len(kinds) <= bins:
        return kinds[1:]
    count = [values.count(v) for v in kinds]
    acc, target, out = count[0], len(values) / bins, []
    bias = abs(target - acc)
    for i in range(1, len(kinds)):
        if bins - 1 - len(out) < len(kinds) - i:
            acc += count[i]
            new = abs(target - acc)
            if new > bias:
                out.append(kinds[i])
                target += len(values) / bins
                new = abs(target - acc)
            bias = new
        else:
            out.append(kinds[i])
    return out


def test_thresholds_equal_a_restatement(spark):
    rng = random.Random(3)
    for _ in range(3):
        values = [float(int(rng.expovariate(0.1))) for _ in range(300)]
        got = b.find_thresholds(frame(spark, values), 1, 8, 1 << 30, "distributed", 1, 300)[0]
        assert got == restated(values, 8)
        assert got == sorted(set(got)) and len(got) == 7


def test_bins(spark):
    rows = spark.createDataFrame([(v,) for v in (1.0, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0)], "v double")
    right = rows.select(b.binned(F.array("v"), [[3.0, 4.0]])[0].alias("b"))
    left = rows.select(b.binned(F.array("v"), [[2.0, 3.0]], "local")[0].alias("b"))
    assert [r["b"] for r in right.collect()] == [0, 0, 0, 1, 1, 2, 2]
    assert [r["b"] for r in left.collect()] == [0, 0, 1, 1, 2, 2, 2]


@pytest.mark.parametrize("dialect", ["distributed", "local"])
def test_search_equals_count(spark, dialect):
    cuts = [[1.0, 2.0, 5.0, 7.0, 7.5], [], [0.0]]
    rows = [([v / 2, v / 3, v - 4.0],) for v in range(-3, 20)] + [([None, None, None],)]
    df = spark.createDataFrame(rows, "features array<double>")
    plain = F.array(*(b.bin_of(F.get("features", F.lit(f)), F.array(*map(F.lit, t)).cast("array<double>"), dialect) for f, t in enumerate(cuts)))
    assert df.where(~b.binned(F.col("features"), cuts, dialect).eqNullSafe(plain)).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_rows_are_drawn_each_for_itself(spark, seed):
    """Few different rows, many times each: a sample of rows holds all of them, and so all thresholds are found."""
    points = spark.range(60000).select("id", F.array((F.col("id") % 3).cast("double"), (F.col("id") % 2).cast("double")).alias("features"))
    for key in (None, F.col("id")):
        assert b.find_thresholds(points, 2, 32, 100, "distributed", seed, 60000, key) == [[1.0, 2.0], [1.0]]


def test_samples_have_their_size(spark):
    from arbor.functions.sampling import bernoulli

    rows = spark.range(40000)
    for key in (None, F.col("id")):
        assert abs(bernoulli(rows, 0.1, 5, key).count() - 4000) < 300
    assert bernoulli(rows, 1.0, 5).count() == 40000

"""Growth, scoring, ensembles and storage of trees."""

import pytest
from pyspark.sql import functions as F

from arbor.functions import impurity as imp
from arbor.functions import sampling
from arbor.operators import grow as g
from arbor.operators import models as m
from arbor.operators import tree as t
from arbor.plans.params import BoostParams, ForestParams, MultiBoostParams, TreeParams, from_json
from arbor.sources.libsvm import assemble

X, Y = [1, 1, 2, 3, 3, 3, 4, 5], [1, 1, 2, 6, 6, 6, 8, 8]


def small(spark):
    return spark.createDataFrame([(float(y), [float(x)]) for x, y in zip(X, Y, strict=True)], "label double, features array<double>")


def lines(spark, sf, label="l_quantity"):
    return assemble(spark.read.parquet(f"{sf}/lineitem.parquet"), F.expr(label), ["l_discount", "l_tax", "l_linenumber", F.round(F.col("l_extendedprice") / 100)])


def test_candidates_of_a_known_set(spark):
    rows = spark.createDataFrame([(0, 0, 1, float(y), 1, [x - 1]) for x, y in zip(X, Y, strict=True)], "tree_id int, class_id int, node_id long, y double, w int, bins array<int>")
    cand = {r["s"]: r for r in g.candidates(g.level_histogram(rows, imp.Variance()), imp.Variance(), 1).collect()}
    assert [round(cand[s]["wi"], 6) for s in range(4)] == [3, 0.683333, 4.166667, 6.178571]
    assert (round(cand[1]["pl"], 6), round(cand[1]["pr"], 6)) == (1.333333, 6.8)
    assert 3 not in {r["s"] for r in g.candidates(g.level_histogram(rows, imp.Variance()), imp.Variance(), 2).collect()}


def test_known_tree(spark):
    model = m.train_tree(small(spark), TreeParams(max_depth=1, min_node_size=2))
    root = model.nodes[0]
    assert (root.split_f, root.threshold, root.count, round(root.impurity, 4)) == (0, 3.0, 8, 7.6875)
    assert [round(n.predict, 6) for n in model.nodes[1:]] == [1.333333, 6.8]


def test_gini_of_known_counts(spark):
    r = spark.range(1).select(imp.Gini((0.0, 1.0)).value(lambda n: F.lit({"n": 8, "c0": 6, "c1": 2}[n])).alias("a"), imp.Gini((0.0, 1.0, 2.0)).value(lambda n: F.lit({"n": 8, "c0": 3, "c1": 3, "c2": 2}[n])).alias("b")).first()
    assert (r["a"], r["b"]) == (0.375, 0.65625)


def test_single_class_and_constant_features_make_a_leaf(spark):
    one = spark.createDataFrame([(1.0, [float(i)]) for i in range(40)], "label double, features array<double>")
    assert len(m.train_tree(one, TreeParams(impurity="Gini", min_node_size=1)).nodes) == 1
    flat = spark.createDataFrame([(float(i), [7.0]) for i in range(40)], "label double, features array<double>")
    assert len(m.train_tree(flat, TreeParams(min_node_size=1)).nodes) == 1
    with pytest.raises(ValueError):
        m.train_tree(flat, TreeParams(dialect="local"))
    with pytest.raises(ValueError):
        m.train_tree(flat.where("false"))


def test_invariants_and_partitions(spark, sf):
    points = lines(spark, sf)
    p = TreeParams(max_depth=4, min_node_size=40, bin_samples=1 << 30)
    a, b = m.train_tree(points, p).nodes, m.train_tree(points.repartition(7), p).nodes
    assert a == b
    by = {n.node_id: n for n in a}
    for n in a:
        if not n.is_leaf:
            left, right = by[2 * n.node_id], by[2 * n.node_id + 1]
            assert left.count + right.count == n.count
            assert (left.count * left.impurity + right.count * right.impurity) / n.count <= n.impurity
            assert min(left.count, right.count) >= 40


def test_three_ways_to_score_agree(spark, sf):
    points = lines(spark, sf)
    model = m.train_tree(points, TreeParams(max_depth=5, min_node_size=20, bin_samples=1 << 30))
    one = model.predict(points)
    joined = t.predict_by_join(one, model.frame(spark), 5, out="joined")
    assert joined.where("prediction <> joined").count() == 0
    data = m.prepare(points, model.params)
    mean = data.rows.select(t.predict_bins(model.nodes, F.col("bins")).alias("p")).agg(F.sum("p")).first()[0]
    assert abs(mean - one.agg(F.sum("prediction")).first()[0]) < 1e-6


def test_save_and_load(spark, sf, tmp_path):
    for model in (
        m.train_tree(small(spark), TreeParams(max_depth=2, min_node_size=1)),
        m.train_forest(small(spark), ForestParams(num_trees=2, min_node_size=1)),
        m.train_boost(small(spark), params=BoostParams(num_round=2, min_node_size=1))[0],
        m.train_multi_boost(small(spark).withColumn("label", F.col("label") % 2), MultiBoostParams(num_round=2, min_node_size=1)),
    ):
        model.save(spark, str(tmp_path / "model"))
        again = m.load_model(spark, str(tmp_path / "model"))
        assert type(again) is type(model) and again.nodes == model.nodes and again.params == model.params


def test_known_gamma(spark):
    points = spark.createDataFrame([(float(y), [0.0]) for y in (0, 0, 1, 2)], "label double, features array<double>")
    model = m.train_multi_boost(points, MultiBoostParams(num_round=1))
    assert [round(n.predict, 9) for n in model.nodes] == [0.5, -0.25, -0.25]


def test_boosting_improves_and_stops(spark, sf):
    points = lines(spark, sf)
    _, found = m.train_boost(points, {"same": points}, BoostParams(num_round=7, max_depth=3, learn_rate=0.5, bin_samples=1 << 30))
    train = [v for _, n, v in found if n == "train"]
    assert train == sorted(train, reverse=True) and len(train) == 7
    assert all(abs(a - b) < 1e-9 for a, b in zip(train, [v for _, n, v in found if n == "same"], strict=True))
    model, found = m.train_boost(points, params=BoostParams(num_round=6, max_depth=2, dialect="local", min_step=1e9, bin_samples=1 << 30))
    assert len(found) == 2 and len(model.trees()) == 1


def test_forest_votes(spark):
    votes = [[1.0, 2.0, 2.0], [3.0, 1.0, 2.0]]
    model = m.ForestModel(ForestParams(impurity="Gini"), [t.Node(i, 0, 1, 0, 1, 0, v) for i, v in enumerate(votes[0])])
    assert model.predict(small(spark)).select("prediction").distinct().collect()[0][0] == 2.0
    model = m.ForestModel(ForestParams(impurity="Gini"), [t.Node(i, 0, 1, 0, 1, 0, v) for i, v in enumerate(votes[1])])
    assert model.predict(small(spark)).select("prediction").distinct().collect()[0][0] == 1.0


def test_quality_is_near_spark_ml(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor

    points = lines(spark, sf)
    model = m.train_tree(points, TreeParams(max_depth=5, bin_samples=1 << 30))
    from arbor.functions.metrics import rmse

    ours = rmse(model.predict(points))
    flat = points.select("label", *(F.col("features")[i].alias(f"f{i}") for i in range(4)))
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(4)], outputCol="v").transform(flat)
    theirs = DecisionTreeRegressor(featuresCol="v", maxDepth=5, minInstancesPerNode=15).fit(vectors).transform(vectors)
    assert ours <= rmse(theirs) * 1.02


def test_params(spark):
    p = ForestParams(impurity="gini", num_trees=3)
    assert from_json(p.to_json()) == p and p.impurity == "Gini"
    for bad in (dict(impurity="entropy"), dict(dialect="x"), dict(dialect="local", impurity="Gini"), dict(max_bins=1)):
        with pytest.raises(ValueError):
            TreeParams(**bad)
    with pytest.raises(ValueError):
        BoostParams(impurity="Gini")


def test_nested_conditions_equal_the_walk(spark, monkeypatch):
    points = spark.createDataFrame([(float(i * 7 % 11), [float(i % 13), float(i * 5 % 17)]) for i in range(400)], "label double, features array<double>")
    model = m.train_tree(points, TreeParams(max_depth=4, min_node_size=5))
    assert 8 < len(model.nodes) <= t.MOST_NESTED
    nested = model.predict(points).collect()
    monkeypatch.setattr(t, "MOST_NESTED", 0)
    assert model.predict(points).collect() == nested


def test_labels_that_are_not_classes_are_refused(spark):
    for bad in ([0.0, 0.5], [0.0, 1e9], [-1.0, 1.0]):
        points = spark.createDataFrame([(y, [float(i)]) for i, y in enumerate(bad * 20)], "label double, features array<double>")
        with pytest.raises(ValueError, match="whole numbers"):
            m.train_multi_boost(points)


def test_equal_rows_draw_weights_of_their_own(spark):
    points = spark.range(4000).select(F.lit(1.0).alias("label"), F.array(F.lit(2.0)).alias("features"))
    data = m.prepare(points, TreeParams())
    weights = data.rows.select(sampling.poisson_weight(F.col("key"), 0.6, 3).alias("w")).groupBy("w").count().collect()
    assert len(weights) >= 3 and abs(sum(r["w"] * r["count"] for r in weights) / 4000 - 0.6) < 0.06

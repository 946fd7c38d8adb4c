"""A grown tree as rows on the driver and as columns in a plan: scoring, routing, the nodes table and its text form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbor.functions.literals import array_literal

NODES = "tree_id int, class_id int, node_id long, depth int, count double, impurity double, predict double, is_leaf boolean, split_f int, split_s int, threshold double"
#: Trees of up to so many nodes are compiled conditions; larger methods aren't compiled to machine code.
MOST_NESTED = 63


@dataclass
class Node:
    tree_id: int
    class_id: int
    node_id: int
    depth: int
    count: float
    impurity: float
    predict: float
    is_leaf: bool = True
    split_f: int | None = None
    split_s: int | None = None
    threshold: float | None = None

    @property
    def row(self) -> tuple:
        return (
            self.tree_id, self.class_id, self.node_id, self.depth, float(self.count), float(self.impurity), float(self.predict), self.is_leaf, self.split_f, self.split_s,
            self.threshold,
        )


def nodes_frame(spark: SparkSession, nodes: list[Node]) -> DataFrame:
    return spark.createDataFrame([n.row for n in nodes], NODES)


def nodes_of(frame: DataFrame) -> list[Node]:
    """Nodes of a table, which a model bounds, in order of tree, class and id."""
    names = [p.strip().split()[0] for p in NODES.split(",")]
    return [Node(*r) for r in frame.select(*names).orderBy("tree_id", "class_id", "node_id").collect()]


def _descend(nodes: list[Node], goes_right: Callable[[Column, Column], Column], cut: str, result: str, kind: str) -> Column:
    """Walk one tree from its root in an expression. goes_right: by split feature and cut, the node's value named ``cut``.

    Small trees are nested conditions, which are compiled. In larger ones nodes are array positions, so that the plan doesn't
    grow with depth.
    """
    nodes = sorted(nodes, key=lambda n: n.node_id)
    at = {n.node_id: i for i, n in enumerate(nodes)}
    kind_of_cut = "int" if cut == "split_s" else "double"
    if len(nodes) <= MOST_NESTED:

        def below(node_id: int) -> Column:
            n = nodes[at[node_id]]
            if n.is_leaf:
                return F.lit(getattr(n, result)).cast(kind)
            return F.when(goes_right(F.lit(n.split_f), F.lit(getattr(n, cut)).cast(kind_of_cut)), below(2 * node_id + 1)).otherwise(below(2 * node_id))

        return below(1)
    left = [0 if n.is_leaf else at[2 * n.node_id] for n in nodes]
    right = [0 if n.is_leaf else at[2 * n.node_id + 1] for n in nodes]
    out = array_literal([getattr(n, result) for n in nodes], kind)
    lefts, rights = array_literal(left, "int"), array_literal(right, "int")
    features, cuts = array_literal([n.split_f or 0 for n in nodes], "int"), array_literal([getattr(n, cut) or 0 for n in nodes], kind_of_cut)

    def step(i: Column, _: Column) -> Column:
        return F.when(F.get(lefts, i) == 0, i).when(goes_right(F.get(features, i), F.get(cuts, i)), F.get(rights, i)).otherwise(F.get(lefts, i))

    return F.get(out, F.aggregate(array_literal(range(max(n.depth for n in nodes)), "int"), F.lit(0), step))


def _right_of_bins(bins: Column) -> Callable[[Column, Column], Column]:
    return lambda f, s: F.get(bins, f) > s


def leaf_of_bins(nodes: list[Node], bins: Column) -> Column:
    """Node id that a binned row has reached in one tree."""
    return _descend(nodes, _right_of_bins(bins), "split_s", "node_id", "bigint")


def leaves_of_bins(rows: DataFrame, trees: dict[tuple[int, int], list[Node]]) -> DataFrame:
    """``rows(tree_id, class_id, bins, ...)`` with ``node_id``, the node reached in the tree of that id and class; null where there
    is none.

    The nodes of all trees are positions in shared arrays, and a level is one step from a position to the next, so neither
    the number of trees nor their size makes the compiled loop longer; only the depth does.
    """
    flat = [n for key in sorted(trees) for n in sorted(trees[key], key=lambda n: n.node_id)]
    at = {(n.tree_id, n.class_id, n.node_id): i for i, n in enumerate(flat)}
    first, classes = min(t for t, _ in trees), max(k for _, k in trees) + 1
    slots = (max(t for t, _ in trees) - first + 1) * classes
    roots = array_literal([at.get((first + i // classes, i % classes, 1), -1) for i in range(slots)], "int")
    feature = array_literal([-1 if n.is_leaf else n.split_f for n in flat], "int")
    cut = array_literal([0 if n.is_leaf else n.split_s for n in flat], "int")
    left = array_literal([0 if n.is_leaf else at[n.tree_id, n.class_id, 2 * n.node_id] for n in flat], "int")
    place = F.col("_place")
    out = rows.withColumn("_place", F.get(roots, (F.col("tree_id") - first) * classes + F.col("class_id")))
    for _ in range(max(n.depth for n in flat)):
        right = F.get(F.col("bins"), F.get(feature, place)) > F.get(cut, place)
        out = out.withColumn("_place", F.when(F.get(feature, place) < 0, place).otherwise(F.get(left, place) + right.cast("int")))
    return out.withColumn("node_id", F.get(array_literal([n.node_id for n in flat], "bigint"), place)).drop("_place")


def predict_bins(nodes: list[Node], bins: Column) -> Column:
    """Prediction of one tree for a binned row, equal to what its raw values give."""
    return _descend(nodes, _right_of_bins(bins), "split_s", "predict", "double")


def predict_tree(nodes: list[Node], features: Column, dialect: str = "distributed") -> Column:
    """Prediction of one tree for an array of raw feature values; a missing value reads as 0."""

    def right(f: Column, t: Column) -> Column:
        v = F.coalesce(F.get(features, f), F.lit(0.0))
        return v >= t if dialect == "distributed" else v > t

    return _descend(nodes, right, "threshold", "predict", "double")


def predict_by_join(points: DataFrame, nodes: DataFrame, depth: int, dialect: str = "distributed", out: str = "prediction") -> DataFrame:
    """:func:`predict_tree` for a tree of any size: one join with the nodes table per level. Spark broadcasts the table only
    below its own size threshold."""
    table = nodes.select(F.col("node_id").alias("_n"), F.col("is_leaf").alias("_leaf"), F.col("split_f").alias("_f"), F.col("threshold").alias("_t"), F.col("predict").alias("_p"))
    rows = points.withColumn("_node", F.lit(1).cast("long"))
    value = F.coalesce(F.get("features", F.col("_f")), F.lit(0.0))
    right = value >= F.col("_t") if dialect == "distributed" else value > F.col("_t")
    for _ in range(depth):
        step = rows.join(table, F.col("_node") == F.col("_n"), "left")
        rows = step.withColumn("_node", F.when(F.col("_leaf"), F.col("_node")).otherwise(2 * F.col("_node") + right.cast("int"))).drop("_n", "_leaf", "_f", "_t", "_p")
    return rows.join(table, F.col("_node") == F.col("_n"), "left").withColumn(out, F.col("_p")).drop("_node", "_n", "_leaf", "_f", "_t", "_p")


def structure(nodes: DataFrame) -> DataFrame:
    """``(tree_id, class_id, ord, line)``: the nodes of every tree depth first, a line each, indented by ``|---``.

    The path of a node as a string of 0 and 1 sorts parents before children and left before right.
    """
    path = F.substring(F.conv(F.col("node_id").cast("string"), 10, 2), 2, 64)
    leaf = F.format_string("predict=%.6f", "predict")
    split = F.format_string("f%d < %.6f", "split_f", "threshold")
    line = F.concat(F.repeat(F.lit("|---"), F.col("depth")), F.format_string("node %d: n=%.0f impurity=%.6f ", "node_id", "count", "impurity"), F.when(F.col("is_leaf"), leaf).otherwise(split))
    order = Window.partitionBy("tree_id", "class_id").orderBy(path)
    return nodes.select("tree_id", "class_id", F.row_number().over(order).alias("ord"), line.alias("line"))

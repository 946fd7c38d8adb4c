"""Level-wise growth of many trees at once.

Every level is one plan: route rows to their nodes by an expression over the trees so far, group sums by (tree, class, node,
feature, bin), running sums over bins, the best split of each node; only those rows, as many as the frontier has nodes, come
to the driver. Trees and classes share the pass through their place in the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbor.functions import impurity as imp
from arbor.functions.sampling import feature_subset
from arbor.operators.binning import Thresholds
from arbor.operators.tree import MOST_NESTED, Node, leaf_of_bins, leaves_of_bins
from arbor.plans.params import TreeParams

KEY = ["tree_id", "class_id", "node_id"]


def level_histogram(rows: DataFrame, impurity: imp.Impurity) -> DataFrame:
    """Sums of the impurity's statistics by (tree, class, node, feature, bin) of ``rows(tree_id, class_id, node_id, y, w, bins)``.

    Partial sums are made before the shuffle, so what travels is bounded by tasks times histogram slots, not rows.
    """
    long = rows.select(*KEY, "y", "w", F.posexplode("bins").alias("f", "bin"))
    return long.groupBy(*KEY, "f", "bin").agg(*(F.sum(c.cast("double")).alias(n) for n, c in impurity.sums(F.col("y"), F.col("w")).items()))


def prefix_sums(hist: DataFrame, impurity: imp.Impurity) -> DataFrame:
    """The histogram with the state left of each split (``l_*``: this bin and lower ones) and right of it (``r_*``)."""
    run = Window.partitionBy(*KEY, "f").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*KEY, "f")
    left = hist.select("*", *(F.sum(n).over(run).alias(f"l_{n}") for n in impurity.stats), *(F.sum(n).over(whole).alias(f"t_{n}") for n in impurity.stats))
    return left.select(*hist.columns, *(f"l_{n}" for n in impurity.stats), *((F.col(f"t_{n}") - F.col(f"l_{n}")).alias(f"r_{n}") for n in impurity.stats))


def candidates(hist: DataFrame, impurity: imp.Impurity, min_child: float) -> DataFrame:
    """``(key, f, s, wi, il, ir, pl, pr, nl, nr)`` of every split with weight on both sides and ``min_child`` at least."""
    states = prefix_sums(hist, impurity)
    left, right = (lambda n: F.col(f"l_{n}")), (lambda n: F.col(f"r_{n}"))
    ok = states.where((left("n") > 0) & (right("n") > 0) & (left("n") >= min_child) & (right("n") >= min_child))
    sides = ok.select(
        *KEY, "f", F.col("bin").alias("s"), left("n").alias("nl"), right("n").alias("nr"), impurity.value(left).alias("il"), impurity.value(right).alias("ir"), impurity.predict(left).alias("pl"), impurity.predict(right).alias("pr")
    )
    return sides.withColumn("wi", imp.weighted(F.col("nl"), F.col("il"), F.col("nr"), F.col("ir")))


def best_splits(cand: DataFrame) -> DataFrame:
    """One row per node: the candidate of least weighted impurity (to 9 digits), then lowest feature, then lowest split."""
    order = F.struct(F.round("wi", 9).alias("w9"), "f", "s", "wi", "nl", "nr", "il", "ir", "pl", "pr")
    return cand.groupBy(*KEY).agg(F.min(order).alias("b")).select(*KEY, "b.*").drop("w9")


def node_stats(rows: DataFrame, impurity: imp.Impurity) -> DataFrame:
    """``(key, rows, n, impurity, predict)`` of every node that has rows, in one aggregation."""
    sums = impurity.sums(F.col("y"), F.col("w"))
    agg = rows.groupBy(*KEY).agg(F.count("*").alias("rows"), *(F.sum(c.cast("double")).alias(n) for n, c in sums.items()))
    return agg.select(*KEY, "rows", "n", impurity.value(F.col).alias("impurity"), impurity.predict(F.col).alias("predict"))


def routed(rows: DataFrame, nodes: dict[tuple[int, int], list[Node]], only: set[tuple[int, int]] | None = None) -> DataFrame:
    """``rows(tree_id, class_id, bins, ...)`` with node_id, by the trees so far."""
    live = {key: tree for key, tree in nodes.items() if only is None or key in only}
    if len(live) > 1 or any(len(tree) > MOST_NESTED for tree in live.values()):
        return leaves_of_bins(rows, live)
    out: Column = F.lit(None).cast("long")
    for (t, k), tree in live.items():
        out = F.when((F.col("tree_id") == t) & (F.col("class_id") == k), leaf_of_bins(tree, F.col("bins"))).otherwise(out)
    return rows.withColumn("node_id", out)


def grow(rows: DataFrame, thresholds: Thresholds, impurity: imp.Impurity, p: TreeParams) -> list[Node]:
    """Trees of ``rows(tree_id, class_id, y, w, bins)``, one for each (tree_id, class_id) that has rows.

    ``rows`` is read once a level, and should be cached or stored by the caller. Nodes at max_depth are not aggregated, as
    they can't split. No candidate (all features constant, a single class) makes a leaf.
    """
    n_features = len(thresholds)
    local = p.dialect == "local"
    grown: dict[tuple[int, int], list[Node]] = {}
    for r in node_stats(rows.withColumn("node_id", F.lit(1).cast("long")), impurity).collect():
        grown[r["tree_id"], r["class_id"]] = [Node(r["tree_id"], r["class_id"], 1, 0, r["n"] if local else r["rows"], r["impurity"], r["predict"])]
    frontier = [n for tree in grown.values() for n in tree]
    spark = rows.sparkSession
    rows = rows.where("w > 0")  # the others count in no sum, and a bin with no other rows adds no better split
    for depth in range(p.max_depth):
        if local:
            frontier = [n for n in frontier if n.count > p.min_node_size]
        if not frontier:
            break
        live = {(n.tree_id, n.class_id) for n in frontier}
        at = routed(rows.where(F.col("tree_id").isin(sorted({t for t, _ in live}))), grown, live).where(F.col("node_id") >= (1 << depth))
        hist = level_histogram(at, impurity)
        if p.col_rate < 1 - 1e-6:  # as many rows as the frontier has nodes times features
            chosen = [(n.tree_id, n.class_id, n.node_id, f) for n in frontier for f in feature_subset(n_features, p.col_rate, p.seed, n.tree_id, n.node_id)]
            hist = hist.join(spark.createDataFrame(chosen, "tree_id int, class_id int, node_id long, f int"), [*KEY, "f"])
        found = {(r["tree_id"], r["class_id"], r["node_id"]): r for r in best_splits(candidates(hist, impurity, 0 if local else p.min_node_size)).collect()}
        new = []
        for n in frontier:
            b = found.get((n.tree_id, n.class_id, n.node_id))
            if b is None or n.impurity - b["wi"] < p.min_info_gain:
                continue
            n.is_leaf, n.split_f, n.split_s, n.threshold = False, b["f"], b["s"], thresholds[b["f"]][b["s"]]
            new += [
                Node(n.tree_id, n.class_id, 2 * n.node_id, depth + 1, b["nl"], b["il"], b["pl"]),
                Node(n.tree_id, n.class_id, 2 * n.node_id + 1, depth + 1, b["nr"], b["ir"], b["pr"]),
            ]
        for n in new:
            grown[n.tree_id, n.class_id].append(n)
        frontier = new
    return [n for key in sorted(grown) for n in sorted(grown[key], key=lambda n: n.node_id)]

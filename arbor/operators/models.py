"""Trained models: a nodes table and hyper-parameters. Scoring is a projection, so it works on streams too."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.functions import impurity as imp
from arbor.functions import loss
from arbor.functions.metrics import rmse_of
from arbor.functions.sampling import poisson_weight
from arbor.operators import grow as g
from arbor.operators.binning import Thresholds, binned, find_thresholds
from arbor.operators.tree import Node, nodes_frame, nodes_of, predict_bins, predict_tree, structure
from arbor.plans.params import BoostParams, ForestParams, MultiBoostParams, TreeParams, from_json
from arbor.plans.storage import discard, store

#: Rounds of boosting between two stored score tables: an expression holds that many trees per class at most.
STORE_EVERY = 5
#: Trees that grow in one pass have so many nodes at most: plans hold them as arrays.
MOST_NODES = 1 << 17


@dataclass
class Model:
    """nodes: all trees; params: with what they were grown. ``points`` to score need features array<double>."""

    params: TreeParams
    nodes: list[Node] = field(repr=False)
    classes: int = 1

    def trees(self) -> dict[tuple[int, int], list[Node]]:
        out: dict[tuple[int, int], list[Node]] = {}
        for n in self.nodes:
            out.setdefault((n.tree_id, n.class_id), []).append(n)
        return out

    def tree_columns(self, features: Column) -> dict[tuple[int, int], Column]:
        """The prediction of every tree as an expression."""
        return {k: predict_tree(t, features, self.params.dialect) for k, t in self.trees().items()}

    def prediction(self, features: Column) -> Column:
        (only,) = self.tree_columns(features).values()
        return only

    def predict(self, points: DataFrame, features: str = "features", out: str = "prediction") -> DataFrame:
        """``points`` with the prediction: no shuffle, one pass."""
        return points.withColumn(out, self.prediction(F.col(features)))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The nodes table."""
        return nodes_frame(spark, self.nodes)

    def dump(self, spark: SparkSession) -> DataFrame:
        """Lines of :func:`arbor.operators.tree.structure`."""
        return structure(self.frame(spark))

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes as Parquet and parameters as JSON text under ``path``, over what is there."""
        self.frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        meta = [(self.params.to_json(), self.classes)]
        spark.createDataFrame(meta, "params string, classes int").coalesce(1).write.mode("overwrite").json(f"{path}/params")


def load_model(spark: SparkSession, path: str) -> Model:
    """The model that ``save`` wrote, of the kind that it was."""
    meta = spark.read.schema("params string, classes int").json(f"{path}/params").first()
    params = from_json(meta["params"])
    kind = {ForestParams: ForestModel, BoostParams: BoostModel, MultiBoostParams: MultiBoostModel}.get(type(params), Model)
    return kind(params, nodes_of(spark.read.parquet(f"{path}/nodes")), meta["classes"])


class ForestModel(Model):
    """Gini: the most frequent vote, the smallest of equals. Variance: the mean."""

    def votes(self, features: Column) -> Column:
        return F.array(*(c for _, c in sorted(self.tree_columns(features).items(), key=lambda x: x[0])))

    def prediction(self, features: Column) -> Column:
        votes = self.votes(features)
        if self.params.impurity == "Variance":
            return F.aggregate(votes, F.lit(0.0), lambda a, x: a + x) / len(self.trees())
        sorted_votes = F.array_sort(F.array_distinct(votes))
        counts = F.transform(sorted_votes, lambda v: F.size(F.filter(votes, lambda x: x == v)))
        return F.get(sorted_votes, (F.array_position(counts, F.array_max(counts)) - 1).cast("int"))


def forest_errors(model: ForestModel, points: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """``(trees int, rmse)``: the error of the mean of the first 1, 2, ... trees, all in one pass over ``points``."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("out"))
    sums = F.aggregate(model.votes(F.col(features)), start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["out"], a["sum"] + x).alias("out")), lambda a: a["out"])
    each = points.select(F.col(label).alias("y"), F.posexplode(sums).alias("i", "s"))
    return each.groupBy((F.col("i") + 1).alias("trees")).agg(rmse_of(F.col("y"), F.col("s") / (F.col("i") + 1)).alias("rmse"))


class BoostModel(Model):
    """The first tree in full and the others by the learning rate."""

    def prediction(self, features: Column) -> Column:
        rate = self.params.learn_rate
        terms = [(1.0 if t == 0 else rate, c) for (t, _), c in sorted(self.tree_columns(features).items(), key=lambda x: x[0])]
        if not terms:
            raise ValueError("a boosted model needs a tree")
        return F.aggregate(F.array(*(F.lit(w) * c for w, c in terms)), F.lit(0.0), lambda a, x: a + x)


class MultiBoostModel(Model):
    """Scores of the classes are sums of their trees; the class of the largest score, the first of equals."""

    def scores(self, features: Column) -> Column:
        by_class: dict[int, list[Column]] = {k: [] for k in range(self.classes)}
        for (_, k), c in sorted(self.tree_columns(features).items(), key=lambda x: x[0]):
            by_class[k].append(c)
        return F.array(*(F.aggregate(F.array(*cs), F.lit(0.0), lambda a, x: a + x) if cs else F.lit(0.0) for cs in by_class.values()))

    def prediction(self, features: Column) -> Column:
        return loss.arg_max(self.scores(features)).cast("double")


@dataclass(frozen=True)
class Prepared:
    """Binned training rows, stored once: ``rows(key, label, bins)``, thresholds and sizes."""

    rows: DataFrame
    path: str
    thresholds: Thresholds
    n: int
    labels: tuple[float, ...]


def prepare(points: DataFrame, p: TreeParams, with_labels: bool = False, key: Column | None = None) -> Prepared:
    """Bins of ``points(label, features array<double>)``. One pass finds size, width and, if asked for, the labels (of which
    there may be 1,000); one finds thresholds on a sample; one stores bins.

    key: an integer row id for samples and weights. By default a row's place in its partition, which is stored with the bins, so
    that equal rows draw weights of their own.
    """
    sizes = points.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("features")), F.lit(0)).alias("width"), F.max(F.exists("features", lambda v: F.isnan(v))).alias("nan"))
    s = sizes.first()
    if not s["n"]:
        raise ValueError("no training rows")
    if s["nan"]:
        raise ValueError("a feature holds NaN")
    labels: tuple[float, ...] = ()
    if with_labels:
        labels = tuple(sorted(r["label"] for r in points.select("label").distinct().limit(1001).collect()))
        if len(labels) > 1000:
            raise ValueError("more than 1,000 labels: this is not a classification")
    thresholds = find_thresholds(points, s["width"], p.max_bins, p.bin_samples, p.dialect, p.seed, s["n"], key)
    who = key.cast("long") if key is not None else F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 31))
    rows, path = store(points.select(who.alias("key"), F.col("label").cast("double").alias("label"), binned(F.col("features"), thresholds, p.dialect).alias("bins")), "binned")
    return Prepared(rows, path, thresholds, s["n"], labels)


def _impurity(p: TreeParams, labels: tuple[float, ...]) -> imp.Impurity:
    if p.impurity == "Gini":
        return imp.Gini(labels)
    return imp.Variance(0.0 if p.dialect == "local" else imp.EMPTY_VARIANCE)


def train_forest(points: DataFrame, params: ForestParams | None = None, key: Column | None = None, trees_per_pass: int = 16) -> ForestModel:
    """A random forest. Rows are binned once; up to ``trees_per_pass`` trees, fewer of deep ones, grow in one pass, the tree in
    every key."""
    p = params or ForestParams()
    trees_per_pass = max(1, min(trees_per_pass, MOST_NODES >> (p.max_depth + 1)))
    data = prepare(points, p, p.impurity == "Gini", key)
    nodes: list[Node] = []
    for lo in range(0, p.num_trees, trees_per_pass):
        ids = F.array(*map(F.lit, range(lo, min(lo + trees_per_pass, p.num_trees))))
        each = data.rows.withColumn("tree_id", F.explode(ids)).withColumn("class_id", F.lit(0)).withColumn("w", poisson_weight(F.col("key"), p.row_rate, p.seed, F.col("tree_id")))
        nodes += g.grow(each.withColumnRenamed("label", "y"), data.thresholds, _impurity(p, data.labels), p)
    discard(points.sparkSession, data.path)
    return ForestModel(p, nodes)


def train_tree(points: DataFrame, params: TreeParams | None = None, key: Column | None = None) -> Model:
    """One tree of ``points(label, features)``."""
    p = params or TreeParams()
    data = prepare(points, p, p.impurity == "Gini", key)
    one = data.rows.select(F.lit(0).alias("tree_id"), F.lit(0).alias("class_id"), F.col("label").alias("y"), poisson_weight(F.col("key"), p.row_rate, p.seed).alias("w"), "bins")
    nodes = g.grow(one, data.thresholds, _impurity(p, data.labels), p)
    discard(points.sparkSession, data.path)
    return Model(p, nodes)


class _Scores:
    """Rows with a running score column, stored every few rounds so that neither plan nor lineage grows with the rounds."""

    def __init__(self, rows: DataFrame, name: str) -> None:
        self.stored, self.now, self.name, self.path, self.since = rows, rows, name, "", 0

    def add(self, column: str, value: Column) -> None:
        self.now = self.now.withColumn(column, value)
        self.since += 1
        if self.since >= STORE_EVERY:
            new, path = store(self.now, self.name)
            self.close()
            self.now, self.path, self.since = new, path, 0

    def close(self) -> None:
        if self.path:
            discard(self.now.sparkSession, self.path)
            self.path = ""


def train_boost(points: DataFrame, watch: dict[str, DataFrame] | None = None, params: BoostParams | None = None, key: Column | None = None) -> tuple[BoostModel, list[tuple[int, str, float]]]:
    """Boosted regression, and ``(round, dataset, rmse)`` of the training rows and each watched set after every round.

    Features don't change, so rows are binned once. The local dialect fits twice the residual on sampled rows and features,
    and stops once a round gains less than min_step, keeping the trees up to the best round.
    """
    p = params or BoostParams()
    local = p.dialect == "local"
    data = prepare(points, p, key=key)
    train = _Scores(data.rows.withColumn("f", F.lit(0.0)), "scores")
    seen = {name: _Scores(df.select(F.col("label").cast("double").alias("label"), "features").withColumn("f", F.lit(0.0)), "watch") for name, df in (watch or {}).items()}
    nodes: list[Node] = []
    metrics: list[tuple[int, str, float]] = []
    best, best_round = float("inf"), 1
    for r in range(p.num_round):
        target = F.col("label") if r == 0 else loss.negative_gradient(F.col("label"), F.col("f")) if local else loss.residual(F.col("label"), F.col("f"))
        weight = poisson_weight(F.col("key"), p.row_rate, p.seed, r) if local else F.lit(1)
        rows = train.now.select(F.lit(r).alias("tree_id"), F.lit(0).alias("class_id"), target.alias("y"), weight.alias("w"), "bins")
        tree = g.grow(rows, data.thresholds, _impurity(p, ()), p if local else replace(p, row_rate=1.0, col_rate=1.0))
        nodes += tree
        rate = 1.0 if r == 0 else p.learn_rate
        train.add("f", loss.update_score(F.col("f"), predict_bins(tree, F.col("bins")), rate))
        for s in seen.values():
            s.add("f", loss.update_score(F.col("f"), predict_tree(tree, F.col("features"), p.dialect), rate))
        error = train.now.agg(rmse_of(F.col("label"), F.col("f"))).first()[0]
        metrics.append((r + 1, "train", error))
        metrics += [(r + 1, name, s.now.agg(rmse_of(F.col("label"), F.col("f"))).first()[0]) for name, s in seen.items()]
        if local:
            if r and best - error < p.min_step:
                break
            if error < best:
                best, best_round = error, r + 1
    if local:
        nodes = [n for n in nodes if n.tree_id < best_round]
    for s in (train, *seen.values()):
        s.close()
    discard(points.sparkSession, data.path)
    return BoostModel(p, nodes), metrics


def train_multi_boost(points: DataFrame, params: MultiBoostParams | None = None) -> MultiBoostModel:
    """Boosted classification of labels 0, 1, ...: in every round the trees of all classes grow in one pass. Labels that aren't
    such numbers, or are more than 1,000, are refused."""
    p = params or MultiBoostParams()
    data = prepare(points, p, True)
    if any(x < 0 or x != int(x) or x > 999 for x in data.labels):
        discard(points.sparkSession, data.path)
        raise ValueError("labels must be whole numbers from 0 to 999")
    classes = int(data.labels[-1]) + 1
    scores = _Scores(data.rows.withColumn("f", F.array_repeat(F.lit(0.0), classes)), "scores")
    nodes: list[Node] = []
    for r in range(p.num_round):
        y = loss.softmax_residuals(F.col("label"), F.col("f"))
        rows = scores.now.select(F.lit(r).alias("tree_id"), "bins", F.posexplode(y).alias("class_id", "y")).withColumn("w", F.lit(1))
        trees = g.grow(rows, data.thresholds, imp.Logistic(classes), p)
        nodes += trees
        if r + 1 < p.num_round:
            gains = F.array(*(predict_bins([n for n in trees if n.class_id == k], F.col("bins")) for k in range(classes)))
            scores.add("f", F.zip_with("f", gains, lambda a, b: a + b))
    scores.close()
    discard(points.sparkSession, data.path)
    return MultiBoostModel(p, nodes, classes)

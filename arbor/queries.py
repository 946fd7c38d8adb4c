"""Registered queries of the tree, ensemble, metric and text operators, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.functions import impurity as imp
from arbor.functions import loss, metrics, sampling
from arbor.operators import binning, models, tfidf, tree
from arbor.operators import grow as g
from arbor.plans import oracle as o
from arbor.plans.params import BoostParams, ForestParams, MultiBoostParams, TreeParams
from arbor.plans.storage import shared_dir
from arbor.sources import libsvm

FEATURES = ["l_discount", "l_tax", "l_linenumber"]
FLAG = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
MANY = 1 << 30
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with SQL where there is any."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def line_points(spark: SparkSession, d: str, label: str = "l_quantity", where: str = "true") -> DataFrame:
    return libsvm.assemble(table(spark, d, "lineitem").where(where), F.expr(label), FEATURES)


def part_points(spark: SparkSession, d: str, label: str = "p_size") -> DataFrame:
    return libsvm.assemble(table(spark, d, "part"), F.expr(label), ["p_retailprice", F.expr("cast(substring(p_brand, 7) as int)")], key="p_partkey")


def _line(label: str = "l_quantity", where: str = "TRUE") -> list[str]:
    """CTEs of lineitem points with bins."""
    src = f"src AS (SELECT CAST({label} AS DOUBLE) AS y, 1 AS w, l_discount, l_tax, l_linenumber FROM lineitem WHERE {where})"
    return [src, *o.distinct_bins(FEATURES, "src", "y, w, l_discount, l_tax, l_linenumber")]


# Sources, labels and widths


@query("SELECT CAST(l_quantity AS DOUBLE) AS label, l_discount AS f0, l_tax AS f1, CAST(l_linenumber AS DOUBLE) AS f2 FROM lineitem")
def points_scan(spark: SparkSession, d: str) -> DataFrame:
    return line_points(spark, d).select("label", *(F.col("features")[i].alias(f"f{i}") for i in range(3)))


@query("""SELECT 'embedding' AS source, vec_id AS id, CAST(label - 1 AS DOUBLE) AS label FROM embeddings
UNION ALL SELECT 'toxic', doc_id, CAST(toxic AS DOUBLE) FROM labels
UNION ALL SELECT 'balance', c_custkey, greatest(c_acctbal, 0.0) FROM customer
UNION ALL SELECT 'kept', c_custkey, c_acctbal FROM customer""")
def label_normalise(spark: SparkSession, d: str) -> DataFrame:
    def one(name: str, t: str, key: str, label: str, is_class: bool, clamp: bool = True) -> DataFrame:
        rows = table(spark, d, t).select(F.lit(name).alias("source"), F.col(key).alias("id"), F.col(label).cast("double").alias("label"))
        return libsvm.normalise_labels(rows, is_class, clamp)

    a, b = one("embedding", "embeddings", "vec_id", "label", True), one("toxic", "labels", "doc_id", "toxic", True)
    return a.unionByName(b).unionByName(one("balance", "customer", "c_custkey", "c_acctbal", False)).unionByName(one("kept", "customer", "c_custkey", "c_acctbal", False, False))


@query("SELECT CAST(max(l_linenumber) + 1 AS INTEGER) AS width FROM lineitem")
def feature_width(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.create_map(F.col("l_linenumber").cast("int"), F.col("l_quantity")).alias("features"))
    return spark.createDataFrame([(libsvm.feature_width(rows),)], "width int")


@query("SELECT CAST(c_custkey AS DOUBLE) AS label, CAST(c_nationkey AS DOUBLE) AS f0, c_acctbal AS f1 FROM customer")
def libsvm_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/libsvm-roundtrip"
    libsvm.to_libsvm(libsvm.assemble(table(spark, d, "customer"), "c_custkey", ["c_nationkey", "c_acctbal"])).write.mode("overwrite").text(path)
    points = libsvm.dense(libsvm.read_libsvm(spark, path), 2)
    return points.select("label", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query("SELECT c_custkey AS id, CAST(c_custkey AS DOUBLE) AS label, CAST(c_nationkey AS DOUBLE) AS f0, c_acctbal AS f1 FROM customer")
def labeled_point_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/points-roundtrip"
    libsvm.to_points(libsvm.assemble(table(spark, d, "customer"), "c_custkey", ["c_nationkey", "c_acctbal"])).write.mode("overwrite").text(path)
    points = libsvm.parse_points(spark.read.text(path))
    return points.select(F.col("label").cast("long").alias("id"), "label", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))) AS line FROM documents WHERE text IS NOT NULL AND trim(text) <> ''")
def documents_by_line(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/documents-by-line"
    docs = table(spark, d, "documents").where("text is not null and trim(text) <> ''").orderBy("doc_id")
    docs.select(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")).alias("value")).write.mode("overwrite").text(path)
    return libsvm.read_documents(spark, path).select("doc_id", F.md5(F.col("text").cast("binary")).alias("line"))


# Sampling

_SPLIT = sampling.uniform_sql("o_orderkey", 7)


@query("SELECT o_orderkey, CAST(" + "".join(f"CASE WHEN u >= {t} THEN {k} ELSE " for k, t in reversed(list(enumerate(sampling.poisson_thresholds(0.6), start=1)))) + "0" + " END" * 16 + f" AS INTEGER) AS weight FROM (SELECT o_orderkey, {sampling.uniform_sql('o_orderkey', 7, '2')} AS u FROM orders)")
def poisson_weights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", sampling.poisson_weight(F.col("o_orderkey"), 0.6, 7, 2).cast("int").alias("weight"))


@query(f"""SELECT CAST(node AS INTEGER) AS node, CAST(f AS INTEGER) AS f FROM (SELECT node, f, row_number() OVER (PARTITION BY node ORDER BY u, f) AS rk FROM
(SELECT node, f, {sampling.uniform_sql('(node * 4099 + f)', 7, '1')} AS u FROM (SELECT unnest(range(1, 16)) AS node), (SELECT unnest(range(0, 10)) AS f))) WHERE rk <= 6""")
def feature_subset(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, f) for n in range(1, 16) for f in sampling.feature_subset(10, 0.6, 7, 1, n)], "node int, f int")


@query(f"SELECT o_orderkey, CAST(CASE WHEN u < 0.75 THEN 0 ELSE 1 END AS INTEGER) AS part FROM (SELECT o_orderkey, {_SPLIT} AS u FROM orders)")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    a, b = sampling.hash_split(table(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey"), [3, 1], 7)
    return a.withColumn("part", F.lit(0)).unionByName(b.withColumn("part", F.lit(1)))


# Thresholds and bins


@query("SELECT f, v, count(*) AS count FROM (" + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS f, CAST({c} AS DOUBLE) AS v FROM lineitem" for i, c in enumerate(FEATURES)) + ") GROUP BY f, v")
def value_histogram(spark: SparkSession, d: str) -> DataFrame:
    return binning.value_histogram(line_points(spark, d))


def _splits(spark: SparkSession, d: str, t: str, column: str, bins: int, dialect: str) -> DataFrame:
    points = table(spark, d, t).select(F.array(F.expr(column).cast("double")).alias("features"))
    return binning.splits_frame(points, bins, dialect).select("s", "threshold")


@query("SELECT CAST(row_number() OVER (ORDER BY v) - 2 AS INTEGER) AS s, v AS threshold FROM (SELECT DISTINCT l_tax AS v FROM lineitem) QUALIFY row_number() OVER (ORDER BY v) > 1")
def split_thresholds_small(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d, "lineitem", "l_tax", 32, "distributed")


@query(o.query(o.greedy_thresholds("lineitem", "round(l_extendedprice / 100)", 32), "SELECT CAST(i AS INTEGER) AS s, t AS threshold FROM g", True))
def split_thresholds_greedy(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d, "lineitem", "round(l_extendedprice / 100)", 32, "distributed")


@query(o.query(o.greedy_thresholds("part", "p_size", 16, "local"), "SELECT CAST(i AS INTEGER) AS s, t AS threshold FROM g", True))
def split_thresholds_local(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d, "part", "p_size", 16, "local")


def _binned(spark: SparkSession, d: str, dialect: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("double")).alias("features"))
    found = binning.find_thresholds(part, 1, 16, MANY, dialect, 7, part.count())
    return part.select("p_partkey", F.get(binning.binned(F.col("features"), found, dialect), F.lit(0)).alias("bin"))


@query(o.query(o.greedy_thresholds("part", "p_size", 16), "SELECT p_partkey, CAST((SELECT count(*) FROM g WHERE t <= p_size) AS INTEGER) AS bin FROM part", True))
def binned_points(spark: SparkSession, d: str) -> DataFrame:
    return _binned(spark, d, "distributed")


@query(o.query(o.greedy_thresholds("part", "p_size", 16, "local"), "SELECT p_partkey, CAST((SELECT count(*) FROM g WHERE t < p_size) AS INTEGER) AS bin FROM part", True))
def binned_points_local(spark: SparkSession, d: str) -> DataFrame:
    return _binned(spark, d, "local")


_FEW = 500
_DRAWN = f"(SELECT p_size FROM part WHERE {sampling.uniform_sql('p_partkey', 7, str(sampling.SAMPLE_STREAM))} < {_FEW}.0 / greatest({_FEW}, (SELECT count(*) FROM part)))"


@query(o.query(o.greedy_thresholds(_DRAWN, "p_size", 16), "SELECT CAST(i AS INTEGER) AS s, t AS threshold FROM g", True))
def binning_sample(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("double")).alias("features"))
    (found,) = binning.find_thresholds(part, 1, 16, _FEW, "distributed", 7, part.count(), F.col("p_partkey"))
    return spark.createDataFrame(list(enumerate(found)), "s int, threshold double")


@query(o.query(o.greedy_thresholds(_DRAWN, "p_size", 16, "local"), "SELECT CAST(i AS INTEGER) AS s, t AS threshold FROM g", True))
def binning_sample_local(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size").cast("double")).alias("features"))
    (found,) = binning.find_thresholds(part, 1, 16, _FEW, "local", 7, part.count(), F.col("p_partkey"))
    return spark.createDataFrame(list(enumerate(found)), "s int, threshold double")


# One level

KINDS: dict[str, tuple[str, imp.Impurity, o.Sums]] = {
    "variance": ("l_quantity", imp.Variance(), o.Sums()),
    "gini": (FLAG, imp.Gini((0.0, 1.0, 2.0)), o.Sums("gini", (0.0, 1.0, 2.0))),
    "logistic": (f"CASE WHEN {FLAG} = 1 THEN 0.75 ELSE -0.25 END", imp.Logistic(3), o.Sums("logistic", classes=3)),
}


def _level_rows(spark: SparkSession, d: str, kind: str, node: str = "1") -> tuple[DataFrame, imp.Impurity]:
    label, impurity, _ = KINDS[kind]
    lines = table(spark, d, "lineitem").select(F.expr(label).cast("double").alias("y"), F.expr(node).cast("long").alias("node_id"), F.array(*(F.col(c).cast("double") for c in FEATURES)).alias("features"))
    found = binning.find_thresholds(lines, 3, 32, MANY, "distributed", 7, 1)
    return lines.select(F.lit(0).alias("tree_id"), F.lit(0).alias("class_id"), "node_id", "y", F.lit(1).alias("w"), binning.binned(F.col("features"), found).alias("bins")), impurity


NODE = "2 + l_linenumber % 2"


def _level_sql(kind: str, node: str) -> list[str]:
    label = KINDS[kind][0]
    src = f"src AS (SELECT CAST({label} AS DOUBLE) AS y, 1 AS w, {node} AS node, l_discount, l_tax, l_linenumber FROM lineitem)"
    return [src, *o.distinct_bins(FEATURES, "src", "y, w, node")]


def _hist_sql(kind: str) -> str:
    long = " UNION ALL ".join(f"SELECT node, y, w, {i} AS f, b{i} AS bin FROM b" for i in range(3))
    return f"SELECT CAST(node AS BIGINT) AS node_id, CAST(f AS INTEGER) AS f, bin, {KINDS[kind][2].select()} FROM ({long}) GROUP BY node, f, bin"


def _register_levels() -> None:
    for kind, (_, impurity, sums) in KINDS.items():

        def stats(spark: SparkSession, d: str, kind: str = kind) -> DataFrame:
            rows, impurity = _level_rows(spark, d, kind)
            return g.node_stats(rows, impurity).select(F.col("n"), F.round("impurity", 9).alias("impurity"), F.round("predict", 9).alias("predict"))

        def hist(spark: SparkSession, d: str, kind: str = kind) -> DataFrame:
            rows, impurity = _level_rows(spark, d, kind, NODE)
            return g.level_histogram(rows, impurity).drop("tree_id", "class_id")

        def best(spark: SparkSession, d: str, kind: str = kind) -> DataFrame:
            rows, impurity = _level_rows(spark, d, kind)
            found = g.best_splits(g.candidates(g.level_histogram(rows, impurity), impurity, 15))
            return found.select("node_id", "f", "s", "nl", "nr", *(F.round(c, 9).alias(c) for c in ("wi", "pl", "pr")))

        QUERIES[f"root_stats_{kind}"] = stats
        ORACLE_SQL[f"root_stats_{kind}"] = o.query(_level_sql(kind, "1"), f"SELECT n, round({sums.value('')}, 9) AS impurity, round({sums.predict('')}, 9) AS predict FROM (SELECT {sums.select()} FROM b)")
        QUERIES[f"level_hist_{kind}"] = hist
        ORACLE_SQL[f"level_hist_{kind}"] = o.query(_level_sql(kind, NODE), _hist_sql(kind))
        name = "best_split_root" if kind == "variance" else f"best_split_{kind}"
        QUERIES[name] = best
        ORACLE_SQL[name] = o.query(
            _level_sql(kind, "1"),
            "SELECT CAST(node AS BIGINT) AS node_id, CAST(f AS INTEGER) AS f, CAST(s AS INTEGER) AS s, ln AS nl, rn AS nr, round(wi, 9) AS wi, round(pl, 9) AS pl, round(pr, 9) AS pr "
            f"FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(wi, 9), f, s) AS rk FROM ({o.candidates('b', 3, sums, 15)})) WHERE rk = 1",
        )


_register_levels()


@query(
    o.query(
        _level_sql("variance", NODE),
        "SELECT node_id, f, bin, n, s, q, "
        + ", ".join(f"sum({x}) OVER (PARTITION BY node_id, f ORDER BY bin ROWS UNBOUNDED PRECEDING) AS l_{x}, sum({x}) OVER (PARTITION BY node_id, f) - sum({x}) OVER (PARTITION BY node_id, f ORDER BY bin ROWS UNBOUNDED PRECEDING) AS r_{x}" for x in "nsq")
        + f" FROM ({_hist_sql('variance')})",
    )
)
def prefix_sums(spark: SparkSession, d: str) -> DataFrame:
    rows, impurity = _level_rows(spark, d, "variance", NODE)
    return g.prefix_sums(g.level_histogram(rows, impurity), impurity).drop("tree_id", "class_id")


# Trees

_NODES = ["node_id", "depth", "count", "impurity", "predict", "is_leaf", "split_f", "split_s", "threshold"]


def _params(depth: int, **more) -> TreeParams:
    return TreeParams(**({"max_depth": depth, "min_node_size": 15, "bin_samples": MANY} | more))


def _tree_query(p: TreeParams, kind: str = "variance") -> str:
    label, _, sums = KINDS[kind]
    head = _line(label)
    if p.dialect == "local":
        head[-1] = o.local_thresholds(FEATURES, "src")
        sums = o.Sums(empty=0.0)
    return o.query([*head, *o.tree("t", "b", 3, p, sums)], f"SELECT {', '.join(_NODES)} FROM t_nodes")


def _nodes(spark: SparkSession, d: str, p: TreeParams, label: str = "l_quantity") -> DataFrame:
    return models.train_tree(line_points(spark, d, label), p).frame(spark).select(*_NODES)


@query(_tree_query(_params(2)))
def cart_depth2_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, _params(2))


@query(_tree_query(_params(3)))
def cart_depth3_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, _params(3))


@query(_tree_query(_params(3, impurity="Gini"), "gini"))
def cart_gini_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, _params(3, impurity="Gini"), FLAG)


@query(_tree_query(_params(3, dialect="local", min_node_size=40)))
def cart_local_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, _params(3, dialect="local", min_node_size=40))


@query(
    o.query(
        [*_line()[:-1], o.local_thresholds(FEATURES, "src"), *o.tree("t", "b", 3, _params(3, dialect="local", min_node_size=40), o.Sums(empty=0.0))],
        "SELECT round(sqrt(avg((y - pred) * (y - pred))), 9) AS rmse FROM t_out",
    )
)
def cart_local_rmse(spark: SparkSession, d: str) -> DataFrame:
    points = line_points(spark, d)
    scored = models.train_tree(points, _params(3, dialect="local", min_node_size=40)).predict(points)
    return scored.agg(F.round(metrics.rmse_of(F.col("label"), F.col("prediction")), 9).alias("rmse"))


def _part_tree(p: TreeParams) -> list[str]:
    src = "src AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS y, 1 AS w, p_retailprice, CAST(substr(p_brand, 7) AS INTEGER) AS brand FROM part)"
    bins, thresholds = o.distinct_bins(["p_retailprice", "brand"], "src", "p_partkey, y, w, p_retailprice, brand")
    if p.dialect == "local":
        thresholds = o.local_thresholds(["p_retailprice", "brand"], "src")
    return [src, bins, thresholds, *o.tree("t", "b", 2, p, o.Sums(empty=0.0) if p.dialect == "local" else o.Sums())]


_SINK, _SINK_LOCAL = _params(2, max_bins=1 << 20), _params(2, max_bins=1 << 20, dialect="local")


@query(o.query(_part_tree(_SINK), "SELECT p_partkey AS id, y AS label, round(pred, 9) AS prediction FROM t_out"))
def prediction_sink(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/predictions"
    points = part_points(spark, d)
    libsvm.write_predictions(models.train_tree(points, _SINK).predict(points), path)
    read = spark.read.option("sep", "\t").schema("id long, label double, prediction double").csv(path)
    return read.select("id", "label", F.round("prediction", 9).alias("prediction"))


@query(o.query(_part_tree(_SINK_LOCAL), "SELECT round(pred, 9) AS prediction, y AS label, p_retailprice AS f0, CAST(brand AS DOUBLE) AS f1 FROM t_out"))
def prediction_sink_local(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/predictions-local"
    points = part_points(spark, d)
    libsvm.write_predictions(models.train_tree(points, _SINK_LOCAL).predict(points), path, "local")
    lines = spark.read.text(path).select(F.substring_index("value", "\t", 1).cast("double").alias("p"), F.substring_index("value", "\t", -1).alias("value"))
    read = libsvm.dense(libsvm.parse_lines(lines), 2)
    return read.select(F.round("p", 9).alias("prediction"), "label", F.col("features")[0].alias("f0"), F.col("features")[1].alias("f1"))


@query(_tree_query(_params(2)))
def model_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_dir(spark)}/model-roundtrip"
    models.train_tree(line_points(spark, d), _params(2)).save(spark, path)
    return models.load_model(spark, path).frame(spark).select(*_NODES)


_CART = [*_line(), *o.tree("t", "b", 3, _params(3), o.Sums())]
_CART_GINI = [*_line(FLAG), *o.tree("t", "b", 3, _params(3, impurity="Gini"), KINDS["gini"][2])]


@query(o.query(_CART, "SELECT y AS label, l_discount AS f0, l_tax AS f1, CAST(l_linenumber AS DOUBLE) AS f2, pred AS prediction FROM t_out"))
def cart_predict(spark: SparkSession, d: str) -> DataFrame:
    points = line_points(spark, d)
    scored = models.train_tree(points, _params(3)).predict(points)
    return scored.select("label", *(F.col("features")[i].alias(f"f{i}") for i in range(3)), "prediction")


@query(o.query(_CART, "SELECT y AS label, l_discount AS f0, pred AS prediction FROM t_out"))
def cart_predict_by_join(spark: SparkSession, d: str) -> DataFrame:
    points = line_points(spark, d)
    nodes = models.train_tree(points, _params(3)).frame(spark)
    return tree.predict_by_join(points, nodes, 3).select("label", F.col("features")[0].alias("f0"), "prediction")


@query(o.query(_CART, "SELECT round(sqrt(avg((y - pred) * (y - pred))), 9) AS rmse FROM t_out"))
def cart_rmse(spark: SparkSession, d: str) -> DataFrame:
    points = line_points(spark, d)
    scored = models.train_tree(points, _params(3)).predict(points)
    return scored.agg(F.round(metrics.rmse_of(F.col("label"), F.col("prediction")), 9).alias("rmse"))


@query(o.query(_CART_GINI, "SELECT round(avg(CASE WHEN y <> pred THEN 1.0 ELSE 0.0 END), 9) AS error_rate FROM t_out"))
def cart_error_rate(spark: SparkSession, d: str) -> DataFrame:
    points = line_points(spark, d, FLAG)
    scored = models.train_tree(points, _params(3, impurity="Gini")).predict(points)
    return scored.agg(F.round(metrics.error_rate_of(F.col("label"), F.col("prediction")), 9).alias("error_rate"))


_PATH = "CASE node_id WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN '1' WHEN 4 THEN '00' WHEN 5 THEN '01' WHEN 6 THEN '10' ELSE '11' END"


@query(
    o.query(
        [*_line(), *o.tree("t", "b", 3, _params(2), o.Sums())],
        f"""SELECT CAST(row_number() OVER (ORDER BY {_PATH}) AS INTEGER) AS ord, repeat('|---', depth) || 'node ' || node_id || ': n=' || printf('%.0f', count) || ' impurity=' || printf('%.6f', impurity) || ' ' ||
CASE WHEN is_leaf THEN 'predict=' || printf('%.6f', predict) ELSE 'f' || split_f || ' < ' || printf('%.6f', threshold) END AS line FROM t_nodes""",
    )
)
def structure_dump(spark: SparkSession, d: str) -> DataFrame:
    return models.train_tree(line_points(spark, d), _params(2)).dump(spark).select("ord", "line")


# Metrics

_TP = "abs(toxic - 1) < 1e-7 AND abs(quality - 1) < 1e-7"


@query(f"""SELECT round(avg(CASE WHEN abs(toxic - quality) < 1e-7 THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
round(CASE WHEN count(*) FILTER (abs(quality - 1) < 1e-7) = 0 THEN 1.0 ELSE count(*) FILTER ({_TP}) / count(*) FILTER (abs(quality - 1) < 1e-7) END, 9) AS precision,
round(CASE WHEN count(*) FILTER (abs(toxic - 1) < 1e-7) = 0 THEN 1.0 ELSE count(*) FILTER ({_TP}) / count(*) FILTER (abs(toxic - 1) < 1e-7) END, 9) AS recall FROM labels""")
def accuracy_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    report = metrics.classification_report(table(spark, d, "labels"), "toxic", "quality")
    return report.select(*(F.round(c, 9).alias(c) for c in report.columns))


@query("""WITH s AS (SELECT toxic, doc_id % 97 / 97.0 AS p FROM labels),
r AS (SELECT i, avg(CASE WHEN p > i / 100.0 THEN 1.0 ELSE 0.0 END) FILTER (toxic = 1) AS tpr, avg(CASE WHEN p > i / 100.0 THEN 1.0 ELSE 0.0 END) FILTER (toxic = 0) AS fpr FROM s, (SELECT unnest(range(1, 101)) AS i) GROUP BY i),
x AS (SELECT i, tpr, fpr, lag(tpr) OVER (ORDER BY i) AS t2, lag(fpr) OVER (ORDER BY i) AS f2 FROM r)
SELECT round(sum(CASE WHEN i = 1 THEN (1 - fpr) * (1 + tpr) / 2 ELSE (f2 - fpr) * (t2 + tpr) / 2 END), 9) AS auc FROM x""")
def auc_100(spark: SparkSession, d: str) -> DataFrame:
    scored = table(spark, d, "labels").select("toxic", (F.col("doc_id") % 97 / 97.0).alias("p"))
    return metrics.auc_frame(scored, "toxic", "p").select(F.round("auc", 9).alias("auc"))


# Boosting

_BOOST = BoostParams(max_depth=2, bin_samples=MANY, num_round=2, learn_rate=0.1)
_LOCAL = BoostParams(max_depth=1, bin_samples=MANY, num_round=2, learn_rate=0.1, dialect="local", min_step=-1.0)


def _rounded(nodes: DataFrame) -> DataFrame:
    return nodes.select("tree_id", "node_id", "is_leaf", "split_f", "split_s", "threshold", F.round("predict", 6).alias("predict"))


def _boost_sql(p: BoostParams, factor: int, where: str = "TRUE") -> list[str]:
    head = _line(where=where)
    if p.dialect == "local":
        head[-1] = o.local_thresholds(FEATURES, "src")
    sums = o.Sums(empty=0.0) if p.dialect == "local" else o.Sums()
    second = f"b2 AS (SELECT {factor} * (y - pred) AS y, w, b0, b1, b2, y AS label, pred AS f FROM t_out)"
    return [*head, *o.tree("t", "b", 3, p, sums), second, *o.tree("u", "b2", 3, p, sums)]


_BOTH = "SELECT CAST(tree_id AS INTEGER) AS tree_id, node_id, is_leaf, split_f, split_s, threshold, round(predict, 6) AS predict FROM (SELECT 0 AS tree_id, * FROM t_nodes UNION ALL SELECT 1, * FROM u_nodes)"


@query(o.query(_boost_sql(_BOOST, 1), _BOTH))
def gbrt_round2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(models.train_boost(line_points(spark, d), params=_BOOST)[0].frame(spark))


@query(o.query(_boost_sql(_LOCAL, 2), _BOTH))
def gb_local_round2(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(models.train_boost(line_points(spark, d), params=_LOCAL)[0].frame(spark))


_TWO_ROUNDS = "SELECT label, b0, b1, b2, round(f + 0.1 * pred, 6) AS prediction FROM u_out"


def _boost_predictions(spark: SparkSession, d: str, p: BoostParams) -> DataFrame:
    """Predictions of a boosted model, with the bins of the three features: distinct values count from 0."""
    points = line_points(spark, d)
    model, _ = models.train_boost(points, params=p)
    found = binning.find_thresholds(points, 3, 32, MANY, p.dialect, 7, 1 << 20)
    bins = binning.binned(F.col("features"), found, p.dialect)
    return model.predict(points).select("label", *(F.get(bins, F.lit(i)).alias(f"b{i}") for i in range(3)), F.round("prediction", 6).alias("prediction"))


@query(o.query(_boost_sql(_BOOST, 1), _TWO_ROUNDS))
def gbrt_predict(spark: SparkSession, d: str) -> DataFrame:
    return _boost_predictions(spark, d, _BOOST)


@query(o.query(_boost_sql(_LOCAL, 2), _TWO_ROUNDS))
def gb_local_predict(spark: SparkSession, d: str) -> DataFrame:
    return _boost_predictions(spark, d, _LOCAL)


_DEPTH1 = BoostParams(max_depth=1, bin_samples=MANY, num_round=2, learn_rate=0.1)
_X = "CASE r.split_f WHEN 0 THEN l_discount WHEN 1 THEN l_tax ELSE l_linenumber END"
_SCORE = "CASE WHEN r.split_f IS NULL THEN r.predict WHEN {x} < r.threshold THEN l.predict ELSE q.predict END"


@query(
    o.query(
        [
            *_boost_sql(_DEPTH1, 1, "l_linestatus = 'F'"),
            "other AS (SELECT l_quantity AS y, l_discount, l_tax, l_linenumber FROM lineitem WHERE l_linestatus = 'O')",
            *(
                f"w{t} AS (SELECT o.*, {_SCORE.format(x=_X)} AS p{t} FROM {src} o, (SELECT * FROM {t}_nodes WHERE node_id = 1) r LEFT JOIN {t}_nodes l ON l.node_id = 2 LEFT JOIN {t}_nodes q ON q.node_id = 3)"
                for t, src in (("t", "other"), ("u", "wt"))
            ),
        ],
        """SELECT CAST(1 AS INTEGER) AS round, 'train' AS dataset, round(sqrt(avg((y - pred) * (y - pred))), 6) AS rmse FROM t_out
UNION ALL SELECT 2, 'train', round(sqrt(avg((label - (f + 0.1 * pred)) * (label - (f + 0.1 * pred)))), 6) FROM u_out
UNION ALL SELECT 1, 'open', round(sqrt(avg((y - pt) * (y - pt))), 6) FROM wu
UNION ALL SELECT 2, 'open', round(sqrt(avg((y - (pt + 0.1 * pu)) * (y - (pt + 0.1 * pu)))), 6) FROM wu""",
    )
)
def gbrt_watchlist_rmse(spark: SparkSession, d: str) -> DataFrame:
    _, found = models.train_boost(line_points(spark, d, where="l_linestatus = 'F'"), {"open": line_points(spark, d, where="l_linestatus = 'O'")}, _DEPTH1)
    return spark.createDataFrame([(r, n, round(v, 6)) for r, n, v in found], "round int, dataset string, rmse double")


_E = [f"exp(f{k} - greatest(f0, f1, f2))" for k in range(3)]


def _residual(k: int) -> str:
    return f"CASE WHEN y = {k} THEN 1.0 ELSE 0.0 END - {_E[k]} / ({' + '.join(_E)})"


@query(f"SELECT vec_id, {', '.join(f'round({_residual(k)}, 9) AS r{k}' for k in range(3))} FROM (SELECT vec_id, label % 3 AS y, CAST(embedding[1] AS DOUBLE) AS f0, CAST(embedding[2] AS DOUBLE) AS f1, CAST(embedding[3] AS DOUBLE) AS f2 FROM embeddings)")
def softmax_residual(spark: SparkSession, d: str) -> DataFrame:
    scores = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))
    r = loss.softmax_residuals(F.col("label") % 3, scores)
    return table(spark, d, "embeddings").select("vec_id", *(F.round(F.get(r, F.lit(k)), 9).alias(f"r{k}") for k in range(3)))


_MULTI = MultiBoostParams(max_depth=2, bin_samples=MANY, num_round=2)


def _multi_sql() -> list[str]:
    sums = o.Sums("logistic", classes=3)
    out = [*_line(FLAG), "m0 AS (SELECT row_number() OVER () AS rid, b.*, 0.0::DOUBLE AS f0, 0.0::DOUBLE AS f1, 0.0::DOUBLE AS f2 FROM b)"]
    for r in range(2):
        for k in range(3):
            out.append(f"m{r}{k} AS (SELECT rid, {_residual(k)} AS y, w, b0, b1, b2 FROM m{r})")
            out += o.tree(f"t{r}{k}", f"m{r}{k}", 3, _MULTI, sums)
        gains = " ".join(f"JOIN t{r}{k}_out o{k} ON o{k}.rid = m{r}.rid" for k in range(3))
        out.append(f"m{r + 1} AS (SELECT m{r}.* REPLACE ({', '.join(f'f{k} + o{k}.pred AS f{k}' for k in range(3))}) FROM m{r} {gains})")
    return out


@query(o.query(_multi_sql(), "SELECT * FROM (" + " UNION ALL ".join(f"SELECT CAST({r} AS INTEGER) AS tree_id, CAST({k} AS INTEGER) AS class_id, node_id, is_leaf, split_f, round(predict, 6) AS predict FROM t{r}{k}_nodes" for r in range(2) for k in range(3)) + ")"))
def gbdt_gamma(spark: SparkSession, d: str) -> DataFrame:
    nodes = models.train_multi_boost(line_points(spark, d, FLAG), _MULTI).frame(spark)
    return nodes.select("tree_id", "class_id", "node_id", "is_leaf", "split_f", F.round("predict", 6).alias("predict"))


@query(o.query(_multi_sql(), "SELECT y AS label, CAST(CASE greatest(f0, f1, f2) WHEN f0 THEN 0 WHEN f1 THEN 1 ELSE 2 END AS DOUBLE) AS prediction, count(*) AS rows FROM m2 GROUP BY 1, 2"))
def gbdt_round2_predict(spark: SparkSession, d: str) -> DataFrame:
    points = line_points(spark, d, FLAG)
    scored = models.train_multi_boost(points, _MULTI).predict(points)
    return scored.groupBy("label", "prediction").agg(F.count("*").alias("rows"))


# Forests

_FOREST = ForestParams(max_depth=2, max_bins=1 << 20, bin_samples=MANY, num_trees=3, col_rate=0.5)


def _forest_sql(label: str, p: ForestParams, sums: o.Sums) -> list[str]:
    out = [
        f"src AS (SELECT p_partkey, CAST({label} AS DOUBLE) AS y, p_retailprice, CAST(substr(p_brand, 7) AS INTEGER) AS brand FROM part)",
        *o.distinct_bins(["p_retailprice", "brand"], "src", "p_partkey, y"),
    ]
    if p.dialect == "local":
        out[-1] = o.local_thresholds(["p_retailprice", "brand"], "src")
    cuts = list(enumerate(sampling.poisson_thresholds(p.row_rate), start=1))
    for t in range(p.num_trees):
        weight = "".join(f"CASE WHEN u >= {x} THEN {k} ELSE " for k, x in reversed(cuts)) + "0" + " END" * len(cuts)
        out.append(f"d{t} AS (SELECT p_partkey, y, b0, b1, {weight} AS w FROM (SELECT *, {sampling.uniform_sql('p_partkey', p.seed, str(t))} AS u FROM b))")
        out += o.tree(f"t{t}", f"d{t}", 2, p, sums, t)
    return out


_JOINED = "FROM t0_out a JOIN t1_out b USING (p_partkey) JOIN t2_out c USING (p_partkey)"


@query(o.query(_forest_sql("p_size", _FOREST, o.Sums()), f"SELECT p_partkey AS id, a.y AS label, round((a.pred + b.pred + c.pred) / 3, 9) AS prediction {_JOINED}"))
def rf_mean(spark: SparkSession, d: str) -> DataFrame:
    points = part_points(spark, d)
    return models.train_forest(points, _FOREST, F.col("id")).predict(points).select("id", "label", F.round("prediction", 9).alias("prediction"))


@query(
    o.query(
        _forest_sql("p_size", _FOREST, o.Sums()),
        f"""SELECT CAST(k AS INTEGER) AS trees, round(sqrt(avg((y - p) * (y - p))), 9) AS rmse
FROM (SELECT a.y, unnest([1, 2, 3]) AS k, unnest([a.pred, (a.pred + b.pred) / 2, (a.pred + b.pred + c.pred) / 3]) AS p {_JOINED}) GROUP BY k""",
    )
)
def rf_errors(spark: SparkSession, d: str) -> DataFrame:
    points = part_points(spark, d)
    errors = models.forest_errors(models.train_forest(points, _FOREST, F.col("id")), points)
    return errors.select("trees", F.round("rmse", 9).alias("rmse"))


_FOREST_LOCAL = ForestParams(max_depth=2, max_bins=1 << 20, bin_samples=MANY, num_trees=3, col_rate=0.5, dialect="local")


@query(o.query(_forest_sql("p_size", _FOREST_LOCAL, o.Sums(empty=0.0)), f"SELECT p_partkey AS id, a.y AS label, round((a.pred + b.pred + c.pred) / 3, 9) AS prediction {_JOINED}"))
def rf_local(spark: SparkSession, d: str) -> DataFrame:
    points = part_points(spark, d)
    return models.train_forest(points, _FOREST_LOCAL, F.col("id")).predict(points).select("id", "label", F.round("prediction", 9).alias("prediction"))


_VOTES = ForestParams(impurity="Gini", max_depth=2, max_bins=1 << 20, bin_samples=MANY, num_trees=3, col_rate=0.5)


@query(o.query(_forest_sql("p_size % 3", _VOTES, o.Sums("gini", (0.0, 1.0, 2.0))), f"SELECT p_partkey AS id, a.y AS label, CASE WHEN a.pred = b.pred OR a.pred = c.pred THEN a.pred WHEN b.pred = c.pred THEN b.pred ELSE least(a.pred, b.pred, c.pred) END AS prediction {_JOINED}"))
def rf_vote(spark: SparkSession, d: str) -> DataFrame:
    points = part_points(spark, d, "p_size % 3")
    return models.train_forest(points, _VOTES, F.col("id")).predict(points).select("id", "label", "prediction")


# Text

_TERMS = """tok AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL),
term AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS term FROM tok)"""


@query(f"""WITH {_TERMS}, c AS (SELECT doc_id, term, count(*) AS n FROM term GROUP BY doc_id, term),
x AS (SELECT doc_id, term, n / sum(n) OVER (PARTITION BY doc_id) AS tf FROM c), df AS (SELECT term, count(*) AS df FROM c GROUP BY term)
SELECT doc_id, term, round(tf, 9) AS tf, round(ln((SELECT count(*) FROM documents)::DOUBLE / (df + 1)), 9) AS idf, round(tf * ln((SELECT count(*) FROM documents)::DOUBLE / (df + 1)), 9) AS tfidf FROM x JOIN df USING (term)""")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    out = tfidf.tfidf(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", "term", *(tfidf.rounded(F.col(c), 9).alias(c) for c in ("tf", "idf", "tfidf")))


@query(f"WITH {_TERMS} SELECT term, row_number() OVER (ORDER BY doc_id, pos) - 1 AS term_id FROM (SELECT term, doc_id, pos FROM term QUALIFY row_number() OVER (PARTITION BY term ORDER BY doc_id, pos) = 1)")
def tfidf_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.dictionary(table(spark, d, "documents").select("doc_id", "text"))


@query(f"WITH {_TERMS} SELECT doc_id, term, count(*) AS count FROM term GROUP BY doc_id, term")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.term_counts(table(spark, d, "documents").select("doc_id", "text")).drop("doc_terms")


@query(f"""WITH {_TERMS}, c AS (SELECT doc_id, term, count(*) AS n FROM term GROUP BY doc_id, term),
x AS (SELECT doc_id, term, n / sum(n) OVER (PARTITION BY doc_id) AS tf FROM c), df AS (SELECT term, count(*) AS df FROM c GROUP BY term),
ids AS (SELECT term, row_number() OVER (ORDER BY doc_id, pos) - 1 AS term_id FROM (SELECT term, doc_id, pos FROM term QUALIFY row_number() OVER (PARTITION BY term ORDER BY doc_id, pos) = 1))
SELECT doc_id, string_agg(term_id || ':' || CAST(CAST(round(tf * ln((SELECT count(*) FROM documents)::DOUBLE / (df + 1)), 6) AS DECIMAL(18,6)) AS VARCHAR), ' ' ORDER BY term_id) AS vector
FROM x JOIN df USING (term) JOIN ids USING (term) GROUP BY doc_id""")
def tfidf_vectors(spark: SparkSession, d: str) -> DataFrame:
    return tfidf.document_vectors(table(spark, d, "documents").select("doc_id", "text"))


LEXICON = ("an", "and", "ar", "are", "en", "ent", "er", "es", "in", "ing", "on", "or", "re", "st", "te", "ter", "the", "then")


@query(f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '{"|".join(sorted(LEXICON, key=lambda w: (-len(w), w)))}|[A-Za-z0-9]+|[^ \\t\\n\\r]')) AS term FROM documents)
SELECT doc_id, term, count(*) AS count FROM w GROUP BY doc_id, term""")
def segmented_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return tfidf.term_counts(docs, tfidf.longest_matches(LEXICON)).drop("doc_terms")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a regression tree of depth 3."""
    return cart_depth3_nodes(spark, d)

"""Worked examples: fixed settings for three public data sets, trained and evaluated from libsvm files.

``python -m arbor.examples NAME FOLDER`` reads the files from FOLDER and prints the errors of training and test rows.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.functions.metrics import error_rate_of, rmse
from arbor.functions.sampling import hash_split
from arbor.operators import models as m
from arbor.plans.params import BoostParams, ForestParams, MultiBoostParams, TreeParams
from arbor.sources.libsvm import dense, feature_width, read_libsvm


@dataclass(frozen=True)
class Example:
    """files: of training and test rows; with one file, a quarter of its rows is the test. classify: labels are classes.
    library: the tree of Spark's own library instead, for comparison."""

    files: tuple[str, ...]
    params: TreeParams
    classify: bool = False
    library: bool = False


#: The settings under which these data sets are usually reported.
EXAMPLES: dict[str, Example] = {
    "a1a-library-tree": Example(("a1a.nnl", "a1a.t.nnl"), TreeParams("Gini", max_depth=5), True, True),
    "a1a-cart": Example(("a1a", "a1a.t"), TreeParams("Gini", min_node_size=50), True),
    "a1a-gbdt": Example(("a1a", "a1a.t"), MultiBoostParams(num_round=5), True),
    "cadata-local-decision-tree": Example(("cadata.train", "cadata.test"), TreeParams(dialect="local")),
    "cadata-local-gradient-boost": Example(("cadata.train", "cadata.test"), BoostParams(num_round=300, dialect="local")),
    "cadata-local-random-forest": Example(("cadata.train", "cadata.test"), ForestParams(dialect="local")),
    "cadata-cart": Example(("cadata",), TreeParams(max_depth=15, min_node_size=10)),
    "cadata-gbrt": Example(("cadata",), BoostParams(max_depth=15, min_node_size=10, num_round=100, learn_rate=0.1)),
    "cadata-random-forest": Example(("cadata.train", "cadata.test"), ForestParams()),
    "dna-cart": Example(("dna.scale", "dna.scale.t"), TreeParams("Gini", min_node_size=20), True),
    "dna-gbdt": Example(("dna.scale", "dna.scale.t"), MultiBoostParams(min_node_size=20, num_round=3), True),
    "dna-random-forest": Example(("dna.scale", "dna.scale.t"), ForestParams("Gini", min_node_size=20), True),
}


def load(spark: SparkSession, folder: str, example: Example) -> tuple[DataFrame, DataFrame]:
    """Training and test points of one width."""
    sparse = [read_libsvm(spark, f"{folder}/{f}", example.classify) for f in example.files]
    width = max(feature_width(s) for s in sparse)
    if len(sparse) == 1:
        sparse = hash_split(sparse[0], F.col("id").cast("long"), [0.75, 0.25], 7)
    train, test = (dense(s, width) for s in sparse)
    return train, test


def fit(example: Example, train: DataFrame, test: DataFrame) -> m.Model:
    p = example.params
    if isinstance(p, MultiBoostParams):
        return m.train_multi_boost(train, p)
    if isinstance(p, BoostParams):
        return m.train_boost(train, {"test": test}, p)[0]
    return m.train_forest(train, p) if isinstance(p, ForestParams) else m.train_tree(train, p)


def library_predictions(example: Example, train: DataFrame, test: DataFrame) -> list[DataFrame]:
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    p = example.params
    vectors = [df.withColumn("features", array_to_vector("features")) for df in (train, test)]
    fitted = DecisionTreeClassifier(maxDepth=p.max_depth, maxBins=p.max_bins, impurity=p.impurity.lower()).fit(vectors[0])
    return [fitted.transform(v).select("label", "prediction") for v in vectors]


def run(spark: SparkSession, name: str, folder: str) -> dict[str, float]:
    """Errors by data set: the share of wrong classes, or the root of the mean squared error."""
    example = EXAMPLES[name]
    train, test = load(spark, folder, example)
    if example.library:
        scored = library_predictions(example, train, test)
    else:
        model = fit(example, train, test)
        scored = [model.predict(train), model.predict(test)]
    error = (lambda df: df.agg(error_rate_of(F.col("label"), F.col("prediction"))).first()[0]) if example.classify else rmse
    return {"train": error(scored[0]), "test": error(scored[1])}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="arbor.examples", description=__doc__)
    p.add_argument("name", choices=sorted(EXAMPLES))
    p.add_argument("folder")
    a = p.parse_args(argv)
    for what, value in run(SparkSession.builder.appName(f"arbor {a.name}").getOrCreate(), a.name, a.folder).items():
        print(f"{what}: {value:.6f}")


if __name__ == "__main__":
    main()

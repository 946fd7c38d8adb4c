"""Training and prediction from the command line: ``python -m arbor.cli train|predict ALGORITHM --...``."""

from __future__ import annotations

import argparse
import logging
import time
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from arbor.functions.metrics import rmse
from arbor.operators import models as m
from arbor.plans.params import BoostParams, ForestParams, MultiBoostParams, TreeParams
from arbor.sources.libsvm import dense, feature_width, read_libsvm, write_predictions

LOG = logging.getLogger("arbor")
#: Algorithm to its parameters, and the values that its dialect sets.
ALGORITHMS = {
    "cart": (TreeParams, {}),
    "gbdt": (MultiBoostParams, {}),
    "gbrt": (BoostParams, {}),
    "random-forest": (ForestParams, {}),
    "local-decision-tree": (TreeParams, {"dialect": "local"}),
    "local-gradient-boost": (BoostParams, {"dialect": "local", "row_rate": 0.6, "col_rate": 0.6, "num_round": 20}),
    "local-random-forest": (ForestParams, {"dialect": "local"}),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="arbor", description=__doc__)
    actions = top.add_subparsers(dest="action", required=True)
    for action in ("train", "predict"):
        algorithms = actions.add_parser(action).add_subparsers(dest="algorithm", required=True)
        for name, (kind, fixed) in ALGORITHMS.items():
            p = algorithms.add_parser(name)
            p.add_argument("--model_pt", required=action == "predict" or not name.startswith("local"))
            if action == "predict":
                p.add_argument("--test_pt", required=True)
                p.add_argument("--predict_pt", required=True)
                continue
            p.add_argument("--train_pt", required=True)
            p.add_argument("--is_class", action="store_true", default=name == "gbdt")
            if "gbrt" in name or name.startswith("local"):
                p.add_argument("--valid_pt")
            if name == "gbrt":
                p.add_argument("--cp_pt", help="shared folder for intermediate tables")
            if name.startswith("local"):
                p.add_argument("--loss", default="SquaredError")
            for f in fields(kind):
                if f.name != "dialect":
                    default = fixed.get(f.name, f.default)
                    p.add_argument(f"--{f.name}", type=type(default), default=default)
    return top


def points(spark: SparkSession, path: str, is_class: bool, width: int = 0) -> DataFrame:
    rows = read_libsvm(spark, path, is_class)
    return dense(rows, max(width, feature_width(rows)))


def train(spark: SparkSession, a: argparse.Namespace) -> m.Model:
    kind, fixed = ALGORITHMS[a.algorithm]
    params = kind(**{f.name: fixed.get(f.name, f.default) if f.name == "dialect" else getattr(a, f.name) for f in fields(kind)})
    if getattr(a, "loss", None):
        from arbor.plans.params import loss_name

        loss_name(a.loss)
    if getattr(a, "cp_pt", None) and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", a.cp_pt)
    LOG.info("training %s: %s", a.algorithm, params.to_json())
    began = time.time()
    rows = points(spark, a.train_pt, a.is_class)
    valid = points(spark, a.valid_pt, a.is_class) if getattr(a, "valid_pt", None) else None
    sets = {"train": rows} | ({"valid": valid} if valid is not None else {})
    if kind is TreeParams:
        model: m.Model = m.train_tree(rows, params)
        if params.impurity == "Variance":
            for name, data in sets.items():
                LOG.info("rmse(%s) = %.6f", name, rmse(model.predict(data)))
    elif kind is ForestParams:
        model = m.train_forest(rows, params)
        if params.impurity == "Variance":
            for name, data in sets.items():
                for r in m.forest_errors(model, data).orderBy("trees").collect():
                    LOG.info("%d trees: rmse(%s) = %.6f", r["trees"], name, r["rmse"])
    elif kind is MultiBoostParams:
        model = m.train_multi_boost(rows, params)
    else:
        model, metrics = m.train_boost(rows, {"valid": valid} if valid is not None else {}, params)
        for r, name, value in metrics:
            LOG.info("round %d: rmse(%s) = %.6f", r, name, value)
    LOG.info("trained in %.1f s, %d nodes", time.time() - began, len(model.nodes))
    if a.model_pt:
        model.save(spark, a.model_pt)
    return model


def predict(spark: SparkSession, a: argparse.Namespace) -> None:
    model = m.load_model(spark, a.model_pt)
    is_class = isinstance(model, m.MultiBoostModel) or model.params.impurity == "Gini"
    write_predictions(model.predict(points(spark, a.test_pt, is_class)), a.predict_pt, model.params.dialect)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName(f"arbor {a.algorithm}").getOrCreate()
    train(spark, a) if a.action == "train" else predict(spark, a)


if __name__ == "__main__":
    main()

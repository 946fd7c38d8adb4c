"""Hyper-parameters of the training plans, one frozen record per algorithm."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields

DIALECTS = ("distributed", "local")
IMPURITIES = {"gini": "Gini", "variance": "Variance"}
LOSSES = {"squarederror": "SquaredError", "squared_error": "SquaredError"}


def impurity_name(name: str) -> str:
    """The canonical name of an impurity, whatever its first letter's case; ValueError for others."""
    if name not in ("Gini", "gini", "Variance", "variance"):
        raise ValueError(f"unknown impurity {name!r}: Gini or Variance")
    return IMPURITIES[name.lower()]


def loss_name(name: str) -> str:
    """The canonical name of a loss; ValueError for others."""
    if name.lower() not in LOSSES:
        raise ValueError(f"unknown loss {name!r}: SquaredError")
    return LOSSES[name.lower()]


@dataclass(frozen=True)
class TreeParams:
    """One tree. The local dialect splits ``v <= t`` on the last value of the left side, tests the size of the parent only,
    allows Variance alone and refuses constant features."""

    impurity: str = "Variance"
    max_depth: int = 10
    max_bins: int = 32
    bin_samples: int = 10000
    min_node_size: float = 15
    min_info_gain: float = 1e-6
    row_rate: float = 1.0
    col_rate: float = 1.0
    dialect: str = "distributed"
    seed: int = 7

    def __post_init__(self) -> None:
        object.__setattr__(self, "impurity", impurity_name(self.impurity))
        if self.dialect not in DIALECTS:
            raise ValueError(f"unknown dialect {self.dialect!r}: one of {DIALECTS}")
        if self.dialect == "local" and self.impurity != "Variance":
            raise ValueError("the local dialect grows by Variance only")
        if self.max_bins < 2:
            raise ValueError("max_bins must be 2 at least")
        if not 0 <= self.max_depth <= 60:
            raise ValueError("max_depth must be from 0 to 60: node ids are 64-bit heap numbers")

    def to_json(self) -> str:
        return json.dumps({"kind": type(self).__name__} | asdict(self))


@dataclass(frozen=True)
class ForestParams(TreeParams):
    """A random forest: trees of weighted rows and feature subsets drawn for every node."""

    row_rate: float = 0.6
    col_rate: float = 0.6
    num_trees: int = 20


@dataclass(frozen=True)
class BoostParams(TreeParams):
    """Boosted regression; the local dialect doubles the residual and can stop early (min_step)."""

    num_round: int = 10
    learn_rate: float = 0.02
    min_step: float = 1e-5

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.impurity != "Variance":
            raise ValueError("boosted regression fits residuals by Variance only")


@dataclass(frozen=True)
class MultiBoostParams(TreeParams):
    """Boosted classification: a tree per class and round on the residuals of softmax."""

    num_round: int = 10

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.impurity != "Variance":
            raise ValueError("boosted classification fits residuals by Variance only")


KINDS = {c.__name__: c for c in (TreeParams, ForestParams, BoostParams, MultiBoostParams)}


def from_json(text: str) -> TreeParams:
    """The record that ``to_json`` wrote."""
    values = json.loads(text)
    kind = KINDS[values.pop("kind")]
    return kind(**{k: v for k, v in values.items() if k in {f.name for f in fields(kind)}})

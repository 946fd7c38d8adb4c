"""The corpus pipeline: from raw documents to a sharded training mixture, stage by stage.

Every stage reads what its predecessor kept, written as Parquet in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.llm import decontaminate, language, minhash, mixing, sharding
from arbor.llm.common import load, materialize, quoted


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the trees know; those without letters or text go. A null lang is filled in."""
    model = language.train_on(docs)
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = language.identify(docs.toDF(*names), model, names[docs.columns.index("text")]).where(f"lang_pred <> '{language.UNKNOWN}'")
    filled = {n: F.coalesce(quoted(n), F.col("lang_pred")) for n, c in zip(names, docs.columns, strict=True) if c == "lang"}
    return found.select(*(filled.get(n, quoted(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of copies and near copies."""
    return minhash.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two benchmark items or more go; from others the windows are cut."""
    return decontaminate.decontaminated(docs, load(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at rates that bring clean and low-quality tokens to their target shares."""
    return mixing.mixed(docs, mixing.label_domains(load(spark, sf_dir, "labels")))


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard."""
    return sharding.with_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("mix", mix_domains),
    ("shard", assign_shards),
]

#: Trained models decide in two stages, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""Registered queries of the text operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbor.llm import chat, decontaminate, jpeg, language, mixing, secrets, sharding, subword, urls
from arbor.llm.common import crc_of_id, load
from arbor.llm.minhash import near_duplicates


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("items")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; the outcomes are ``labels.quality`` of the row with the page's id."""
    labels = load(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 1).alias("good"))
    return urls.url_verdicts(load(spark, sf_dir, "pages").select("page_id", "url"), outcomes).drop("url")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as JPEG and read back."""
    return jpeg.media_columns(load(spark, sf_dir, "documents").select("doc_id", "text"), with_media=False).drop("text")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    docs = load(spark, sf_dir, "documents")
    model = language.train_on(docs)
    held = (crc_of_id(F.col("doc_id")) % 3 == 1).alias("held_out")
    return language.identify(docs.select("doc_id", held, "text"), model).drop("text")


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each of its participants."""
    return chat.rotate(load(spark, sf_dir, "conversations"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, and its shard in a tree with one more."""
    return sharding.assign(load(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.report(load(spark, sf_dir, "documents"), secrets.train(secrets.default_samples(spark)))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain, rate and copies of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return mixing.mixture(docs, mixing.label_domains(load(spark, sf_dir, "labels")), carry=["doc_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from labels that aren't held out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_of_id(F.col("doc_id")) % 5 == 0
    labels = load(spark, sf_dir, "labels").where(~held).withColumn("quality", F.col("quality").cast("int"))
    model = subword.train(*subword.labelled_sample(docs, labels, "doc_id", "quality"))
    scored = subword.predict(docs, model, carry=["doc_id"])
    good = F.get("posterior", F.lit(model.classes.index("1"))) if "1" in model.classes else F.lit(0.0)
    return scored.select("doc_id", held.alias("held_out"), good.alias("score"), (good >= 0.3).cast("int").alias("predicted"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class id and size and the keep decision of every document."""
    return near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "keep", F.lower(F.hex("text_key")).alias("text_key"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_url_filter": op2_url_filter,
    "op3_media": op3_media,
    "op4_language": op4_language,
    "op5_perspectives": op5_perspectives,
    "op6_sharding": op6_sharding,
    "op8_secrets": op8_secrets,
    "op10_mixing": op10_mixing,
    "pipeline": pipeline,
    "op7_quality": op7_quality,
    "op9_near_duplicates": op9_near_duplicates,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op2_url_filter": urls.SQL,
    "op5_perspectives": chat.SQL,
    "op8_secrets": secrets.SQL,
}

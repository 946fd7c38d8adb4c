"""Mixing sources to target weights, with soft membership of documents in domains.

A classifier learned from a labelled table gives every document posteriors over the domains. Nonnegative rates of the
documents are then fitted so that the expected tokens of the domains, the sum of rate * tokens * posterior, meet the targets.

The fit is projected gradient descent on the squared residual, whitened by the domains' Gram matrix, from rates of 1. A rate
depends on its document's posterior and on the residuals so far alone, so a step is one distributed aggregation of as many
numbers as there are domains; nothing per document is stored between steps or leaves the executors.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbor.llm import subword
from arbor.llm.common import each_copy, fresh, materialize, quoted

LOG = logging.getLogger("arbor")


@dataclass(frozen=True)
class Mix:
    """targets: share of the tokens by domain, nonnegative, of which domains without one have 0. headroom: tokens of the anchor, as
    a multiple of what there is; from 1 on it is kept whole. The others are reduced to their shares beside it; one that is too
    scarce for its share stays at the same multiple. Without tokens of the anchor the scarcest domain takes its place.
    """

    targets: tuple[tuple[str, float], ...] = (("clean", 0.95), ("low", 0.05))
    anchor: str = "clean"
    headroom: float = 1.02
    steps: int = 30
    tolerance: float = 1e-6
    ridge: float = 1e-9
    training: subword.SubwordTraining = subword.SubwordTraining()


def label_domains(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)``: clean for quality 1, else low; rows without an id or quality are left out."""
    domain = F.when(F.col("quality") == 1, "clean").otherwise("low")
    return labels.where("doc_id is not null and quality is not null").select("doc_id", domain.alias("domain"))


def rate_of(posterior: Column, steps: list[list[float]]) -> Column:
    """The rate after the steps: from 1, less posterior . step each time, but not below 0."""
    moves = F.array(*(F.array(*map(F.lit, map(float, s))) for s in steps)) if steps else F.array().cast("array<array<double>>")
    dot = lambda s: F.aggregate(F.zip_with(posterior, s, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(moves, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))


def fit(scored: DataFrame, domains: list[str], mix: Mix) -> tuple[list[list[float]], dict[str, float]]:
    """Steps for :func:`rate_of`, and the target tokens by domain. ``scored(posterior, n_words)`` is read once a step."""
    k = len(domains)
    if not k:
        return [], {}
    p = lambda i: F.get("posterior", F.lit(i))
    t = F.col("n_words").cast("double")
    gram = [F.sum(t * p(i) * p(j)).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    first = scored.agg(*(F.sum(t * p(i)).alias(f"t{i}") for i in range(k)), *gram).first()
    now = np.array([first[f"t{i}"] or 0.0 for i in range(k)])
    total = now.sum()
    if total <= 0:
        return [], dict.fromkeys(domains, 0.0)
    m = np.array([[first[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    share = np.array([max(0.0, dict(mix.targets).get(d, 0.0)) for d in domains])
    if share.sum() <= 0:
        raise ValueError("no domain has a target")
    share = share / share.sum()
    there = {domains[i]: now[i] / share[i] for i in range(k) if share[i] > 0 and now[i] > 0}
    size = there.get(mix.anchor, min(there.values(), default=0.0))
    target = mix.headroom * (np.minimum(size * share, now) if mix.anchor in there else size * share)
    white = np.linalg.inv(m + mix.ridge * total * np.eye(k))
    steps: list[list[float]] = []
    for _ in range(mix.steps + 1):
        residual = now - target
        if np.abs(residual).max() <= mix.tolerance * total:
            break
        if len(steps) == mix.steps:
            LOG.warning("after %d steps the tokens of %s miss their targets by %.3g of all", mix.steps, domains[int(np.abs(residual).argmax())], np.abs(residual).max() / total)
            break
        steps.append([float(x) for x in white @ residual])
        r = rate_of(F.col("posterior"), steps)
        got = scored.select((r * t).alias("rt"), "posterior").agg(*(F.sum(F.col("rt") * p(i)).alias(f"t{i}") for i in range(k))).first()
        now = np.array([got[f"t{i}"] or 0.0 for i in range(k)])
    return steps, dict(zip(domains, map(float, target), strict=True))


def copies_of(rate: Column, *key: Column, seed: int = 5) -> Column:
    """How often a row is taken: the rate rounded up or down at random by a hash of its key, right on average."""
    u = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    return F.floor(rate + u).cast("int")


def mixture(docs: DataFrame, labelled: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (default: all) with posterior, n_words, domain, rate and copies (names are replaced).

    labelled(id, domain) is what the classifier learns from. domain: the likeliest, ties to the first by name, null without
    labels, when every rate is 1. Rows draw their copies by id and text. A null or empty text has 0 tokens and the posterior of the labels' shares; its rate follows
    from that. Rows are scored once, written to the shared folder and then read column by column for the fit.
    """
    mix = mix or Mix()
    model = subword.train(*subword.labelled_sample(docs, labelled, id_col, "domain", text_col, mix.training), mix.training)
    new = ("domain", "rate", "copies")
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    draw = fresh(docs, "mix_draw")
    scored = materialize(subword.predict(docs.withColumn(draw, F.xxhash64(quoted(text_col).cast("string"))), model, text_col, [*kept, draw]), "scored")
    steps, _ = fit(scored, model.classes, mix)
    names = F.array(*map(F.lit, model.classes)) if model.classes else F.array().cast("array<string>")
    domain = F.get(names, (F.array_position("posterior", F.array_max("posterior")) - 1).cast("int")) if model.classes else F.lit(None).cast("string")
    rated = scored.withColumn("domain", domain).withColumn("rate", rate_of(F.col("posterior"), steps))
    return rated.withColumn("copies", copies_of(F.col("rate"), quoted(id_col), F.col(draw))).drop(draw)


def mixed(docs: DataFrame, labelled: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, each row as often as its copies say."""
    names = {c: fresh(docs, f"mix_{i}") for i, c in enumerate(docs.columns)}
    safe = docs.select(*(quoted(c).alias(names[c]) for c in docs.columns))
    rows = mixture(safe, labelled.select(quoted(id_col).alias(names[id_col]), "domain"), mix, names[id_col], names[text_col])
    many = each_copy(rows.select(*(F.col(names[c]) for c in docs.columns), F.col("copies").alias("mix_copies")), "mix_copies", "mix_copy")
    return many.select(*(F.col(names[c]).alias(c) for c in docs.columns))

"""The fit of rates against a dense solver, and every pipeline stage against what it must do."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from arbor.llm import language, mixing, subword
from tests.llm.test_decontaminate_urls import brute, words
from tests.llm.test_minhash import brute as classes

SF = "/root/testdata/sf0.001"


def scored(spark, p, words):
    return spark.createDataFrame([(list(map(float, a)), int(n)) for a, n in zip(p, words, strict=True)], "posterior array<double>, n_words long")


def test_rates_meet_targets_and_equal_a_dense_descent(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4, 0.3, 0.2], 400)
    n = rng.integers(0, 900, 400)
    mix = mixing.Mix(targets=(("a", 0.2), ("b", 0.3), ("c", 0.5)), headroom=0.9, steps=60)
    frame = scored(spark, p, n)
    steps, target = mixing.fit(frame, ["a", "b", "c"], mix)
    rates = np.array([r["r"] for r in frame.select(mixing.rate_of(F.col("posterior"), steps).alias("r")).collect()])
    assert rates.min() >= 0
    got = (rates * n) @ p
    assert np.abs(got - np.array([target[k] for k in "abc"])).max() <= 1e-4 * got.sum()
    r, want = np.ones(400), np.array([target[k] for k in "abc"])
    white = np.linalg.inv((p * n[:, None]).T @ p + mix.ridge * n.sum() * np.eye(3))
    for _ in steps:
        r = np.maximum(0, r - p @ (white @ ((r * n) @ p - want)))
    assert np.abs(r - rates).max() < 1e-6


def test_unreachable_targets_stay_nonnegative(spark):
    frame = scored(spark, [[0.9, 0.1]] * 20 + [[0.6, 0.4]] * 20, [10] * 40)
    steps, _ = mixing.fit(frame, ["a", "b"], mixing.Mix(targets=(("a", 0.01), ("b", 0.99))))
    rates = [r["r"] for r in frame.select(mixing.rate_of(F.col("posterior"), steps).alias("r")).collect()]
    assert min(rates) >= 0 and np.isfinite(rates).all()
    with pytest.raises(ValueError):
        mixing.fit(frame, ["a", "b"], mixing.Mix(targets=(("z", 1.0),)))


@pytest.mark.parametrize("low", [0.0, 0.001, 0.02, 0.11])
def test_clean_documents_stay_whole_however_few_are_low(spark, low):
    rng = np.random.default_rng(4)
    is_low = np.arange(2000) < round(2000 * low)
    p = np.where(is_low, rng.uniform(0.9, 0.999, 2000), rng.uniform(0.0001, 0.002, 2000))
    frame = scored(spark, np.column_stack([1 - p, p]), np.full(2000, 100))
    steps, _ = mixing.fit(frame, ["clean", "low"], mixing.Mix())
    rates = np.array([r["r"] for r in frame.select("posterior", mixing.rate_of(F.col("posterior"), steps).alias("r")).collect()])
    got = np.array([((1 - p) * rates).sum(), (p * rates).sum()])
    assert rates[~is_low].min() >= 1.0 and got[0] >= (1 - p).sum()
    if p.sum() > 0.05 * 2000:
        assert abs(got[1] / got.sum() - 0.05) < 1e-4
    else:
        assert np.allclose(rates, 1.02, atol=1e-4)


def test_mixture_of_odd_rows(spark):
    rows = [(i, ("good words " if i % 2 else "BAD!! %%% ") * 20, "x", "y") for i in range(60)] + [(None, "a", "x", "y"), (90, None, "x", "y"), (91, "", "x", "y"), (1, "again", "x", "y"), (1, "again", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate string, posterior string")
    labelled = spark.createDataFrame([(i, "clean" if i % 2 else "low") for i in range(60)] + [(None, "low"), (3, None)], "doc_id long, domain string")
    out = mixing.mixture(docs, labelled).collect()
    assert len(out) == len(rows) and all(r["rate"] >= 0 and abs(r["copies"] - r["rate"]) <= 1 for r in out)
    mixed = mixing.mixed(docs, labelled)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert {r["rate"] for r in mixing.mixture(docs, labelled.where("false")).collect()} == {1.0}
    assert mixing.mixture(docs.where("false"), labelled).count() == 0


def test_copies_are_right_on_average(spark):
    n = spark.range(20000).select(mixing.copies_of(F.lit(1.3), F.col("id")).alias("c"))
    assert abs(n.agg(F.avg("c")).first()[0] - 1.3) < 0.02 and {r["c"] for r in n.distinct().collect()} == {1, 2}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    more = [(9001, bench[0][1] + " " + bench[1][1]), (9002, "Clean before. " + bench[2][1] + " Clean after."), (9003, None), (9004, "12 34"), (9005, docs.first()["text"])]
    extra = spark.createDataFrame([(i, t, None, "src", 0) for i, t in more], docs.schema)
    frames = [docs.unionByName(extra)]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        f(spark, frames[-1], SF).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def test_stage_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "mix", "shard"]
    assert all(f.columns == stages[0].columns for f in stages[1:-1])
    assert stages[-1].columns == [*stages[0].columns, "shard"]


def test_language_stage_drops_only_unknown(stages):
    before, after = ({r["doc_id"]: r for r in f.collect()} for f in stages[:2])
    assert set(before) - set(after) == {i for i, r in before.items() if not any(c.isalpha() for c in r["text"] or "")}
    assert {9003, 9004} <= set(before) - set(after)
    assert all(r["lang"] is not None and r["text"] == before[i]["text"] for i, r in after.items())


def test_dedup_stage_keeps_one_of_each_class(stages):
    before, after = ([(r["doc_id"], r["text"]) for r in f.select("doc_id", "text").collect()] for f in stages[1:3])
    of = classes(before)
    assert sorted(of[r] for r in after) == sorted(set(of.values()))


def test_decontamination_stage_equals_brute_force(spark, stages):
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = ({r["doc_id"]: r["text"] for r in f.select("doc_id", "text").collect()} for f in stages[2:4])
    found = {i: brute(t, bench) for i, t in before.items()}
    assert set(after) == {i for i, f in found.items() if not f[4]} and 9001 not in after
    for i, t in after.items():
        if found[i][1] == 0:
            assert t == before[i]
        else:
            assert len(words(t)) == found[i][0] - found[i][1]
    assert "Clean before." in after[9002] and "Clean after." in after[9002]


def test_mix_and_shard_stages(spark, stages):
    before, after = (f.select("doc_id").collect() for f in stages[3:5])
    assert {r[0] for r in after} <= {r[0] for r in before}
    labels = mixing.label_domains(spark.read.parquet(f"{SF}/labels.parquet"))
    want = mixing.mixture(stages[3], labels, carry=["doc_id"]).agg(F.sum("copies")).first()[0]
    assert len(after) == want
    assert stages[5].count() == len(after) and stages[5].where("shard < 0 or shard > 23").count() == 0


def test_registered(spark):
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None


def test_nothing_else_imports_the_text_operators():
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, files in os.walk(os.path.join(top, "arbor")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "arbor.llm" not in source.read()


def test_training_is_deterministic(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    a, b = language.train_on(docs), language.train_on(docs.repartition(5))
    assert (a.costs == b.costs).all() and (a.grams.keys == b.grams.keys).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    x, y = (subword.labelled_sample(d, labels, "doc_id", "quality") for d in (docs, docs.repartition(3)))
    assert x == y

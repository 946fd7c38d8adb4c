"""Metrics, TF-IDF, libsvm text, sampling, streams and the command line on known values."""

import math
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arbor import cli, examples
from arbor.functions import loss, metrics, sampling
from arbor.operators import models, tfidf
from arbor.plans.params import ForestParams, TreeParams, loss_name
from arbor.sources import libsvm
from arbor.streaming.scoring import score_stream


def pairs(spark, rows):
    return spark.createDataFrame([(float(a), float(b)) for a, b in rows], "label double, prediction double")


def test_known_metrics(spark):
    hard = pairs(spark, [(1, 1), (1, 1), (1, 0), (0, 0), (0, 1), (0, 0), (0, 0)])
    assert round(metrics.auc(hard), 6) == 0.708333
    r = metrics.classification_report(hard).first()
    assert [round(x, 6) for x in r] == [round(5 / 7, 6), round(2 / 3, 6), round(2 / 3, 6)]
    assert round(metrics.auc(pairs(spark, [(1, 0.9), (1, 0.4), (0, 0.35), (0, 0.8), (0, 0.1)])), 6) == 0.833333
    assert metrics.classification_report(pairs(spark, [(1, 0), (0, 0)])).first()["precision"] == 1.0
    assert metrics.classification_report(pairs(spark, [(0, 0), (0, 1)])).first()["recall"] == 1.0
    for bad in (lambda: metrics.auc(pairs(spark, [(0, 0.5)])), lambda: metrics.accuracy(pairs(spark, [])), lambda: metrics.rmse(pairs(spark, []))):
        with pytest.raises(ValueError):
            bad()


def test_softmax_residuals_do_not_overflow(spark):
    r = spark.range(1).select(loss.softmax_residuals(F.lit(0), F.array(F.lit(1000.0), F.lit(0.0))).alias("r")).first()["r"]
    assert [round(x, 9) for x in r] == [0.0, 0.0]


def test_known_tfidf(spark):
    docs = spark.createDataFrame([(0, "a b a"), (1, "a c"), (2, "b d d a")], "doc_id long, text string")
    got = {(r["doc_id"], r["term"]): round(r["tfidf"], 6) for r in tfidf.tfidf(docs).collect()}
    assert got == {(0, "a"): -0.191788, (0, "b"): 0.0, (1, "a"): -0.143841, (1, "c"): 0.202733, (2, "b"): 0.0, (2, "d"): 0.202733, (2, "a"): -0.071921}
    ids = {r["term"]: r["term_id"] for r in tfidf.dictionary(docs).collect()}
    assert ids == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert {r["doc_id"]: r["vector"].split(" ")[0].split(":")[0] for r in tfidf.vectors(tfidf.tfidf(docs), tfidf.dictionary(docs)).collect()} == {0: "0", 1: "0", 2: "0"}
    chars = spark.createDataFrame([(0, "你好世界")], "doc_id long, text string")
    assert [r["term"] for r in tfidf.terms(chars, tfidf.char_ngrams()).orderBy("pos").collect()] == ["你好", "好世", "世界"]
    assert tfidf.document_frequency(docs).where("term = 'a'").first()["df"] == 3


def by_hand(docs):
    """Counts and weights of ``(doc_id, text)`` by a plain walk; rows of one id are one document."""
    counts, first = {}, {}
    for d, text in docs:
        for pos, t in enumerate((text or "").lower().split()):
            counts[d, t] = counts.get((d, t), 0) + 1
            first[t] = min(first.get(t, (1 << 63, 0)), (1 << 62 if d is None else d, pos))
    size, df = {}, {}
    for (d, t), n in counts.items():
        size[d] = size.get(d, 0) + n
        df[t] = df.get(t, 0) + 1
    weights = {(d, t): n / size[d] * math.log(len(docs) / (df[t] + 1)) for (d, t), n in counts.items()}
    return counts, weights, {t: i for i, t in enumerate(sorted(first, key=first.get))}


#: Ids that come again, once as null, with and without text.
REPEATED = [(1, "a b a"), (1, "a x"), (2, "A c"), (3, None), (4, " "), (None, "n m n"), (None, "p q r n"), (5, "b c d a"), (3, "z"), (6, "")]


def exchanges(df):
    return re.findall(r"Exchange ([^,]*)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("most", [tfidf.BROADCAST_BYTES, 300, 0])
def test_vectors_by_common_and_rare_terms(spark, monkeypatch, most):
    monkeypatch.setattr(tfidf, "BROADCAST_BYTES", most)
    _, weights, ids = by_hand(REPEATED[1:])
    got = {r["doc_id"]: r["vector"] for r in tfidf.document_vectors(spark.createDataFrame(REPEATED[1:], "doc_id long, text string")).collect()}
    pairs = {d: sorted((ids[t], round(w, 6) + 0.0) for (e, t), w in weights.items() if e == d) for d, _ in weights}
    # two texts without an id have terms at the same place, whose order is open
    assert {d: v for d, v in got.items() if d is not None} == {d: " ".join(f"{i}:{w:.6f}" for i, w in p) for d, p in pairs.items() if d is not None}
    assert sorted(x.split(":")[1] for x in got[None].split(" ")) == sorted(f"{w:.6f}" for _, w in pairs[None])


def test_vectors_shuffle_no_common_terms(spark, sf):
    assert [x.split("#")[0] for x in exchanges(entry.queries()["tfidf_vectors"](spark, sf)) if "hashpartitioning" in x] == ["hashpartitioning(doc_id"]


@pytest.mark.parametrize("most", [tfidf.BROADCAST_BYTES, 300, 0])
def test_weights_by_common_and_rare_terms(spark, monkeypatch, most):
    monkeypatch.setattr(tfidf, "BROADCAST_BYTES", most)
    got = [(r["doc_id"], r["term"], r["tfidf"]) for r in tfidf.tfidf(spark.createDataFrame(REPEATED, "doc_id long, text string")).collect()]
    want = by_hand(REPEATED)[1]
    assert len(got) == len(want) and all(abs(w - want[d, t]) < 1e-12 for d, t, w in got)


def test_weights_shuffle_no_common_terms(spark, sf):
    assert not [x for x in exchanges(entry.queries()["tfidf_weights"](spark, sf)) if "hashpartitioning" in x]


def test_rounded(spark):
    values = [0.0, 1 / 1024, -1 / 1024, 0.1, -0.191788231, 2.5, 1 / 3, 8.517193191]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(tfidf.rounded(F.col("v"), 9)).collect()
    assert [r[0] for r in got] == [0.0, 0.000976563, -0.000976563, 0.1, -0.191788231, 2.5, 0.333333333, 8.517193191]


def test_term_counts_inside_rows(spark, sf):
    for docs in (REPEATED, REPEATED[1:], REPEATED[6:7]):
        got = [(r["doc_id"], r["term"], r["count"]) for r in tfidf.term_counts(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
        assert sorted(got, key=str) == sorted(((d, t, n) for (d, t), n in by_hand(docs)[0].items()), key=str)
    for name in ("term_counts", "segmented_terms"):
        assert not exchanges(entry.queries()[name](spark, sf))


def lines(spark, rows, tmp_path):
    path = str(tmp_path / "points.txt")
    with open(path, "w") as f:
        f.write("\n".join(rows))
    return path


def test_libsvm(spark, tmp_path):
    path = lines(spark, ["-1 3:1 11:1", "+1  2:0.5 4:1.5", "", "-1"], tmp_path)
    rows = libsvm.read_libsvm(spark, path, True).orderBy("id").collect()
    assert [(r["label"], r["features"]) for r in rows] == [(0.0, {2: 1.0, 10: 1.0}), (1.0, {1: 0.5, 3: 1.5}), (0.0, {})]
    assert [r["id"] for r in rows] == ["0", "1", "3"]
    assert libsvm.feature_width(libsvm.read_libsvm(spark, path)) == 11
    three = lines(spark, ["1 1:1", "2 1:1", "3 1:1"], tmp_path)
    assert sorted(r["label"] for r in libsvm.read_libsvm(spark, three, True).collect()) == [0, 1, 2]
    assert sorted(r["label"] for r in libsvm.read_libsvm(spark, three, False).collect()) == [1, 2, 3]
    reals = lines(spark, ["-2.5 1:1", "0.5 1:1", "3 1:1"], tmp_path)
    assert sorted(r["label"] for r in libsvm.read_libsvm(spark, reals, False).collect()) == [0, 0.5, 3]
    assert sorted(r["label"] for r in libsvm.read_libsvm(spark, reals, False, compat_clamp=False).collect()) == [-2.5, 0.5, 3]


def test_line_ids_over_many_files(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("string").alias("value")).repartition(7).write.text(str(tmp_path / "many"))
    ids = sorted(int(r["id"]) for r in libsvm.line_ids(spark.read.text(str(tmp_path / "many"))).collect())
    assert ids == list(range(100))
    assert libsvm.read_documents(spark, str(tmp_path / "many")).count() == 100


def test_sampling(spark):
    rows = spark.range(20000).withColumn("w", sampling.poisson_weight(F.col("id"), 0.6, 3, 1))
    r = rows.agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(r[0] - 0.6) < 0.03 and abs(r[1] - 0.6) < 0.05
    parts = sampling.hash_split(rows, F.col("id"), [0.75, 0.25], 5)
    assert sum(p.count() for p in parts) == 20000 and abs(parts[0].count() - 15000) < 300
    u = rows.select(F.max(F.abs(sampling.uniform(F.col("id"), 9, 4) - F.udf(lambda i: sampling.uniform_value(i, 9, 4), "double")("id")))).first()[0]
    assert u == 0
    assert len(sampling.feature_subset(10, 0.55, 1, 2, 3)) == 6 == math.ceil(5.5)
    assert sampling.binning_fraction(32, 100, 2048) == 0.5


def test_stream_scores_like_a_batch(spark, tmp_path):
    points = spark.createDataFrame([(str(i), float(i % 5), [float(i % 7)]) for i in range(200)], "id string, label double, features array<double>")
    model = models.train_tree(points, TreeParams(max_depth=3))
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    score_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 200 and out.exceptAll(model.predict(points).select("id", "label", "prediction")).count() == 0


@pytest.mark.parametrize("name,more", [("cart", ["--impurity", "gini"]), ("gbrt", []), ("random-forest", ["--num_trees", "2"]), ("local-gradient-boost", ["--num_round", "2"])])
def test_command_line(spark, tmp_path, name, more):
    path = lines(spark, [f"{i % 2} 1:{i % 7} 2:{i % 3}" for i in range(120)], tmp_path)
    rounds = ["--num_round", "2", "--valid_pt", path] if name == "gbrt" else []
    cli.main(["train", name, "--train_pt", path, "--model_pt", str(tmp_path / "m"), "--max_depth", "2", *more, *rounds])
    cli.main(["predict", name, "--model_pt", str(tmp_path / "m"), "--test_pt", path, "--predict_pt", str(tmp_path / "p")])
    out = spark.read.text(str(tmp_path / "p"))
    assert out.count() == 120 and len(out.first()["value"].split("\t")) == (2 if name.startswith("local") else 3)


def test_names():
    assert loss_name("squared_error") == "SquaredError"
    with pytest.raises(ValueError):
        loss_name("log")


@pytest.mark.parametrize("name", ["a1a-library-tree", "a1a-cart", "dna-gbdt", "dna-random-forest", "cadata-cart", "cadata-local-random-forest"])
def test_examples(spark, tmp_path, name):
    example = examples.EXAMPLES[name]
    small = {"num_trees": 2} if "forest" in name else {"num_round": 2} if "gbdt" in name else {}
    if small:
        example = replace(example, params=replace(example.params, max_depth=3, **small))
    for f in example.files:
        with open(tmp_path / f, "w") as out:
            out.write("\n".join(f"{(i % 4 > 1) + 0 if example.classify else i % 4} 1:{i % 4} 2:{i % 9 + 1}" for i in range(400)))
    error = dict(examples.run(spark, name, str(tmp_path))) if not small else None
    if small:
        train, test = examples.load(spark, str(tmp_path), example)
        scored = examples.fit(example, train, test).predict(test)
        error = {"test": metrics.rmse(scored)}
    assert error["test"] < 0.6


def test_errors_of_a_growing_forest(spark):
    points = spark.createDataFrame([(i, float(i % 5), [float(i % 7), float(i % 5)]) for i in range(300)], "id long, label double, features array<double>")
    model = models.train_forest(points, ForestParams(num_trees=3, max_depth=3), F.col("id"))
    got = {r["trees"]: r["rmse"] for r in models.forest_errors(model, points).collect()}
    assert sorted(got) == [1, 2, 3]
    assert abs(got[3] - metrics.rmse(model.predict(points))) < 1e-9


def test_labeled_points_as_text(spark):
    lines = ["(1.0,[0.5,2.0])", " ( -1 , [ 3 , 4e-1 ] ) ", "(2.0,(4,[1,3],[7.0,8.5]))", "(0.0,(3,[],[]))", "3,1.5 2.5", "", "(5.0,[])"]
    got = libsvm.parse_points(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["label"], r["features"]) for r in got] == [(1.0, [0.5, 2.0]), (-1.0, [3.0, 0.4]), (2.0, [0.0, 7.0, 0.0, 8.5]), (0.0, [0.0, 0.0, 0.0]), (3.0, [1.5, 2.5]), (5.0, [])]
    points = spark.createDataFrame([(1.5, [0.1, -2.0, 1e-9]), (0.0, [3.0])], "label double, features array<double>")
    assert libsvm.parse_points(libsvm.to_points(points)).exceptAll(points).count() == 0
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        libsvm.parse_points(spark.createDataFrame([("(x,[1.0])",)], "value string")).collect()


def test_longest_matches_equal_a_plain_walk(spark):
    lexicon = ["中", "中国", "中国人", "人民", "国", "a.b", "c++", "c"]
    text = "中国人民 a.bc++ 国x12中人 axb cc+民"

    def walk(s):
        out, i = [], 0
        while i < len(s):
            if s[i].isspace():
                i += 1
                continue
            word = max((w for w in lexicon if s.startswith(w, i)), key=len, default=None)
            run = next((k for k in range(i, len(s)) if not (s[k].isascii() and s[k].isalnum())), len(s)) - i
            n = len(word) if word else max(1, run)
            out.append(s[i : i + n])
            i += n
        return out

    one = spark.createDataFrame([(text,)], "t string")
    assert one.select(tfidf.longest_matches(lexicon)(F.col("t"))).first()[0] == walk(text)
    assert one.select(tfidf.longest_matches([])(F.col("t"))).first()[0][0] == "中"


def test_line_ids_follow_file_names(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, size in (("b", 5), ("a", 90), ("c", 40)):
        (tmp_path / "d" / name).write_text("".join(f"{name}{i}\n" for i in range(size)))
    got = libsvm.read_documents(spark, str(tmp_path / "d")).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [f"{n}{i}" for n, size in (("a", 90), ("b", 5), ("c", 40)) for i in range(size)]

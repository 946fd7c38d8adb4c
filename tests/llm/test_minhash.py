"""Near-duplicate classes against brute force, and the defined results for odd inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from arbor.llm import minhash as m
from arbor.llm import textbytes as tb

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SCHEMA = "doc_id long, text string, key string, id string"


def shingles(text):
    words = WORD.findall(text.encode().lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


WEIGHTS = {"log": lambda c: round(16 * (1 + math.log(c))), "count": lambda c: c, "set": lambda c: 1}


def similarity(a, b, weights="log"):
    """Weighted Jaccard similarity of two bags of shingles."""
    w = lambda c: WEIGHTS[weights](c) if c else 0
    both = sum(min(w(a[k]), w(b[k])) for k in a.keys() & b.keys())
    return both / max(1, sum(map(w, a.values())) + sum(map(w, b.values())) - both)


def brute(rows, weights="log"):
    texts = sorted({t for _, t in rows if t is not None})
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and similarity(sets[i], sets[j], weights) >= 0.8:
                root[find(i)] = find(j)
    of = {t: find(i) for i, t in enumerate(texts)}
    ids = {}
    for i, t in rows:
        if t is not None and i is not None:
            ids[of[t]] = min(i, ids.get(of[t], i))
    return {(i, t): (ids.get(of[t]) if t is not None else i) for i, t in rows}


def made(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghé", k=5)) for _ in range(400)]
    rows, n = [], 0
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([3, 6, 40, 200, 400]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((n, " ".join(words)))
            n += 1
    return rows


def test_classes_equal_brute_force(spark):
    rows = [*made(), (900, ""), (901, ""), (902, "!!! ..."), (903, None), (904, None), (None, "a b c"), (905, "a b c"), (905, "a b c"), (905, "A  b. c!")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = m.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    by_key = {}
    for i, t in rows:
        key = spark.createDataFrame([(t,)], "t string").selectExpr("unhex(md5(cast(t as binary))) k").first()["k"] if t is not None and t not in by_key else by_key.get(t)
        by_key[t] = key
    keys = {(i, None if by_key[t] is None else bytes(by_key[t])): want[(i, t)] for i, t in rows}
    for r in got:
        assert r["class_id"] == keys[(r["doc_id"], None if r["text_key"] is None else bytes(r["text_key"]))]


def test_one_row_of_each_class_stays(spark):
    rows = [*made(7), (700, None), (701, None), (5, "same text here"), (5, "same text here")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    kept = m.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = brute(rows)
    assert kept.where("text is not null").count() == len({want[r] for r in rows if r[1] is not None} | {"same"} - {"same"})
    assert kept.where("text is null").count() == 2


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert m.near_duplicates(df).count() == 0
    assert m.drop_near_duplicates(df).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(words)))
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got} == {0}
    assert sum(r["keep"] for r in got) == 1


@pytest.mark.parametrize("weights", ["log", "count", "set"])
def test_signatures_estimate_weighted_similarity(weights):
    a = np.repeat(np.arange(300, dtype=np.uint64), 1 + np.arange(300) % 9)
    b = np.repeat(np.arange(60, 360, dtype=np.uint64), 1 + np.arange(300) % 4)
    e, counts = m.weighted(tb.mix(np.concatenate([a, b])), np.array([len(a), len(b)]), weights)
    s = m.dart_signatures(e, counts, 6000)
    assert abs((s[0] == s[1]).mean() - similarity(Counter(a.tolist()), Counter(b.tolist()), weights)) < 0.03


def test_layers_add_up_to_weights():
    for c in (1, 2, 3, 10, 999, 10**6):
        grows, units = m.layers(c, "log")
        assert units.sum() == WEIGHTS["log"](c) and 1 <= units.min() and units.max() <= m.UNITS and grows.max() <= c


def test_texts_that_repeat_their_lines(spark):
    """Weights of 1 + ln(count): a line is heavier where it is repeated, but not by as much as it is repeated."""
    rng = random.Random(2)
    line = lambda: " ".join(f"r{rng.randrange(300)}" for _ in range(12)) + " "
    rows = []
    for _ in range(12):
        lines = [line() for _ in range(rng.choice([2, 5, 9]))]
        for _ in range(4):
            rows.append((len(rows), "".join(x * rng.choice([1, 1, 2, 3, 9, 40]) for x in lines)))
    for weights in ("log", "count", "set"):
        got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), params=m.NearDuplicates(weights=weights)).collect()
        assert {r["doc_id"]: r["class_id"] for r in got} == {i: c for (i, _), c in brute(rows, weights).items()}, weights


def test_word_hashes_across_blocks(monkeypatch):
    text = b"Alpha beta  GAMMA-delta \xc3\xa9t\xc3\xa9 " * 30 + b"z" * 200
    whole, n = tb.word_hashes(np.frombuffer(text * 2, dtype=np.uint8), np.array([0, len(text), 2 * len(text)]))
    monkeypatch.setattr(tb, "BLOCK", 64)
    parts, k = tb.word_hashes(np.frombuffer(text * 2, dtype=np.uint8), np.array([0, len(text), 2 * len(text)]))
    assert n.tolist() == k.tolist() == [151, 151]
    assert (whole == parts).all() and (whole[:151] == whole[151:]).all()


def test_links_that_both_centers_miss(spark):
    """Near copies of near copies: many pairs are alike that are unlike the smallest and the largest text of their bucket."""
    rng = random.Random(11)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(120)]
        for _ in range(40):
            words = list(base)
            for at in rng.sample(range(120), rng.choice([1, 1, 2, 2, 3])):
                words[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for (i, _), c in brute(rows).items()}


def drifting(seed, groups=5, copies=30):
    """Copies of copies: chains of edits, shared edits and lengths that differ, all within a few groups."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        made_so_far = [[f"g{g}w{i}" for i in range(rng.choice([60, 90, 120]))]]
        for _ in range(copies):
            words = list(rng.choice(made_so_far[-4:] + made_so_far[:2]))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                at = rng.randrange(len(words))
                words[at : at + rng.choice([0, 1, 1])] = [f"v{rng.randrange(6)}"] * rng.choice([0, 1, 1])
            made_so_far.append(words)
        rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate(made_so_far)]
    return rows


@pytest.mark.parametrize("small,rare", [(8, 8), (2, 2), (1, 1), (2, 30)])
def test_large_buckets_lose_no_link(spark, small, rare):
    rows = drifting(small + rare)
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), params=m.NearDuplicates(small=small, rare=rare)).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {i: c for (i, _), c in brute(rows).items()}


def test_components_of_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200 + i, 230) for i in range(30)] + [(300, 300)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 109), 100), **dict.fromkeys(range(201, 231), 200)}
    found = m.components(frame)
    assert {r["node"]: r["root"] for r in found.collect()} == want
    more = m.components(spark.createDataFrame([(40, 107), (500, 499)], "a long, b long"), found)
    assert {r["node"]: r["root"] for r in more.collect()} == {**{k: 0 if v == 100 else v for k, v in want.items()}, 100: 0, 500: 499}
    assert m.components(frame.where("a > 900")).count() == 0

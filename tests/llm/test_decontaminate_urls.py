"""Benchmark windows and URL rules against brute force, and the defined results for odd inputs."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbor.llm import decontaminate as d
from arbor.llm import urls as u

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(d.UPPER, d.LOWER)
DOCS = "doc_id long, text string, key string, items string, pos string"


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(8, len(b))
        for i in range(len(b) - n + 1) if n else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(item))
    ids = sorted(found)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(ids) >= 2


def made():
    rng = random.Random(2)
    vocabulary = ["Étude", "été", "Alpha", "beta", "straße", "Σας", "x1", "zeta", "Kelvin\u212a", "omega"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 7, 8, 9, 20])))) for i in range(12)]
    items += [(3, "Second text of a known id with more than eight words"), (20, ""), (21, None), (None, "no id here at all but many words in it")]
    docs = []
    for i in range(60):
        text = rng.choices(vocabulary, k=rng.choice([0, 2, 10, 60]))
        for _ in range(rng.choice([0, 1, 2])):
            body = rng.choice(items)[1] or ""
            text[rng.randrange(len(text) + 1) : 0] = [x.upper() if x.isascii() and rng.random() < 0.5 else x for x in body.split()]
        docs.append((i, ", ".join(text)))
    docs += [(None, "beta"), (60, None), (60, None), (61, ""), (61, "beta"), (61, "beta"), (62, items[3][1] + " lang " * 3000 + items[4][1])]
    return docs, items


@pytest.mark.parametrize("most", [10**6, 0])
def test_contamination_equals_brute_force(spark, most, monkeypatch):
    docs, items = made()
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    real = d.hits
    monkeypatch.setattr(d, "hits", lambda a, b: real(a, b, most_broadcast=most))
    got = d.contamination(df, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    known = [(i, b) for i, b in items if i is not None]
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute(t, known)) for i, t in docs), key=str)


def test_decontaminated_texts(spark):
    one, two = "a1 a2 a3 a4 a5 a6 a7 a8 a9", "b1 b2 b3 b4 b5 b6 b7 b8"
    docs = [(1, "clean text stays."), (2, f"Before, {one.upper()} - after!"), (3, f"{one} {two}"), (4, None), (5, ""), (2, f"Before, {one.upper()} - after!")]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in docs], DOCS)
    out = d.decontaminated(df, spark.createDataFrame([(1, one), (2, two)], "item_id long, text string"))
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == [(1, "clean text stays."), (2, "Before, after!"), (2, "Before, after!"), (4, None), (5, "")]


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c", "", "", "")], DOCS)
    assert d.contamination(docs, bench).count() == 0 and d.decontaminated(docs, bench).count() == 0
    assert d.contamination(some, bench).first()["n_words"] == 3 and d.decontaminated(some, bench).count() == 1


def test_no_python_on_the_native_path(spark):
    docs = spark.createDataFrame([(1, "a b c", "", "", "")], DOCS)
    plan = d.contamination(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("pythonUDF", ""))


URLS = [
    "https://Example.COM/en/7/x?q", "http://a.example.com/en/8", "http://x.net/de/1", "http://y.example.net/de/8#a", "http://b.org/es/", "http://b.org/es", "http://notcom/en/", "no scheme", None, "", "http://h",
    "http://h?x=/en/", "a://b://c/d", "http://com/en/", "http://mycom.com:80/en/", "http://Ünï.com/en/\nline",
]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = m[1].translate(FOLD), m[2]
    best = None
    for rule, verdict in u.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_hosts_paths_and_rules(spark):
    rows = [(i, x, "h", "v") for i, x in enumerate(URLS)] + [(0, URLS[0], "h", "v"), (None, URLS[2], "h", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    outcomes = spark.createDataFrame([(0, True), (3, None), (None, False)], "page_id long, good boolean")
    out = u.url_verdicts(pages, outcomes).collect()
    assert len(out) == len(rows)
    for r in out:
        host, path, best = brute_url(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == best[1] if best else r["verdict"] in ("allow", "block")
    assert u.url_verdicts(pages.where("false"), outcomes).count() == 0


def test_reputation_shrinks_and_filters(spark):
    rows, good = [], []
    for host, n, s in (("good.a.com", 200, 198), ("mid.a.com", 200, 120), ("bad.b.com", 200, 4), ("mid.b.com", 200, 80), ("new.a.com", 1, 1), ("new.b.com", 1, 1)):
        for k in range(n):
            rows.append((len(rows), f"http://{host}/x"))
            good.append((len(good), k < s))
    pages, outcomes = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(good, "page_id long, good boolean")
    bound = {r["host"]: 1 - r["below"] for r in u.host_reputation(pages, outcomes).collect()}
    assert bound["good.a.com"] > 0.9 > bound["new.a.com"] > bound["new.b.com"] > bound["bad.b.com"] and bound["bad.b.com"] < 0.1
    alike = u.host_reputation(pages.where("url not like '%mid%'"), outcomes).collect()  # hosts that don't differ share a reputation
    assert {r["host"]: 1 - r["below"] for r in alike}["new.a.com"] > 0.95
    verdict = {r["host"]: r["verdict"] for r in u.url_verdicts(pages, outcomes).select(F.col("host"), "verdict").distinct().collect()}
    assert (verdict["good.a.com"], verdict["bad.b.com"]) == ("allow", "block")


def test_cutting_is_linear_in_the_text(spark):
    item = "z1 z2 z3 z4 z5 z6 z7 z8"
    text = " ".join(f"w{i}" if i % 40 else item for i in range(200_000))
    docs = spark.createDataFrame([(1, text, "a", "b", "c")], DOCS)
    began = time.time()
    out = d.decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).first()["text"]
    assert out.split() == [f"w{i}" for i in range(200_000) if i % 40] and time.time() - began < 60


def test_posterior_probabilities_equal_an_integral(spark):
    """The incomplete beta function against the trapezoid rule on the density, and against known quantiles."""
    cases = [(9.9, 1.1), (10.9, 1.1), (14.0, 2.0), (0.4, 0.3), (1.0, 1.0), (700.0, 290.0), (3.0, 4000.0), (30000.0, 12000.0), (20.0, 9.0)]
    got = spark.createDataFrame(cases, "a double, b double").select("a", "b", u.share_below(F.col("a"), F.col("b"), 0.7).alias("p")).collect()
    for r in got:
        a, b = r["a"], r["b"]
        x = np.linspace(0, 0.7, 2_000_001)[1:] if a >= 1 else np.linspace(0, 0.7**a, 2_000_001)[1:] ** (1 / a)
        log = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
        want = np.trapezoid(np.exp(log), x) if a >= 1 else np.trapezoid(np.exp(log - (a - 1) * np.log(x)) / a, x**a)
        assert abs(r["p"] - want) < (5e-4 if a + b > u.MANY else 1e-5), (a, b, r["p"], want)
    assert got[0]["p"] < 0.05 and got[1]["p"] < 0.05  # their lower 5 % quantiles are 0.726 and 0.747


def test_domains_and_suffixes(spark):
    hosts = {"a.b.co.uk": ("b.co.uk", "co.uk"), "x.example.com:8080": ("example.com", "com"), "10.0.0.1:80": ("10.0.0.1", "address"), "[::1]": ("[::1]", "address"), "localhost": ("localhost", "localhost"), "co.uk": ("co.uk", "co.uk"), "": ("", "")}
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", u.domain_of(F.col("h")).alias("d"), u.suffix_of(F.col("h")).alias("s")).collect()
    assert {r["h"]: (r["d"], r["s"]) for r in got} == hosts

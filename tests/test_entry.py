"""The driver's contract: registered queries hold against SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TEXT = {"pipeline"} | {f"op{i}_" for i in range(1, 11)}
NAMES = [n for n in entry.queries() if not any(n.startswith(t) for t in TEXT)]
EXPENSIVE = {"term_counts", "tfidf_dictionary", "cart_depth3_nodes", "cart_rmse"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("lineitem", "orders", "part", "customer", "documents", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([round(v[i], 8) if isinstance(v[i], float) else v[i] for i in order] for v in values), key=str)


def test_every_query_has_sql():
    assert set(NAMES) == {n for n in entry.oracle_sql() if n in NAMES}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in NAMES if n not in EXPENSIVE])
def test_query_equals_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    want = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())

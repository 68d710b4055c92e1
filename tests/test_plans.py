"""Every registered query against its SQL in DuckDB, and the entry point's contract."""

import decimal
import math

import duckdb
import pytest

from adagium.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return f"{round(float(v), 5) + 0.0:.5f}" if math.isfinite(float(v)) else "None"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    want = duck.execute(catalog.ORACLES[name])
    cols = sorted(df.columns)
    at = {c[0]: i for i, c in enumerate(want.description)}
    assert sorted(at) == cols
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    assert got == sorted(tuple(plain(r[at[c]]) for c in cols) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_whole_table_neighbours(spark, sf):
    """Every row but the query itself is a reference, by brute force."""
    import numpy as np

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        sim = v @ v[q]
        sim[q] = -np.inf
        want |= {(int(ids[q]), int(ids[r])) for r in np.lexsort((ids, -sim))[:15]}
    got = {(r["q"], r["ref"]) for r in catalog.QUERIES["knn_top15"](spark, sf).collect()}
    assert got == want and any(r % 5 == 0 for _, r in got)


def changed_documents(spark, sf, to, texts):
    """The tables with documents of the given texts; a connection that reads them."""
    con = duckdb.connect()
    for t in TABLES:
        if t != "documents":
            (to / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    rows = [(i, x, "en", "web", len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{to}/{t}.parquet{'/*.parquet' if t == 'documents' else ''}')")
    return con


def assert_equals_sql(spark, con, to, name):
    want = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in want.description]
    got = sorted(tuple(plain(r[c]) for c in cols) for r in catalog.QUERIES[name](spark, str(to)).collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["mock_labels", "model_replies"])
def test_empty_texts_equal_sql(spark, sf, tmp_path, name):
    con = changed_documents(spark, sf, tmp_path, [None, "", " ", "must", "\r\n", "a\u0308", "\U0001f600"])
    assert_equals_sql(spark, con, tmp_path, name)


@pytest.mark.parametrize("name", ["rule_features_v1", "rule_features_v2", "rule_score"])
def test_rules_on_odd_texts_equal_sql(spark, sf, tmp_path, name):
    texts = ["better x\rthan y", "\u00e9t\u00e9 not, hiver not", "\u00e9never good", None, "", "a, b", "a; bad loss", "Keep it?", "one then good\u00e9 gain", "Don\u2019t go"]
    assert_equals_sql(spark, changed_documents(spark, sf, tmp_path, texts), tmp_path, name)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

"""Driver contract and a sample of Spark-vs-DuckDB checks on sf0.001."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as ent

SF = "/root/testdata/sf0.001"
TABLES = ("documents labels embeddings").split()
SAMPLE = ["correct_text", "top_ngrams_by_label", "term_frequency_by_label_weighted", "bigrams_filtered",
          "sample_reviews", "central_reviews", "silhouette_samples", "merge_clusters", "lloyd_fixed_init",
          "adjusted_mutual_info", "language_flag", "wordcloud_weights_by_label"]


def _norm(v):
    if isinstance(v, float):
        return 0.0 if round(v, 6) == 0 else round(v, 6)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def test_entry_runs(spark):
    df = ent.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["label", "term", "frequency", "rank"]


def test_every_sql_key_is_a_query():
    assert set(ent.oracle_sql()) <= set(ent.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, duck, name):
    df = ent.queries()[name](spark, SF)
    s, scols = _rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(ent.oracle_sql()[name])
    d, dcols = _rows([c[0] for c in res.description], res.fetchall())
    assert scols == dcols
    assert s == d

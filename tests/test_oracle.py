"""Every registered query against its SQL counterpart, and against itself on other partitionings."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from narrascope.catalog import oracle, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# The library's own queries; a subpackage that registers more has its own tests.
QUERIES = queries.all_queries()
ORACLE = oracle.all_sql()
# Results that hold for any correct run but are not expressible in SQL.
ROWS_ONLY = {
    "embed_encoder", "kmeans_by_group", "lda_assign", "lda_topics", "local_map", "pca_by_group",
    "pca_coords", "pca_variance",
}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


@pytest.mark.parametrize("parts", [1, 13])
@pytest.mark.parametrize(
    "name",
    [
        "symbol_summary", "symbol_counts", "hybrid_score", "extreme_reports", "vocabulary",
        "topic_keywords", "topic_summary", "feature_hash", "covariance", "cluster_sizes",
        "axis_extremes", "intruder_rounds", "accuracy", "sample_n", "median_split",
        "scatter_sample", "symbol_dedupe", "annotated_points",
    ],
)
def test_partitions_do_not_matter(spark, duck, sf_dir, monkeypatch, name, parts):
    """Inputs in another order and in 1 or 13 partitions give the same result."""
    plain_table = queries.table

    def shuffled(session, folder, table):
        return plain_table(session, folder, table).orderBy(F.rand(parts)).repartition(parts)

    monkeypatch.setattr(queries, "table", shuffled)
    df = QUERIES[name](spark, sf_dir)
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_inventory_is_complete():
    assert set(QUERIES) == set(ORACLE) | ROWS_ONLY and not set(ORACLE) & ROWS_ONLY


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0

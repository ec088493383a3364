import importlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from narrascope.llm import decontaminate, jaccard, pii, quality_rules
from narrascope.llm.oracle import SQL

TABLES = "documents pages benchmark labels conversations embeddings".split()


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, want = entry_points.queries()[name](spark, sf_dir), con.execute(SQL[name])
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), [c[0] for c in want.description])


def test_stages(spark, sf_dir, tmp_path):
    """Every stage alone: columns, and decisions by the operators' own reports on its input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        given[name] = docs
        if name != "packing":
            after = spark.read.parquet(f"{tmp_path}/{name}")
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
            docs = after
    left = lambda name: {r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/{name}").select("doc_id").collect()}
    judged = quality_rules.verdicts(given["quality_rules"], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert left("quality_rules") == {r["doc_id"] for r in judged.where("kept").collect()}
    groups = jaccard.near_duplicates(given["near_duplicates"], width=5, percent=80)
    assert left("near_duplicates") == {r["component_id"] for r in groups.collect()}
    hit = decontaminate.contamination(given["decontamination"], spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert left("decontamination") == {r["doc_id"] for r in hit.where("not contaminated").collect()}
    assert left("pii") == left("decontamination") == left("packing")
    assert pii.find(docs).where(F.size("base") > 0).count() == 0
    pieces = spark.read.parquet(f"{tmp_path}/packing")
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n < 1024").count() <= 1


def test_registry():
    names = set(entry_points.queries())
    numbers = {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()}
    assert numbers == set(range(1, 14)) and "pipeline" in names
    assert importlib.import_module("corpus_pipeline").ORACLE_SQL is None

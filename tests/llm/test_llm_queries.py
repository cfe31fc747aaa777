"""The registered queries, their SQL and the pipeline."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from toxscan.llm.oracle import ORACLE_SQL
from toxscan.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(k.split("_")[0][2:]) for k in QUERIES) == list(range(1, 14))
    assert ORACLE_SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF001, t)}.parquet')")
    out = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in out.description]
    want = sorted(map(tuple, out.fetchall()))
    got = QUERIES[name](spark, SF001)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == want


def test_pipeline_stages(spark):
    from test_corpus_ops import _components, _exact, _fingerprint

    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (-5, "", "en", "s", 0)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    start = docs.unionByName(extra)
    kept = stages["exact_dedup"](spark, start, SF001)
    rows = [(r.doc_id, r.text) for r in start.collect()]
    want = {k for _, k, _, _ in _exact(rows)}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    near = stages["near_dedup"](spark, docs, SF001)
    groups = _components({i: _fingerprint(t) for i, t in rows if i is not None and i >= 0}, 4)
    assert {r.doc_id for r in near.collect()} == set(groups.values()) and near.columns == docs.columns
    items = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    clean = stages["decontamination"](spark, start, SF001)
    assert clean.columns == docs.columns and not any(i in (r.text or "") for r in clean.collect() for i in items)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, start.limit(0), SF001)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_pipeline_runs_end_to_end(spark):
    out = corpus_pipeline.run(spark, SF001)
    assert out.agg(F.countDistinct("doc_id")).first()[0] > 100
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.filter("n > 2048").count() == 0

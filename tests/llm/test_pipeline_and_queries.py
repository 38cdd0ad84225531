"""The pipeline against the operators' brute force, and the queries against their SQL."""

import re

import pytest

import corpus_pipeline
from tests.oracle import compare, connect
from ticklattice.llm.queries import ORACLES, QUERIES

from .test_operators import brute_components, brute_contamination

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows_equal_sql(spark, name):
    ok, message = compare(spark, connect(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, message


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_every_query_gives_rows(spark, name):
    table = "pages" if re.match("op[46]_", name) else "documents"
    rows = QUERIES[name](spark, SF)
    assert rows.select(rows.columns[0]).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    rows = {r.doc_id: r.text for r in first.collect()}
    kept = {}
    for i in sorted(rows):
        kept[rows[i]] = i
    left = {i: rows[i] for i in kept.values()}
    left = {i: left[i] for i, (_, c) in brute_components(list(left.items()), 5, 80).items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in brute_contamination(list(left.items()), items, 10) if not hit}
    out = corpus_pipeline.run(spark, SF)
    got = out.collect()
    assert {r.doc_id for r in got} == clean and all(r.text == rows[r.doc_id] and r.decodes_back for r in got)
    assert out.columns[: len(docs.columns)] == docs.columns


def test_each_stage_bears_odd_rows(spark, make_docs, odd_rows, tmp_path):
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    for rows in (odd_rows, []):
        docs = make_docs(rows, extra=("_id", "_digest", "_sha", "c", "n", "gone_id", "kept_id", "token", "doc_id_"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns[: len(docs.columns)] == docs.columns, name
            docs = out.select(docs.columns)
        assert (docs.count() > 0) == bool(rows)


def test_token_ids_are_made_from_small_batches(spark, make_docs):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "10000")
        docs = corpus_pipeline.token_ids(spark, make_docs([(i, "a b") for i in range(2000)]).coalesce(1), "")
        rows = docs.mapInArrow(lambda batches: (b.slice(0, 1).select(["doc_id"]) for b in batches), "doc_id long")
        assert rows.count() >= 4 and int(spark.conf.get(name)) <= 512
        spark.conf.set(name, "100")
        corpus_pipeline.token_ids(spark, docs, "")
        assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)

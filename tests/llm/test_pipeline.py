"""The pipeline's stages on the smallest table, each against what it must have done."""

import duckdb
import pytest

import corpus_pipeline
from psephos.llm import queries
from psephos.llm._shared import durable


@pytest.fixture(scope="module")
def results(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(durable(stage(spark, out[-1], sf_dir), "stage"))
    return out


def test_stages_keep_the_columns(results):
    assert len(corpus_pipeline.STAGES) == 5
    for r in results[:-1]:
        assert r.columns == corpus_pipeline.COLUMNS


def test_rows_only_go(results):
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in results]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[-1]) > 0.5 * len(ids[0])


def test_no_item_is_left_whole(spark, results, sf_dir):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(i in (t.text or "") for t in results[4].collect() for i in items)


def test_last_stage_covers_all(results):
    assert {r.doc_id for r in results[5].select("doc_id").collect()} == {r.doc_id for r in results[4].select("doc_id").collect()}


def test_line_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = {tuple(r) for r in con.sql(queries.ORACLES["op3_line_dedup"]).project("doc_id, n_lines, n_dropped, kept_sha256").fetchall()}
    got = {tuple(r) for r in queries.QUERIES["op3_line_dedup"](spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()}
    assert got == want


def test_all_queries_are_registered():
    assert [int(k[2:].split("_")[0]) for k in queries.QUERIES] == list(range(1, 14))

"""Every operator and stage over nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""
import pytest

import corpus_pipeline
from marketlens.llm.queries import QUERIES

ONE_ROW_EACH = [q for q in QUERIES if q.split("_")[0] not in ("op3", "op11", "op12")]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_table_gives_no_rows(spark, edge_dir, name):
    assert QUERIES[name](spark, f"{edge_dir}/empty").count() == 0


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_per_row(spark, edge_dir, edge_rows, name):
    got = QUERIES[name](spark, f"{edge_dir}/full").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in edge_rows)
    twins = [r for r in got if r.doc_id == 9]
    assert twins[0] == twins[1]  # repeated rows say the same


def test_packing_holds_every_id_once(spark, edge_dir, edge_rows):
    rows = QUERIES["op3_packing"](spark, f"{edge_dir}/full").collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == 1  # a null text is its end alone
    assert {r.doc_id for r in rows} == {i for i, _ in edge_rows}
    for r in (x for x in rows if x.doc_id not in (9, None)):
        assert sum(x.length for x in rows if x.doc_id == r.doc_id) == r.doc_tokens


@pytest.mark.parametrize("size", ["full", "empty"])
def test_stages_keep_columns(spark, edge_dir, size):
    docs = spark.read.parquet(f"{edge_dir}/{size}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, edge_dir)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) <= docs.count()
        if name in ("repeated_passages", "personal_data"):
            assert sum(r.text is None for r in rows) == docs.filter("text is null").count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, edge_dir)
    assert (last.count() > 0) == (size == "full")


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/full/documents.parquet")
    ids = [r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, edge_dir).collect()]
    assert ids.count(8) == 1 and 9 not in ids and ids.count(None) == 2

"""Registered corpus queries against their SQL, and the pipeline against its parts."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gigmesh.llm import queries

from .conftest import SF_DIR


@pytest.fixture(scope="module")
def con():
    import check

    return check.database(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, con, name):
    import check

    got = queries.QUERIES[name](spark, SF_DIR).toPandas()
    want = con.execute(queries.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.canon(got) == check.canon(want)


def test_all_are_registered():
    assert [k for k in entry.queries() if k.startswith("op")] == list(queries.QUERIES)
    assert len(queries.QUERIES) == 10 and "pipeline" in entry.queries()


def test_pipeline_runs_its_stages(spark):
    out = {r.doc_id: r for r in entry.queries()["pipeline"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "jaccard_join", "chunk_dedup", "decontaminate", "byte_bpe"]
    step, seen = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, SF_DIR).cache()
        assert step.columns == docs.columns
        seen.append({r.doc_id for r in step.select("doc_id").collect()})
    assert all(b <= a for a, b in zip(seen, seen[1:], strict=False))
    assert out.keys() == seen[-1] and 0 < len(out) < docs.count()
    quality = {r.doc_id for r in queries.QUERIES["op2_quality_rules"](spark, SF_DIR).where("kept").collect()}
    assert seen[0] == quality
    from gigmesh.llm import decontaminate

    left = decontaminate.contamination(step, spark.read.parquet(f"{SF_DIR}/benchmark.parquet"))
    assert left.where("n_hit > 0").count() <= 1  # words that meet after a cut

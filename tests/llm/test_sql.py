"""The corpus queries against their SQL, and the pipeline against brute force."""

import brute
import pytest
from oracle import duck, same

import corpus_pipeline
from strandflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, SF).toPandas(), duck(queries.SQL[name], SF))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        rows = [(r.doc_id, r.text) for r in kept.collect()]
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        got = {r.doc_id: r.text for r in kept.collect()}
        if name == "quality rules":
            assert set(got) <= {d for d, t in rows if not brute.quality(t)[5]} and len(got) > 0.5 * len(rows)
        elif name == "line dedup":
            assert {(d, brute.sha(t)) for d, t in got.items()} == {(d, k) for d, _, _, k in brute.line_dedup(rows)}
        else:
            assert set(got) == {d for d, _, _, k in brute.near_dedup(rows) if k}
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} <= set(got)

import os

import pytest

import corpus_pipeline as P

from .conftest import ODD

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "repeats", "decontamination", "packing"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = spark.createDataFrame(out.toPandas(), docs.schema)
        assert 0 < kept.count() <= docs.count()
        docs = kept
    packed = P.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [r for r in docs.collect() if any(t in r.text for t in items)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, make, rows):
    docs = make(rows)
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == make([]).columns, name
        docs = spark.createDataFrame([tuple(r) for r in docs.collect()], make([]).schema)
    assert P.pack_sequences(spark, docs, SF).count() >= 0

"""Registered queries on the smallest tables, against SQL or the rule itself."""

import collections
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sedimenta.llm import near, queries
from sedimenta.llm.common import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables absent")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for x in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {x} AS SELECT * FROM '{DATA}/{x}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    result = con.execute(queries.ORACLES[name])
    shown = [c[0] for c in result.description]
    assert sorted(shown) == sorted(df.columns)
    order = [shown.index(c) for c in df.columns]
    want = collections.Counter(tuple(row[i] for i in order) for row in result.fetchall())
    assert collections.Counter(map(tuple, df.collect())) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_rows(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    source = "pages" if name.startswith("op10") else "documents"
    if not name.startswith("op7"):
        assert df.count() == table(spark, DATA, source).count()


def test_pipeline(spark):
    docs = table(spark, DATA, "documents").cache()
    for at, (_, step) in enumerate(corpus_pipeline.STAGES):
        kept = step(spark, docs, DATA).cache()
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids and ids <= {r.doc_id for r in docs.select("doc_id").collect()}
        if at < 4:
            assert kept.schema.names == docs.schema.names and kept.where(F.char_length("text") != F.col("n_chars")).isEmpty()
        if at == 2:
            sets = [near.shingles(r.text, 5) for r in kept.collect()]
            assert not any(
                100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k] if a and b
            )
        if at == 3:
            bench = table(spark, DATA, "benchmark")
            from sedimenta.llm.decontaminate import contamination

            assert contamination(kept, bench).where("size(spans) > 0").isEmpty()
        docs = kept
    assert docs.columns == ["doc_id", "n_pieces", "piece_ids", "text"]

"""The stages on the smallest tables, each held to its rule on its own input."""

import pathlib
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickerloom.llm import packing, quality, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="test tables absent")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if number + 1 < len(corpus_pipeline.STAGES):
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(number)))
        held[name] = (docs, spark.read.parquet(str(tmp_path / str(number))))
        docs = held[name][1]

    before, after = held["quality rules"]
    kept = {r.doc_id for r in quality.measure(before).filter("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept and len(kept) > 0.7 * before.count()

    before, after = held["toxicity"]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("toxic = 0")
    clean = before.join(labels, "doc_id").count()
    assert after.join(labels, "doc_id").count() == clean

    before, after = held["line dedup"]
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert r.n_chars == len(r.text) and set(r.text.split("\n")) <= set(texts[r.doc_id].split("\n"))

    before, after = held["n-gram Jaccard join"]
    folded = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t).strip().lower()
    assert {folded(r.text) for r in before.collect()} >= {folded(r.text) for r in after.collect()}
    assert len({folded(r.text) for r in after.collect()}) == after.count()

    before, after = held["packing"]
    assert after.agg(F.countDistinct("doc_id")).first()[0] == before.count()
    assert after.agg(F.sum("length")).first()[0] == packing.pack(before).agg(F.sum("length")).first()[0]
    assert corpus_pipeline.run(spark, FOLDER).count() == after.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_queries_run(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER)
    table = "pages" if name.startswith("op9") else "documents"
    n = rows.count()
    if re.match(r"op(1|4|5|7|8|9|10)_", name):
        assert n == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
    assert n > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in found.description]
    rows = queries.QUERIES[name](spark, FOLDER)
    assert sorted(rows.columns) == sorted(columns)
    assert sorted((tuple(r) for r in rows.select(*columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)

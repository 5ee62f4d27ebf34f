import os

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as f

import corpus_pipeline as cp
from gridreach.llm import decontam, queries
from gridreach.session import BATCH_BYTES, cut

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "near_duplicates", "decontamination", "secret_scan", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in cp.STAGES:
        seen.append(cut(stage(spark, seen[-1], SF)))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(d.columns == docs.columns for d in seen[:-1])
    assert ids[0] >= ids[1] > ids[2] >= ids[3] == ids[4] == ids[5]
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(bad & ids[1]) <= 0.2 * len(bad) and len(good & ids[1]) >= 0.95 * len(good & ids[0])
    kept = seen[4].collect()
    assert not any("AKIA" in r.text for r in kept) and all(r.n_chars == len(r.text) for r in kept)
    words = {r.doc_id: len(r.text.encode().split()) + 1 for r in kept}
    packed = {}
    for r in seen[5].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.n_tokens
    assert packed == words


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = cut(stage(spark, docs, SF))
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_stages_with_odd_rows(spark):
    """Null ids and texts, empty texts, repeated rows and columns whose names the stages use themselves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(50)
    names = ["_bad", "_gone", "_hit", "_id", "_own", "component_id", "spans"]
    schema = docs.schema
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a text without an id", "xx", "s", 20), (9001, None, "xx", None, 0), (9002, "", None, "s", None), (9003, "twice the same row", "xx", "s", 18), (9003, "twice the same row", "xx", "s", 18)], schema)
    seen = [cut(docs.unionByName(odd).select("*", *[f.lit(i).alias(n) for i, n in enumerate(names)]))]
    for _, stage in cp.STAGES:
        seen.append(cut(stage(spark, seen[-1], SF)))
    assert all(d.columns == seen[0].columns for d in seen[:-1])
    assert all(d.where(" or ".join(f"{n} <> {i}" for i, n in enumerate(names))).isEmpty() for d in seen[:-1])
    rows = [[r.doc_id for r in d.collect()] for d in seen]
    assert rows[1].count(None) == 2 and rows[2].count(None) == 2 and rows[3].count(None) == rows[4].count(None) == 2
    assert rows[2].count(9003) <= 1 and sorted(map(str, rows[3])) == sorted(map(str, rows[4]))
    assert {str(r) for r in rows[5]} == {str(r) for r in rows[4]}


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES[:4]])
def test_python_workers_get_bounded_batches(spark, name):
    """Long texts reach Python in batches of bounded bytes, not 10,000 at once; all of them arrive."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    dict(cp.STAGES)[name](spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF)

    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "size"])

    long_texts = spark.range(0, 4000, 1, 1).select("id", f.repeat(f.lit("word "), 1000).alias("text"))
    n, most = long_texts.mapInArrow(size, "n long, size long").agg(f.sum("n"), f.max("size")).first()
    assert n == 4000 and most <= 1.1 * BATCH_BYTES


def test_decontamination_starts_no_worker_for_an_empty_table(spark):
    rows = lambda texts, key: spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string").coalesce(1)
    docs, items = cut(rows(["one two three four five", None, "six"], "doc_id")), cut(rows(["two three four"], "item_id"))
    found = decontam.overlaps(docs, items)
    assert "ExistingRDD" not in found._jdf.queryExecution().toString()
    assert [r.doc_id for r in found.collect()] == [0]
    none = decontam.overlaps(docs, items.limit(0))
    assert none.dtypes == found.dtypes and none.count() == 0

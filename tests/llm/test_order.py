import os

import numpy as np
import pytest

from gridreach.llm import order as o
from gridreach.session import scratch


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation_is_a_bijection_for_every_key(n):
    a, b = o.permute(np.arange(n), n, 1), o.permute(np.arange(n), n, 2)
    assert sorted(a.tolist()) == list(range(n)) == sorted(b.tolist())
    assert n < 10 or (a != b).any()
    assert (o.permute(np.arange(n)[n // 2 :], n, 1) == a[n // 2 :]).all()


WIDTHS = [o.BYTES, o.Ids(2, 0, 1, lambda t: np.frombuffer(t, np.uint8).astype("<u2") + np.uint16(o.FIRST))]


@pytest.mark.parametrize("ids", WIDTHS)
def test_round_trip_and_resume(spark, ids):
    rows = [(1, "short"), (2, "x" * 5000), (3, None), (4, ""), (1, "short"), (None, "é" * 700)] + [(10 + i, f"text {i} " * (i % 400)) for i in range(2600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS slot", "'b' AS shard")
    path = scratch(spark, "t")
    n = o.materialise(df, path, 9, ids)
    got = sorted(o.read_from(spark, path).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(n)) and n > o.SHARD
    assert all(r.shard == r.slot // o.SHARD and len(r.ids) == ids.stride and r.width == ids.width for r in got)
    back = {}
    for r in got:
        own = np.frombuffer(r.ids, ids.kind)
        assert (own[r.n_tokens :] == ids.pad).all()
        back.setdefault(r.doc_id, {}).setdefault(r.piece, []).append(own[: r.n_tokens])
    for doc, text in rows:
        for k in range(len(back[doc][0])):
            own = np.concatenate([back[doc][p][k] for p in sorted(back[doc])])
            assert own[-1] == ids.end and bytes((own[:-1] - (o.FIRST if ids.width == 2 else 0)).astype(np.uint8)) == (text or "").encode()
    assert len(back[1][0]) == 2
    part = spark.read.parquet(f"{path}/shard=0").collect()
    assert [r.slot for r in part] == list(range(o.SHARD))  # in order within the file
    assert sorted(r.slot for r in o.read_from(spark, path, n - 7).collect()) == list(range(n - 7, n))


def test_query_shape_and_empty(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "d")], "doc_id long, text string")
    got = {r.doc_id: r for r in o.training_order(df).collect()}
    assert {r.slot for r in got.values()} == {0, 1} and got[1].n_tokens == 4 and got[1].byte_offset == got[1].slot * o.BYTES.stride
    assert o.training_order(df.limit(0)).count() == 0


@pytest.mark.parametrize("ids", WIDTHS)
def test_byte_offset_is_where_the_ids_are(spark, ids):
    rows = [(i, f"text {i} " * (i % 300)) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = scratch(spark, "t")
    n = o.materialise(df, path, 9, ids)
    at = lambda s: o.shard_file(path, s).removeprefix("file:")
    assert n > o.SHARD and [os.path.getsize(at(s)) for s in range(-(-n // o.SHARD))] == [min(o.SHARD, n - s * o.SHARD) * ids.stride for s in range(-(-n // o.SHARD))]
    assert all(x.endswith(".bin") for x in os.listdir(os.path.dirname(at(0))) if not x.endswith(".crc"))  # no temporary file stays
    texts, offsets = dict(rows), {r.slot: r.byte_offset for r in o.training_order(df, 9, ids).select("slot", "byte_offset").collect()}
    for r in spark.read.parquet(path).collect():
        with open(at(r.shard), "rb") as f:
            f.seek(offsets[r.slot])
            got = f.read(ids.stride)
        assert got == o.sequences(texts[r.doc_id].encode(), ids)[r.piece][1]


def test_shards_that_the_driver_does_not_see_are_an_error(spark, monkeypatch):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    other = scratch(spark, "elsewhere")
    monkeypatch.setattr(o, "_files", lambda path, f=o._files: f(other))
    path = scratch(spark, "t")
    with pytest.raises(RuntimeError, match="0 of 1 shards"):
        o.materialise(df, f"{path}", 9)

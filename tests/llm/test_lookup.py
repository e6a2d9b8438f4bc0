"""Keyed access to stored ids: routes, files that are opened, plans."""

import numpy as np

from rowferry.llm import idstore, queries
from rowferry.scratch import scratch_path


def _store(spark, keys, block_ids=40):
    docs = spark.createDataFrame([(k, f"text of number {k} " * (1 + abs(k) % 5)) for k in keys], "doc_id long, text string")
    path = scratch_path(spark, "t")
    old, idstore.SHARD_BYTES = idstore.SHARD_BYTES, 2000
    try:
        idstore.write_ids(docs, path, queries.WORD_BPE, block_ids=block_ids)
    finally:
        idstore.SHARD_BYTES = old
    idstore.write_index(spark, path)
    return path


def _found(spark, path, asked):
    frame = spark.createDataFrame([(k,) for k in asked], "doc_id long")
    got = {}
    for r in idstore.lookup(spark, path, frame).collect():
        got.setdefault(r.doc_id, []).append(bytes(r.ids))
    return got


def test_every_stored_key_is_found_and_no_other(spark, monkeypatch):
    rng = np.random.default_rng(3)
    keys = [int(k) for k in rng.integers(-500, 500, 300)] + [77] * 120  # one key over several blocks
    path = _store(spark, keys)
    want = {}
    for r in idstore.read_shards(spark, path).collect():
        want.setdefault(r.doc_id, []).append(bytes(r.ids))
    asked = [*range(-520, 520), 77, 77, None, 1 << 60]
    for shares, named in ((100_000, 1000), (7, 1000), (100_000, 2)):
        monkeypatch.setattr(idstore, "ASKED", shares)
        monkeypatch.setattr(idstore, "NAMED_FILES", named)
        got = _found(spark, path, asked)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert _found(spark, path, [10_000]) == {} and _found(spark, path, []) == {}


def test_a_key_opens_one_file(spark):
    path = _store(spark, list(range(200)))
    frame = spark.createDataFrame([(101,)], "doc_id long")
    found = idstore.lookup(spark, path, frame)
    assert [r.doc_id for r in found.collect()] == [101]
    read = [f for f in found.inputFiles() if "/part-" in f and "routed" not in f and path.rsplit("/", 1)[-1] in f]
    shards = idstore.block_sizes(spark, path).select("shard").distinct().count()
    assert len(read) == 1 < shards


def test_no_nested_loops(spark):
    path = _store(spark, list(range(100)))
    plan = idstore.lookup(spark, path, spark.range(50).withColumnRenamed("id", "doc_id"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    index = spark.read.schema(idstore.INDEX).parquet(f"{path}/_index")
    plan = idstore.routes(index, spark.range(50).toDF("key"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

"""Scratch folders, and types by the first records."""

import os
from types import SimpleNamespace

import pytest

from rowferry import ConfigError
from rowferry.functions.sniff import infer_types
from rowferry.scratch import clean, materialize, scratch_root
from rowferry.sources.tables import file_preview


def session_of(master, **conf):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=context)


def test_a_cluster_needs_a_shared_folder():
    warehouse = {"spark.sql.warehouse.dir": "file:/w/"}
    assert scratch_root(session_of("local[4]", **warehouse)) == scratch_root(session_of("local", **warehouse)) == "file:/w"
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ConfigError):
            scratch_root(session_of(master, **warehouse))
        assert scratch_root(session_of(master, **{"spark.checkpoint.dir": "hdfs:///s"}, **warehouse)) == "hdfs:///s"


def test_scratch_can_be_cleaned(spark, folder, monkeypatch):
    from rowferry import scratch

    monkeypatch.setattr(scratch, "scratch_root", lambda _: folder)
    materialize(spark.range(3), "a")
    assert clean(spark, least_age_s=3600) == 0 and os.listdir(f"{folder}/rowferry")
    assert clean(spark) == 1 and not os.listdir(f"{folder}/rowferry")


def test_first_records_of_many_files_name_the_types(spark, folder):
    os.mkdir(f"{folder}/csv")
    for i in range(4):
        with open(f"{folder}/csv/{i}.csv", "w", encoding="utf-16") as f:
            f.write("n,at\n" + "".join(f"{k if i == 0 else 'x'},2026-01-02\n" for k in range(30)))
    found = file_preview(spark, f"{folder}/csv", rows=30)
    assert [tuple(r) for r in found.columns.collect()] == [(0, "n", "integer"), (1, "at", "date")]
    assert found.encoding == "UTF-16" and found.total_rows == 120
    assert [r.n.text for r in found.rows.collect()] == [str(k) for k in range(30)] and found.rows.first().n.kind == "integer"
    assert file_preview(spark, f"{folder}/csv", rows=2, typed=False, count=False).rows.first().n == "0"
    assert [r.inferred_type for r in file_preview(spark, f"{folder}/csv", rows=31).columns.collect()] == ["text", "date"]
    with pytest.raises(ConfigError):
        infer_types(spark.range(3), sample=2)

"""CSV reading, headers, encodings, previews, catalog, source choice, export."""

import hashlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rowferry.errors import ConfigError, NotFoundError, SourceError
from rowferry.sources.files import (
    block_digests,
    changed_blocks,
    check_ending,
    combined_fingerprint,
    content_checksum,
    file_fingerprint,
    fold_digests,
    profile_lines,
    read_csv,
)
from rowferry.sources.sinks import append_rows, export_csv, publish_snapshot
from rowferry.sources.tables import (
    SourceSpec,
    describe_columns,
    jdbc_options,
    list_tables,
    preview,
    preview_columns,
    query_fingerprint,
    read_query,
    read_source,
    resolve_source,
    rows_to_json,
    source_preview,
)


def write(folder, name, text, encoding="utf-8"):
    path = f"{folder}/{name}"
    with open(path, "wb") as f:
        f.write(text.encode(encoding))
    return path


def raw(spark, path, **options):
    return [tuple(r) for r in read_csv(spark, path, typed=False, **options).collect()]


RAGGED = 'a,b,c\n1,"x, ""y""",\n\n2\n  \n3,4,5,6\n'


@pytest.mark.parametrize("python, encoding", [("utf-8", None), ("utf-16-le", "UTF-16LE"), ("utf-16", None)])
def test_ragged_quoted_and_blank_lines(spark, folder, python, encoding):
    """Surplus cells and lines of blanks stay, empty lines go; a byte-order mark is enough to know UTF-16."""
    path = write(folder, "a.csv", RAGGED, python)
    want = [("1", 'x, "y"', None, None), ("2", None, None, None), ("  ", None, None, None), ("3", "4", "5", "6")]
    assert raw(spark, path, encoding=encoding) == want
    df = read_csv(spark, path, encoding=encoding)
    assert df.columns == ["a", "b", "c", "欄位4"] and df.collect()[2] == (None,) * 4
    assert len(raw(spark, path, encoding=encoding, n_columns=6)[0]) == 6
    df = read_csv(spark, path, encoding=encoding, has_header=False, typed=False)
    assert df.columns == ["欄位1", "欄位2", "欄位3", "欄位4"] and df.count() == 5


@pytest.mark.parametrize("multi_line", [None, True, False])
def test_later_records_may_be_wider(spark, folder, multi_line):
    path = write(folder, "w.csv", 'a,b\n1,2\n3,4,"5,5",6\n   \n')
    assert raw(spark, path, multi_line=multi_line) == [
        ("1", "2", None, None), ("3", "4", "5,5", "6"), ("   ", None, None, None)]
    assert len(raw(spark, path, multi_line=multi_line, has_header=False)) == 4


def test_quoted_line_ends_are_found(spark, folder):
    whole = write(folder, "whole.csv", 'a,b\n1,"x"\n2,y\n')
    broken = write(folder, "broken.csv", 'a,b\n1,"x\ny"\n2,z\n3,"p\nq",r\n')
    assert profile_lines(spark, whole).first() == (True, False, 2)
    assert not profile_lines(spark, broken).first()["whole_records"]
    df = read_csv(spark, broken, typed=False, row_no="line")
    assert [tuple(r) for r in df.orderBy("line").collect()] == [
        (2, "1", "x\ny", None), (3, "2", "z", None), (4, "3", "p\nq", "r")]


@pytest.mark.parametrize("encoding, python", [("Big5", "big5"), ("GBK", "gbk"), ("UTF-16LE", "utf-16-le"), ("UTF-8", "utf-8")])
def test_encodings(spark, folder, encoding, python):
    path = write(folder, "e.csv", "港口,潮汐\n高雄,大潮\n", python)
    df = read_csv(spark, path, encoding=encoding)
    assert df.columns == ["港口", "潮汐"]
    assert df.first()["潮汐"]["text"] == "大潮"


def test_header_names(spark, folder):
    path = write(folder, "h.csv", "id,,42, name ,TRUE,id\n1,2,3,4,5,6\n")
    df = read_csv(spark, path, typed=False)
    # Of equal names the last column keeps it.
    assert df.columns == ["欄位1", "欄位2", "欄位3", "name", "欄位5", "id"]
    with pytest.raises(SourceError):
        check_ending("x.xlsx")
    with pytest.raises(SourceError):
        check_ending("x.pdf")
    check_ending("x.TSV")


def test_line_numbers_over_split_files(spark, folder):
    text = "k,v\n" + "".join(f"{i},{'x' * (i % 50)}\n" for i in range(20000))
    path = write(folder, "big.csv", text)
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = read_csv(spark, path, typed=False, row_no="line")
        wrong = df.where(F.col("line") != F.col("k").cast("bigint") + 2).count()
        assert (wrong, df.count()) == (0, 20000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)


def test_preview(spark, folder):
    path = write(folder, "p.csv", "n,d,t\n" + "1,2026/01/02,x\n2.50,2026-01-02 10:00,\n")
    df = read_csv(spark, path)
    assert [tuple(r) for r in preview(df, 1).collect()] == [("1", "2026-01-02", "x")]
    assert [(r["index"], r["name"], r["inferred_type"]) for r in preview_columns(df).collect()] == [
        (0, "n", "float"), (1, "d", "datetime"), (2, "t", "text")]
    assert source_preview(df, 1).total_rows == 2 and source_preview(df, 1).rows.count() == 1
    assert [r[0] for r in rows_to_json(df).collect()] == [
        '{"n":1,"d":"2026-01-02","t":"x"}', '{"n":2.5,"d":"2026-01-02 10:00:00","t":null}']


def test_fingerprints(spark, folder):
    path = write(folder, "f.csv", "a\n1\n")
    files = file_fingerprint(spark, path)
    assert combined_fingerprint(files) == hashlib.sha256(b"a\n1\n").hexdigest()
    assert query_fingerprint("c1", "select 1") == hashlib.sha256(b"c1\nselect 1").hexdigest()
    df = spark.range(100).toDF("x")
    assert content_checksum(df).first() == content_checksum(df.orderBy(F.desc("x"))).first()
    assert content_checksum(df).first() != content_checksum(df.where("x < 99")).first()
    forms = ["select null a, 'b' b", "select '' a, 'b' b", "select 'b' a, null b", "select 'b' a, '' b", "select x'00' a, 'b' b",
             "select x'01' a, 'b' b", "select array(1, 2) a, 'b' b", "select array(1, 3) a, 'b' b"]
    assert len({content_checksum(spark.sql(q)).first()["checksum"] for q in forms}) == len(forms)


def test_choice_of_source(spark, folder):
    path = write(folder, "s.csv", "a\n1\n")
    assert resolve_source(SourceSpec(path=path), SourceSpec(table="t")).path == path
    assert resolve_source(None, SourceSpec(query="select 1")).query == "select 1"
    assert resolve_source(SourceSpec(), None, "db.t").table == "db.t"
    for args in ((None, None), (SourceSpec(path=path, table="t"), None), (SourceSpec(table="t", query="q"), None),
                 (SourceSpec(), None)):
        with pytest.raises(ConfigError):
            resolve_source(*args)
    assert read_source(spark, SourceSpec(path=path)).first()["a"]["kind"] == "integer"
    assert read_query(spark, "select count(*) as n from {v}", {"v": spark.range(5)}).first()["n"] == 5
    with pytest.raises(NotFoundError):
        read_source(spark, SourceSpec(table="no_such_table"))


def test_jdbc_options():
    base = {"url": "jdbc:x"}
    plain = jdbc_options(base, "t", None, None, None, 8)
    assert plain["dbtable"] == "t" and "partitionColumn" not in plain
    split = jdbc_options(base, None, "select 1", "id", (1, 9), 8)
    assert split["dbtable"] == "(select 1) rowferry_source"
    assert (split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("1", "9", "8")
    with pytest.raises(ConfigError):
        jdbc_options(base, "t", "q", None, None, 8)


def test_catalog_and_table_sink(spark):
    spark.sql("create database if not exists ferry_db")
    spark.sql("drop table if exists ferry_db.items")
    spark.sql("create table ferry_db.items (name string, qty int, src string) using parquet")
    assert ("ferry_db", "items") in [(r["schema"].split(".")[-1], r["name"]) for r in list_tables(spark, "ferry_db").collect()]
    assert [(r["name"], r["native_type"], r["ordinal"]) for r in describe_columns(spark, "ferry_db.items").collect()] == [
        ("name", "string", 1), ("qty", "int", 2), ("src", "string", 3)]
    with pytest.raises(NotFoundError):
        describe_columns(spark, "ferry_db.nope")
    rows = spark.createDataFrame([(1, "A"), (2, "B")], "qty int, NAME string")
    append_rows(rows, "ferry_db.items")
    append_rows(rows.limit(1), "ferry_db.items")
    assert sorted(map(tuple, spark.table("ferry_db.items").collect())) == [("A", 1, None), ("A", 1, None), ("B", 2, None)]
    with pytest.raises(ConfigError):
        append_rows(rows.withColumnRenamed("qty", "zzz"), "ferry_db.items")


def test_publish_only_touched_partitions(spark, folder):
    path = f"{folder}/t"
    spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string").write.partitionBy("p").parquet(path)
    publish_snapshot(spark.createDataFrame([(9, "b")], "v int, p string"), path, ["p"], touched_only=True)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (9, "b")]
    with pytest.raises(ConfigError):
        publish_snapshot(spark.range(1), path, touched_only=True)


def test_export_round_trip(spark, folder):
    data = [(1, "a,\"b\"", datetime(2026, 1, 2, 3, 4, 5), date(2026, 1, 2), 1e7, True), (None, None, None, None, None, None)]
    df = spark.createDataFrame(data, "id bigint, name string, at timestamp_ntz, day date, x double, f boolean")
    export_csv(df.coalesce(1), f"{folder}/out")
    back = read_csv(spark, f"{folder}/out", typed=False)
    assert back.columns == df.columns
    assert tuple(back.first()) == ("1", 'a,"b"', "2026-01-02 03:04:05", "2026-01-02", "10000000", "true")


def python_records(text):
    import csv
    import io

    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


@pytest.mark.parametrize("seed", range(2))
def test_split_records_as_read_in_one_piece(spark, folder, seed):
    """Quoted line ends, doubled quotes, blanks and empty lines over many small blocks."""
    import random

    pick = random.Random(seed)
    cells = ["a", "b c", '"x,y"', '"line\nend"', '"two\n\nlines, ""quoted"""', '""', "", "  ", '"\n"', "end", "漢字", '"q""\n,""r"']
    ends = ["\n", "\n", "\n", "\r\n", "\n\n"]
    text = "h1,h2\n" + "".join(
        ",".join(pick.choice(cells) for _ in range(pick.randint(2, 4))) + pick.choice(ends) for _ in range(150))
    paths = [write(folder, f"{name}.csv", text) for name in ("a", "b")]
    # A quoted field that is alone and empty is a record; Python's reader agrees.
    want = [r for r in python_records(text)][1:]
    width = max(map(len, want))
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        df = read_csv(spark, folder, typed=False, row_no="line")
        got = [tuple(r) for r in df.orderBy("line").collect()]
        assert read_csv(spark, paths[0], typed=False).count() == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)
    assert [r[0] for r in got] == list(range(2, 2 + 2 * len(want)))
    shown = [tuple(c or None for c in r[1:]) for r in got]
    assert shown == [tuple((c or None) for c in r) + (None,) * (width - len(r)) for r in want * 2]


def test_one_big_quoted_file_is_read_by_many_tasks(spark, folder):
    text = "k,v\n" + "".join(f'{i},"{"x" * (i % 50)}\n{i}"\n' for i in range(20000))
    path = write(folder, "big.csv", text)
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        df = read_csv(spark, path, typed=False, row_no="line")
        wrong = df.where((F.col("line") != F.col("k").cast("bigint") + 2) | ~F.endswith("v", F.concat(F.lit("\n"), F.col("k"))))
        assert (wrong.count(), df.count()) == (0, 20000)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan text" in plan and "FileScan csv" not in plan
        from rowferry.sources.records import placed_lines

        assert placed_lines(spark, path).select("file", "block").distinct().count() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)


def test_a_quote_that_is_never_closed_is_named(spark, folder, monkeypatch):
    from rowferry.sources import records

    path = write(folder, "open.csv", 'a,b\n1,"x\n' + "row,row\n" * 100)
    assert read_csv(spark, path).count() == 1
    monkeypatch.setattr(records, "MOST_RECORD_BYTES", 100)
    with pytest.raises(SourceError, match="closed"):
        read_csv(spark, path)


def test_block_digests_of_files_of_any_size(spark, folder):
    """No limit on a file's size, the same digests however files are split, and only changed blocks are named."""
    import os

    os.mkdir(f"{folder}/in")
    lines = [f"line {i} " + "x" * (i % 40) for i in range(3000)]
    for name in ("a", "b"):
        write(f"{folder}/in", f"{name}.csv", "\n".join(lines) + "\n")
    conf = {"spark.sql.sources.binaryFile.maxLength": "100", "spark.sql.files.maxPartitionBytes": "9000"}
    first = block_digests(spark, f"{folder}/in", 100)
    first.write.parquet(f"{folder}/first")
    first = spark.read.parquet(f"{folder}/first")
    assert first.count() == 60 and first.agg(F.sum("n_lines")).first()[0] == 6000
    saved = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        with pytest.raises(SourceError):
            file_fingerprint(spark, f"{folder}/in")
        again = block_digests(spark, f"{folder}/in", 100)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
        assert changed_blocks(first, again).count() == 0
        digests = [r.sha256 for r in fold_digests(again).collect()]
        assert len(set(digests)) == 1 and len(digests) == 2
        lines[777] += "!"
        lines[10], lines[11] = lines[11], lines[10]
        write(f"{folder}/in", "b.csv", "\n".join([*lines, "more"]) + "\n")
        found = sorted((r.path.rsplit("/", 1)[-1], r.part) for r in changed_blocks(first, block_digests(spark, f"{folder}/in", 100)).collect())
        assert found == [("b.csv", 0), ("b.csv", 7), ("b.csv", 29), ("b.csv", 30)]  # 29 held the file's end
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

"""SHA-256 of files that no task reads whole."""

import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rowferry.errors import SourceError
from rowferry.sources import chained
from rowferry.sources.files import file_fingerprint


@pytest.fixture
def small_splits(spark):
    """Splits of 9000 bytes, and no file above 30,000 bytes is read in one go."""
    conf = {"spark.sql.sources.binaryFile.maxLength": "30000", "spark.sql.files.maxPartitionBytes": "9000"}
    saved = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in saved.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _written(folder, files):
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    return {name: hashlib.sha256(data).hexdigest() for name, data in files.items()}


def _found(frame):
    return {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in frame.collect()}


def test_files_above_the_limit_of_one_read_are_hashed_whole(spark, folder, small_splits, monkeypatch):
    bytes_ = random.Random(3).randbytes
    body, mark = bytes_(50_000), b"\xef\xbb\xbf"
    want = _written(folder, {
        "a b.bin": body, "end.bin": body + b"\n", "ends.bin": body + b"\n\n", "open.bin": body + b"x", "twin.bin": body,
        "mark.bin": mark + body + b"\n", "mark_open.bin": mark + body + b"x", "mark_line.bin": mark + b"\n" + body,
        "lines.bin": b"\n" * 40_000, "crlf.bin": b"ab\r\n" * 9_000 + b"\r", "p[1]{x}*.bin": bytes_(70_000),
        "exact.bin": bytes_(9_000), "small.bin": b"hi",
    })
    staged = []
    monkeypatch.setattr(chained, "materialize", lambda df, *a, real=chained.materialize: staged.append(real(df, *a)) or staged[-1])
    assert _found(file_fingerprint(spark, folder, piece=9000)) == want
    # No round of a file is more than its splits that start there, and a line.
    most = staged[0].groupBy("file", "round").agg(F.sum("n_bytes").alias("n")).agg(F.max("n"), F.countDistinct("file")).first()
    assert most[0] < 9000 + 9000 and most[1] == 11


def test_files_that_no_reader_splits_are_read_whole_or_refused(spark, folder, small_splits):
    packed = gzip.compress(random.Random(4).randbytes(20_000))
    want = _written(folder, {"x.csv.gz": packed, "long.bin": b"z" * 25_000, "long_in.bin": b"a\n" * 3_000 + b"z" * 12_000})
    assert _found(file_fingerprint(spark, folder, piece=9000, line=10_000)) == want
    want |= _written(folder, {"longer.bin": b"z" * 35_000})
    assert _found(file_fingerprint(spark, folder, piece=9000)) == want
    with pytest.raises(SourceError):
        file_fingerprint(spark, folder, piece=9000, line=10_000)
    _written(folder, {"y.csv.gz": packed * 2})
    with pytest.raises(SourceError):
        file_fingerprint(spark, folder, piece=9000)


def test_without_states_files_are_read_whole(spark, folder, monkeypatch):
    want = _written(folder, {"a.bin": random.Random(5).randbytes(20_000)})
    monkeypatch.setattr(chained, "_openssl", lambda: object())
    assert not chained.can_hand_on()
    assert _found(file_fingerprint(spark, folder, piece=9000)) == want


def test_a_state_goes_on_where_it_was(spark):
    import pyarrow as pa

    data = random.Random(6).randbytes(1_000)
    for at in (0, 1, 55, 56, 63, 64, 65, 500, 1_000):
        state = chained.extend(chained.begin(data[:at]), [pa.py_buffer(data[at:]), pa.py_buffer(b"more")], 1_000)
        assert chained.finish(state) == hashlib.sha256(data).hexdigest()


def test_staged_rows_are_small_and_lose_nothing(spark):
    """Parquet's writer holds 100 rows before it looks at their size: with rows of a whole batch, tasks ran out of memory."""
    import pyarrow as pa

    lines = [bytes([65 + i % 26]) * (i * 997 % 9_000) for i in range(1_000)]
    block = [0] * 400 + [9] * 600
    batch = pa.record_batch({
        "file": pa.array([0] * 1_000, pa.int32()), "block": pa.array(block, pa.int64()),
        "pos": pa.array(range(1_000), pa.int64()), "value": pa.array(lines, pa.binary()),
    })
    (out,) = chained._joined(iter([batch]))
    rows = out.to_pylist()
    assert b"".join(r["data"] for r in rows) == b"".join(x + b"\n" for x in lines)
    assert all(len(r["data"]) == r["n_bytes"] <= chained.RUN + 9_001 and block[r["pos"]] == r["block"] for r in rows)
    assert len(rows) > 10 and len({r["pos"] for r in rows}) == len(rows)

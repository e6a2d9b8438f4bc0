"""SHA-256 of files that are too large for one task: each task adds a piece and hands on the hash's state.

A SHA-256 is one chain from a file's first byte to its last, so its pieces take turns,
but none of them needs the others' bytes. Spark's line reader splits the files, and their
bytes are staged once by piece; a round of tasks, one for each file, then adds the next
piece to the states of the round before. A state is 112 bytes, whatever the file's size.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

from rowferry.scratch import materialize

#: Bytes of a file that one task adds, give or take a split of the line reader.
PIECE = 128 * 2**20

#: The line reader leaves out longer lines, so that none fills a task; their files are not hashed by pieces.
LINE = 32 * 2**20

# Bytes of lines in a staged row, or one line: Parquet's writer holds 100 rows before it looks at their size.
RUN = 256 * 2**10

# Endings that Spark's line reader unpacks: their own bytes cannot be read by pieces.
PACKED = r"(?i)\.(gz|gzip|bz2|deflate|snappy|lz4|lzo|lzo_deflate|zst|zstd|xz)$"

_MARK = b"\xef\xbb\xbf"  # taken off by the line reader


class _State(ctypes.Structure):
    """OpenSSL's public SHA256_CTX: plain numbers, so its bytes may go from task to task."""

    _fields_ = [
        ("h", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32),
        ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("md_len", ctypes.c_uint),
    ]

    @property
    def seen(self) -> int:
        """Bytes added so far."""
        return (self.high << 32 | self.low) // 8


def _openssl() -> ctypes.CDLL:
    """The library that hashlib itself is linked with; hashlib does not let go of its states."""
    import _hashlib

    library = ctypes.CDLL(_hashlib.__file__)
    library.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_void_p, ctypes.c_size_t]
    return library


def begin(data: bytes = b"") -> bytes:
    """The state of a hash that has seen only this."""
    state = _State()
    _openssl().SHA256_Init(ctypes.byref(state))
    return extend(bytes(state), [pa.py_buffer(data)])


def extend(state: bytes, pieces, length: int | None = None) -> bytes:
    """The state after these buffers too; bytes beyond ``length`` in all do not count."""
    now, library = _State.from_buffer_copy(state), _openssl()
    for piece in pieces:
        size = piece.size if length is None else min(piece.size, length - now.seen)
        library.SHA256_Update(ctypes.byref(now), piece.address, size)
    return bytes(now)


def finish(state: bytes) -> str:
    digest = ctypes.create_string_buffer(32)
    _openssl().SHA256_Final(digest, ctypes.byref(_State.from_buffer_copy(state)))
    return digest.raw.hex()


def can_hand_on() -> bool:
    """Is there an OpenSSL whose states can be stored? Tried out against hashlib."""
    try:
        state = extend(begin(b"a" * 70), [pa.py_buffer(b"b" * 70)])
    except (ImportError, OSError, AttributeError):
        return False
    return _State.from_buffer_copy(state).seen == 140 and finish(state) == hashlib.sha256(b"a" * 70 + b"b" * 70).hexdigest()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a file's block in a row as runs of bytes, each line with its end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, pos = (batch.column(i).to_numpy() for i in range(3))
        part = np.cumsum(pc.binary_length(batch.column(3)).to_numpy().astype(np.int64) + 1) // RUN
        new = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0) | (np.diff(part) != 0)) + 1
        starts = np.concatenate([[0], new])
        data = [
            b"\n".join([*batch.column(3).slice(a, b - a).to_pylist(), b""])
            for a, b in zip(starts, [*new, batch.num_rows])
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(file[starts]), pa.array(block[starts]), pa.array(pos[starts]),
             pa.array([len(d) for d in data], pa.int64()), pa.array(data, pa.binary())],
            names=["file", "block", "pos", "n_bytes", "data"],
        )


def _round(states: dict[int, bytes], lengths: list[int]):
    """A task that adds its file's next piece, in the order it comes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict[int, bytes] = {}
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                now[file] = extend(now.get(file, states[file]), [data.as_buffer()], lengths[file])
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(now), pa.int32()), pa.array(list(now.values()), pa.binary())], names=["file", "state"]
        )

    return task


def chained_sha256(
    spark: SparkSession, path: str, wanted: Column, files: list[Row], piece: int, line: int = LINE
) -> dict[str, str]:
    """SHA-256 of each of ``files`` (path, at, length) by path; they are those below ``path`` whose metadata fit ``wanted``.

    Left out are those whose bytes the line reader does not give in full, as a line is too long.
    """
    files = sorted(files, key=lambda f: -f["length"])
    lengths = [f["length"] for f in files]
    known = spark.createDataFrame([(i, f["at"]) for i, f in enumerate(files)], "file int, at string")
    reader = spark.read.option("lineSep", "\n").option("mapreduce.input.linerecordreader.line.maxlength", line)
    lines = reader.text(path).where(wanted).select(
        F.col("_metadata.file_path").alias("at"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").cast("binary").alias("value"),
    )
    runs = lines.join(F.broadcast(known), "at").select("file", "block", "pos", "value").mapInArrow(
        _joined, "file int, block bigint, pos bigint, n_bytes bigint, data binary"
    )
    staged = materialize(
        runs.withColumn("round", F.floor(F.col("block") / piece).cast("bigint")), "file-pieces", ["round"]
    )
    read = {r["file"]: r["n"] for r in staged.groupBy("file").agg(F.sum("n_bytes").alias("n")).collect()}
    # Lines have an end each; the file's last one may have none, and a mark at its start is not in them.
    beyond = {i: read.get(i, 0) - n for i, n in enumerate(lengths)}
    states = {i: begin(_MARK if n < 0 else b"") for i, n in beyond.items() if n in (-3, -2, 0, 1)}
    k = 0
    # The largest files come first, so those that have a piece in a round are the first ones.
    while live := [i for i in states if lengths[i] > k * piece]:
        own = staged.where((F.col("round") == k) & F.col("file").isin(live)).select("file", "block", "pos", "data")
        dealt = own.repartitionById(live[-1] + 1, "file").sortWithinPartitions("file", "block", "pos")
        added = dealt.select("file", "data").mapInArrow(
            _round({i: states[i] for i in live}, lengths), "file int, state binary"
        )
        states.update({r["file"]: bytes(r["state"]) for r in added.collect()})
        k += 1
    return {files[i]["path"]: finish(state) for i, state in states.items()}

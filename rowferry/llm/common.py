"""Small helpers that several operators share."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of payload after which a task hands an Arrow batch on.
FLUSH_BYTES = 8 << 20


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, although body names it many times."""
    return F.transform(F.array(value), body)[0]


def row_batches(rows: Iterable[tuple], schema: pa.Schema, size=lambda row: 64) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, cut by bytes so that long texts cannot pile up in a task."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight >= FLUSH_BYTES or len(held) >= 8192:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(first column, second column) of every row; only a slice of a batch becomes Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def in_parts(rows: Iterable[tuple], size: Callable, most: int) -> Iterator[list[tuple]]:
    """Rows in lists that end where their sizes add up to `most`."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight >= most:
            yield held
            held, weight = [], 0
    if held:
        yield held


class Remembered(dict):
    """Values of keys, each made when it is first asked for.

    Beyond `keep` keys only those of the latest lists stay, which changes speed only.
    """

    def __init__(self, make: Callable, keep: int, latest: int = 200_000):
        super().__init__()
        self.make, self.keep, self.most_latest = make, keep, latest
        self.latest, self.n_latest = deque(), 0

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value

    def of(self, keys: list) -> list:
        """The keys' values in order."""
        if len(self) > self.keep:
            kept = {k: self[k] for k in set(chain.from_iterable(self.latest)) if k in self}
            self.clear()
            if len(kept) <= self.keep:
                self.update(kept)
        found = list(map(self.__getitem__, keys))
        if len(keys) <= self.most_latest:
            self.latest.append(keys)
            self.n_latest += len(keys)
            while self.n_latest > self.most_latest:
                self.n_latest -= len(self.latest.popleft())
        return found


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads; a null text counts as empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )

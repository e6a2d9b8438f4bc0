"""Packing token ids into sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into pieces of at most max_piece ids. Each task takes
its documents as they come, gathers pieces worth `windows` sequences and deals
them out: every piece starts as a partition of its own, and the two partial
partitions of the largest imbalance are merged, the fullest windows of one with
the emptiest of the other, until one partition is left. Its windows are nearly
equal; if one holds more than the capacity, the window count rises and the
pieces are dealt out anew. Where it would rise by more than one in SPARE, as for
pieces of just over half a sequence, the pieces are halved first, down to a
quarter of a sequence; from there it rises until all fit.

Nothing is shuffled: a group of pieces never leaves its task, memory is bounded
by `windows`, and a lost task gives the same sequences again. Each task's last
group may leave one sequence partly filled.

Defined cases: a null or empty text is its end id alone; repeated rows are packed
each; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.llm.common import id_and_text, pairs, row_batches
from rowferry.llm.tokens import WordEncoder

CAPACITY = 4096
END_ID = 2
#: Documents longer than a sequence are cut, others only where padding would grow.
MAX_PIECE = CAPACITY
#: Of so many windows one may be added before pieces are halved.
SPARE = 32
#: Sequences that a task deals out at a time; more leave less padding and take more time.
WINDOWS = 256

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ("padded_length", pa.int64()),
])


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes dealt to k windows of nearly equal sums.

    A partial partition is its windows' loads in falling order, less the
    smallest, and for each window a node of the forest that joins its pieces.
    """
    left, right = [-1] * len(sizes), [-1] * len(sizes)
    heap = [(-s, i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)

    def padded(loads, nodes):
        return (np.concatenate([loads, np.zeros(k - len(loads), loads.dtype)]),
                np.concatenate([nodes, np.full(k - len(nodes), -1)]))

    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            loads, nodes = np.concatenate([a, b]), np.concatenate([x, y])
        else:
            (a, x), (b, y) = padded(a, x), padded(b, y)
            b, y = b[::-1], y[::-1]  # the fullest of one meets the emptiest of the other
            loads, nodes = a + b, np.where(x < 0, y, x)
            both = np.flatnonzero((x >= 0) & (y >= 0))
            nodes[both] = np.arange(len(left), len(left) + len(both))
            left += x[both].tolist()
            right += y[both].tolist()
        order = np.argsort(-loads, kind="stable")
        loads, nodes = loads[order], nodes[order]
        if len(loads) == k:
            loads = loads - loads[-1]
        serial += 1
        heapq.heappush(heap, (-int(loads[0]), serial, loads, nodes))

    out = []
    for root in heap[0][3].tolist() if heap else []:
        found, stack = [], [root] if root >= 0 else []
        while stack:
            node = stack.pop()
            if left[node] < 0:
                found.append(node)
            else:
                stack += (right[node], left[node])
        if found:
            out.append(found)
    return out


def windows_of(sizes: list[int], capacity: int, k: int = 1, most: int | None = None) -> list[list[int]] | None:
    """Windows within capacity, k of them at least; their count rises, by doubled steps, until each keeps within it.

    None if `most` windows are not enough.
    """
    k = max(k, 1, -(-sum(sizes) // capacity))
    # Of pieces above 1 / (j + 1) of the capacity a window holds j.
    k = max([k, *(-(-sum(s * (j + 1) > capacity for s in sizes) // j) for j in (1, 2, 3))])
    step = 1
    while most is None or k <= most:
        dealt = differencing(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in dealt):
            return dealt
        k, step = k + step if most is None or k == most else min(k + step, most), 2 * step
    return None


def fitted(sizes: list[int], capacity: int, spare: int = 0) -> list[list[tuple[int, int, int]]]:
    """Windows within capacity, of (index, start in the piece, length).

    spare is a number of windows, beyond the least, to begin with. Where more than
    one in SPARE would be added, all pieces are halved and dealt out anew; pieces
    of a quarter of the capacity fit however far the count has to rise.
    """
    least, grain = max(1, -(-sum(sizes) // capacity)), capacity
    while True:
        parts = [(i, at, min(grain, n - at)) for i, n in enumerate(sizes) for at in range(0, n, grain)]
        last = grain * 4 <= capacity
        most = None if last else least + least // SPARE
        dealt = windows_of([n for _, _, n in parts], capacity, min(least + spare, most or least + spare), most)
        if dealt is not None:
            return [_joined([parts[i] for i in w]) for w in dealt]
        grain = -(-grain // 2)


def _joined(window: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """A window's parts, those that follow each other in a piece as one."""
    out = []
    for i, start, n in sorted(window):
        if out and out[-1][0] == i and sum(out[-1][1:]) == start:
            start, n = out[-1][1], out.pop()[2] + n
        out.append((i, start, n))
    return out


def pack_rows(
    docs: Iterator[tuple[int | None, bytes]], first_id: int, capacity: int, max_piece: int, windows: int
) -> Iterator[tuple]:
    """Rows of SCHEMA for documents given as (doc_id, ids)."""
    held, tokens, sequence, spare = [], 0, first_id, 0

    def deal():
        nonlocal sequence, spare
        dealt = fitted([p[2] for p in held], capacity, spare)
        spare = max(0, len(dealt) - -(-tokens // capacity) - 1)  # one less than this group needed
        for window in dealt:
            total, at = sum(length for _, _, length in window), 0
            padded = total if total & (total - 1) == 0 else capacity
            for i, skip, length in window:
                doc_id, start, _, ids, doc_tokens = held[i]
                part = ids[4 * skip:4 * (skip + length)]
                yield doc_id, start + skip, length, part, doc_tokens, sequence, at, padded
                at += length
            sequence += 1

    for doc_id, ids in docs:
        n = len(ids) // 4
        for start in range(0, n, max_piece):
            part = ids[4 * start:4 * (start + max_piece)]
            held.append((doc_id, start, len(part) // 4, part, n))
            tokens += len(part) // 4
            if tokens >= windows * capacity:
                yield from deal()
                held, tokens = [], 0
    if held:
        yield from deal()


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    max_piece: int = MAX_PIECE,
    windows: int = WINDOWS,
) -> DataFrame:
    """One row for each piece: its document, place there, ids and place in a sequence.

    ids is binary, little-endian unsigned 32-bit. tokenizer is the path of a
    tokenizer file that all executors can read.
    """

    def task(batches):
        encoder = WordEncoder.of(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()

        def encoded():
            held, weight = [], 0
            for row in pairs(batches):
                held.append(row)
                weight += len(row[1])
                if weight > 200_000:
                    yield from held_ids(held)
                    held, weight = [], 0
            yield from held_ids(held)

        def held_ids(held):
            for (doc_id, _), ids in zip(held, encoder([t for _, t in held])):
                yield doc_id, ids + end

        first = TaskContext.get().partitionId() << 40
        rows = pack_rows(encoded(), first, capacity, max_piece, windows)
        return row_batches(rows, SCHEMA, lambda r: len(r[3]) + 64)

    return id_and_text(docs, id_col, text_col).mapInArrow(
        task, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
        "offset long, padded_length long"
    )


def sequences(packed: DataFrame, pad_id: int = 0) -> DataFrame:
    """sequence_id and its padded ids, the pieces joined in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = packed.groupBy("sequence_id").agg(parts.alias("parts"), F.max("padded_length").alias("n"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    pad = F.lit(int(pad_id).to_bytes(4, "little"))
    short = (F.col("n") - F.length(joined) / 4).cast("int")
    padding = F.unhex(F.repeat(F.hex(pad), short))
    return whole.select("sequence_id", F.concat(joined, padding).alias("ids"))

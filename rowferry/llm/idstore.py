"""Token ids in binary shards with a minimal perfect hash index.

A shard file is a run of blocks in ascending key order. A block is
  magic, block number, documents, distinct keys, hash buckets, ids, bytes of an id (7 x u64)
  displacements of the hash buckets (u32)
  index, one slot for each distinct key: fingerprint, first record (2 x u32)
  records in key order: key (i64), first id in the block (u64), ids (u32), key is null (u32)
  ids (u16, or u32 for vocabularies beyond 65,536), all little-endian, and one line end.
The index has no empty slots and stores no keys: a key's hash bucket gives the
displacement that sends every key of the bucket to a slot of its own, and the
stored fingerprint rejects keys that are not there (the record's key settles it).

Files go through Spark's text writer, so they are committed like any other
output, on any store; they come back through binaryFile. Documents are range
partitioned by key (rows of one key by their text's hash too, so a hot key is
split), and a task holds one block at a time.

Defined cases: null keys come first and are not indexed; a null or empty text is
its end id alone; rows of one key lie side by side and a lookup finds all of a
block's; an empty table gives no block; other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowferry.llm.common import id_and_text, pairs, row_batches
from rowferry.llm.tokens import WordEncoder
from rowferry.scratch import materialize

END_ID = 1
#: Ids in a block; a longer document is a block of its own.
BLOCK_IDS = 1 << 18
#: Bytes of text for which a shard is planned.
SHARD_BYTES = 16 << 20
MAGIC = 0x3153444946454952
HEAD = struct.Struct("<7Q")
RECORD = np.dtype([("key", "<i8"), ("at", "<u8"), ("n", "<u4"), ("null", "<u4")])
SLOT = np.dtype([("fingerprint", "<u4"), ("record", "<u4")])
KEYS_PER_BUCKET = 4


def mixed(keys: np.ndarray, salt) -> np.ndarray:
    """64-bit hashes of whole numbers; salt may be one for each key."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + (np.asarray(salt, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


BUCKET_SALT, PRINT_SALT = 0xFFFFFFFF00000001, 0xFFFFFFFF00000002


@dataclass
class PerfectHash:
    """n distinct keys to the slots 0 to n-1, one each."""

    displacements: np.ndarray
    n: int

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        n = len(keys)
        shifts = np.zeros(max(1, -(-n // KEYS_PER_BUCKET)), "<u4")
        if not n:
            return cls(shifts, 0)
        bucket = (mixed(keys, BUCKET_SALT) % np.uint64(len(shifts))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=len(shifts))
        starts = np.concatenate([[0], np.cumsum(counts)])
        taken, tries = np.zeros(n, bool), np.arange(64, dtype=np.uint64)
        for b in np.argsort(-counts, kind="stable"):  # the fullest first, while there is room
            if not counts[b]:
                break
            own, base = keys[order[starts[b]:starts[b + 1]]], 0
            while True:
                slots = (mixed(own[None, :], (tries + np.uint64(base))[:, None]) % np.uint64(n)).astype(np.int64)
                ranked = np.sort(slots, axis=1)
                good = ~taken[slots].any(axis=1) & (np.diff(ranked, axis=1) != 0).all(axis=1)
                if good.any():
                    found = int(np.argmax(good))
                    shifts[b] = base + found
                    taken[slots[found]] = True
                    break
                base += 64
        return cls(shifts, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        bucket = (mixed(keys, BUCKET_SALT) % np.uint64(len(self.displacements))).astype(np.int64)
        return (mixed(keys, self.displacements[bucket]) % np.uint64(max(1, self.n))).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys, PRINT_SALT) >> np.uint64(32)).astype("<u4")


def write_block(number: int, docs: list[tuple[int | None, bytes]], width: int = 4) -> bytes:
    """The bytes of one block for (key, ids as u32) in key order; width is the bytes of a stored id."""
    records = np.zeros(len(docs), RECORD)
    records["null"] = [k is None for k, _ in docs]
    records["key"] = [0 if k is None else k for k, _ in docs]
    records["n"] = [len(ids) // 4 for _, ids in docs]
    records["at"] = np.cumsum(records["n"].astype(np.uint64)) - records["n"]
    live = np.flatnonzero(records["null"] == 0)
    keys, first = np.unique(records["key"][live], return_index=True)
    table = PerfectHash.build(keys)
    index = np.zeros(len(keys), SLOT)
    slots = table.slots(keys)
    index["fingerprint"][slots], index["record"][slots] = fingerprints(keys), live[first]
    payload = np.frombuffer(b"".join([ids for _, ids in docs]), "<u4").astype(f"<u{width}")
    head = HEAD.pack(MAGIC, number, len(docs), len(keys), len(table.displacements), len(payload), width)
    return b"".join([head, table.displacements.tobytes(), index.tobytes(), records.tobytes(), payload.tobytes()])


class Block:
    """One block read from bytes; a document's ids are a slice of them."""

    def __init__(self, data: bytes, at: int):
        magic, self.number, docs, keys, buckets, ids, self.width = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no block starts at byte {at}")
        at += HEAD.size
        self.table = PerfectHash(np.frombuffer(data, "<u4", buckets, at), keys)
        at += 4 * buckets
        self.index = np.frombuffer(data, SLOT, keys, at)
        at += SLOT.itemsize * keys
        self.records = np.frombuffer(data, RECORD, docs, at)
        self.at = at + RECORD.itemsize * docs
        self.data, self.n_ids, self.end = data, ids, self.at + self.width * ids + 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's first record, -1 where the block has none."""
        if not self.table.n or not len(keys):
            return np.full(len(keys), -1)
        slot = self.index[self.table.slots(keys)]
        found = np.where(slot["fingerprint"] == fingerprints(keys), slot["record"].astype(np.int64), -1)
        here = found >= 0
        found[here] = np.where(self.records["key"][found[here]] == keys[here], found[here], -1)
        return found

    def ids(self, record: int) -> bytes:
        """As u32."""
        r = self.records[record]
        start = self.at + self.width * int(r["at"])
        return np.frombuffer(self.data, f"<u{self.width}", int(r["n"]), start).astype("<u4").tobytes()

    def rows(self, keys: np.ndarray) -> Iterator[int]:
        """All records of these keys, found through the index."""
        for key, first in zip(keys.tolist(), self.find(keys).tolist()):
            while 0 <= first < len(self.records) and self.records["key"][first] == key and not self.records["null"][first]:
                yield first
                first += 1


def blocks_of(data: bytes) -> Iterator[Block]:
    at = 0
    while at < len(data):
        block = Block(data, at)
        yield block
        at = block.end


def write_ids(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode docs and write them to path as shards in ascending key order.

    The shard's number is the number of its part file; shards cover ascending
    key ranges. tokenizer is a path that all executors can read.
    """

    def task(batches):
        encoder = WordEncoder.of(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4

        def blocks():
            held, ids, number = [], 0, 0
            for key, text in pairs(batches):
                data = encoder([text])[0] + end
                held.append((key, data))
                ids += len(data) // 4
                if ids >= block_ids:
                    yield (write_block(number, held, width),)
                    held, ids, number = [], 0, number + 1
            if held:
                yield (write_block(number, held, width),)

        schema = pa.schema([("block", pa.binary())])
        return row_batches(blocks(), schema, lambda r: len(r[0]))

    rows = id_and_text(docs, id_col, text_col)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    dealt = rows.repartitionByRange(max(2, -(-size // SHARD_BYTES)), *order)
    sorted_ = dealt.sortWithinPartitions(*order)
    # Text cells are written byte for byte, each followed by one line end.
    blocks = sorted_.mapInArrow(task, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the shards: shard, block, doc_id, block_start, ids.

    Each block's keys are looked up in its index; null keys are read in place.
    """
    schema = pa.schema([
        ("shard", pa.int64()), ("block", pa.int64()), ("doc_id", pa.int64()), ("block_start", pa.int64()),
        ("ids", pa.binary()),
    ])

    def rows(batches):
        for shard, data in pairs(batches):
            for block in blocks_of(data):
                null = np.flatnonzero(block.records["null"])
                wanted = np.unique(block.records["key"][block.records["null"] == 0])
                for r in [*null.tolist(), *block.rows(wanted)]:
                    record = block.records[r]
                    key = None if record["null"] else int(record["key"])
                    yield shard, block.number, key, int(record["at"]), block.ids(r)

    def task(batches):
        return row_batches(rows(batches), schema, lambda r: len(r[4]) + 64)

    return _files(spark, path).mapInArrow(
        task, "shard long, block long, doc_id long, block_start long, ids binary"
    )


def _files(spark: SparkSession, path: str, named: list[str] | None = None) -> DataFrame:
    """Number and bytes of all shards, or of the named ones."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
    files = reader.load([f"{path}/{n}" for n in named] if named else path)
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    return files.select(number.alias("shard"), F.col("content"))


def block_sizes(spark: SparkSession, path: str) -> DataFrame:
    """shard, block, smallest and largest key and number of ids of each block."""
    schema = pa.schema([(c, pa.int64()) for c in ("shard", "block", "low", "high", "n_ids")])

    def rows(batches):
        for shard, data in pairs(batches):
            for block in blocks_of(data):
                live = block.records["key"][block.records["null"] == 0]
                low, high = (int(live[0]), int(live[-1])) if len(live) else (None, None)
                yield shard, block.number, low, high, block.n_ids

    return _files(spark, path).mapInArrow(
        lambda b: row_batches(rows(b), schema), "shard long, block long, low long, high long, n_ids long"
    )


def starts(sizes: DataFrame) -> DataFrame:
    """shard, block and base, the number of ids before each block.

    Blocks are summed within their shard first; only one row for each shard
    file passes through a single window.
    """
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_base"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    return blocks.join(shards, "shard").select("shard", "block", (F.col("shard_base") + F.col("inside")).alias("base"))


INDEX = "shard long, block long, low long, high long, n_ids long, file string"


def write_index(spark: SparkSession, path: str) -> None:
    """A sidecar beside the shards: key range, size and file of each block. Reads the shards once."""
    sizes = block_sizes(spark, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    names = files.select(number.alias("shard"), F.substring_index("path", "/", -1).alias("file"))
    sizes.join(names, "shard").write.mode("overwrite").parquet(f"{path}/_index")


def routes(index: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, shard, block, file) of every block that may hold a key, without comparing keys with all blocks.

    Blocks are disjoint ranges in key order but for their ends: a block holds a
    key between its ends, and then it is the last one that begins before the key,
    or the key is one of its ends, which is an equality.
    """
    blocks = index.where("low is not null").select("low", "high", "shard", "block", "file")
    place = F.struct("high", "shard", "block", "file")
    starts = blocks.groupBy(F.col("low").alias("key")).agg(F.max(place).alias("place"))
    marks = starts.withColumn("asked", F.lit(False)).unionByName(
        keys.select("key", F.lit(None).cast(starts.schema["place"].dataType).alias("place"), F.lit(True).alias("asked"))
    )
    # The last block before each key: within a range of keys, and from the ranges before it.
    ordered = marks.repartitionByRange("key", "asked").withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered, "ids-route")
    inside = Window.partitionBy("part").orderBy("key", "asked")
    found = ordered.withColumn("last", F.last("place", ignorenulls=True).over(inside))
    ends = ordered.where(~F.col("asked")).groupBy("part").agg(F.max_by("place", "key").alias("end"))
    # One row for each range.
    parts = ordered.select("part").distinct().join(ends, "part", "left").select(
        "part", F.last("end", ignorenulls=True).over(
            Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier")
    )
    asked = found.where("asked").join(parts, "part").select("key", F.coalesce("last", "earlier").alias("place"))
    between = asked.where(F.col("place.high") > F.col("key")).select("key", "place.shard", "place.block", "place.file")
    at_ends = [
        keys.join(blocks.withColumnRenamed(end, "key"), "key").select("key", "shard", "block", "file") for end in ("low", "high")
    ]
    return between.unionAll(at_ends[0]).unionAll(at_ends[1]).distinct()


#: Asked keys that a task looks up in a block at a time.
ASKED = 100_000
#: Files that are opened by name; where more are needed, all are read and joined by shard.
NAMED_FILES = 1000


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """doc_id and ids of the asked keys that are stored; ``write_index`` has to be run before.

    Keys are routed to blocks through the sidecar, only files that may hold one
    are opened, and each key is one probe of a block's index. Keys that are asked
    for more than once are found once.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
    asked = keys.select(F.col(key_col).cast("long").alias("key")).where("key is not null").distinct()
    routed = materialize(routes(spark.read.schema(INDEX).parquet(f"{path}/_index"), asked), "ids-routed")
    files = [r["file"] for r in routed.select("file").distinct().limit(NAMED_FILES + 1).collect()]
    named = files if 0 < len(files) <= NAMED_FILES else None
    # A share of the keys of a shard, by hash, goes with one copy of the shard's bytes.
    shares = routed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ASKED).alias("shares"))
    dealt = routed.join(shares, "shard").withColumn("share", F.pmod(F.xxhash64("key"), "shares"))
    wanted = dealt.groupBy("shard", "share").agg(
        F.sort_array(F.collect_list(F.struct("block", "key"))).alias("asked")
    ).select("shard", F.col("asked.block").alias("blocks"), F.col("asked.key").alias("keys"))

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, of_block, wanted_keys = (batch.column(c)[i].as_py() for c in range(3))
                of_block, wanted_keys = np.array(of_block, np.int64), np.array(wanted_keys, np.int64)
                for block in blocks_of(data):
                    own = wanted_keys[of_block == block.number]
                    for r in block.rows(own) if len(own) else ():
                        yield int(block.records["key"][r]), block.ids(r)

    joined = _files(spark, path, named).join(wanted, "shard").select("content", "blocks", "keys")
    return joined.mapInArrow(
        lambda b: row_batches(rows(b), schema, lambda r: len(r[1]) + 64), "doc_id long, ids binary"
    )

"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are two halves. Fingerprints that differ in 3 bits or
fewer differ in at most THRESHOLD = 1 bit on one half at least. On each half
the anchors are the words of a covering code: the perfect Hamming code of 31
bits (covering radius RADIUS = 1) with the 32nd bit free. A fingerprint's home is
the anchor within RADIUS; it is replicated to every anchor within
RADIUS + THRESHOLD, 17 at most. If two halves differ in at most THRESHOLD bits, the
second lies within RADIUS + THRESHOLD of the first one's home, so every linked
pair meets at an anchor, and is compared there on all 64 bits.

Documents with equal fingerprints are one row before that. An anchor with more
fingerprints than CHUNK is split: its fingerprints are dealt to chunks, and
every two chunks meet in a group of their own. Groups yield a star for each set
of linked fingerprints, never all pairs; components then grow by joins, with
every round written to the shared folder.

Defined cases: a text without words, or null, has fingerprint zero and is linked
like any other; rows with a null id take part, and the component's id is the
smallest id that is not null (null if there is none); repeated rows give
repeated rows; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from rowferry.llm.common import id_and_text, row_batches
from rowferry.scratch import materialize

SEED = 42
SHINGLE = 3
LIMIT = 3
RADIUS = 1
THRESHOLD = 1
CHUNK = 2048


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text."""
    import xxhash

    words = text.encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a very long text is hashed in stretches
        part = words[at:min(at + (1 << 16), n) + shingle - 1]
        windows = zip(*[part[k:] for k in range(shingle)]) if len(words) >= shingle else [words]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED) for w in windows], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _syndromes() -> np.ndarray:
    """For each byte and place in a half: the exclusive or of its set bits' numbers, 1 to 31; bit 32 counts nothing."""
    bits = np.arange(256)[:, None] >> np.arange(8) & 1
    numbers = (np.arange(32) + 1).reshape(4, 8)
    numbers[3, 7] = 0
    return np.stack([np.bitwise_xor.reduce(bits * numbers[b], axis=1) for b in range(4)])


def _steps() -> np.ndarray:
    """For each syndrome, what to flip to come to each anchor in reach; the first is home, -1 fills up."""
    top = 1 << 31
    out = np.full((32, 17), -1, np.int64)
    out[0, :2] = 0, top
    for s in range(1, 32):
        own = 1 << (s - 1)
        two = [1 << (a - 1) | 1 << ((a ^ s) - 1) for a in range(1, 32) if a < a ^ s and a ^ s <= 31]
        row = [own, own | top, *two]
        out[s, :len(row)] = row
    return out


SYNDROMES, STEPS = _syndromes(), _steps()


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all anchors in reach of signed 64-bit fingerprints, and which are valid.

    Shape (n, 34): 17 for each half, home first. A key has the half's number at bit 32.
    """
    halves = prints.astype(np.int64).view(np.uint64)
    keys, valid = [], []
    for half in (0, 1):
        value = (halves >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        syndrome = np.bitwise_xor.reduce([SYNDROMES[b][value >> 8 * b & 255] for b in range(4)], axis=0)
        steps = STEPS[syndrome]
        keys.append((value[:, None] ^ np.where(steps < 0, 0, steps)) | half << 32)
        valid.append(steps >= 0)
    return np.concatenate(keys, axis=1), np.concatenate(valid, axis=1)


def _home_rows(batches):
    for batch in batches:
        keys, _ = anchors(batch.column(0).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, [0, 17]].ravel())], ["anchor"])


def _reach_rows(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            prints = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
            keys, valid = anchors(prints)
            rows, cols = np.nonzero(valid)
            yield pa.RecordBatch.from_arrays([pa.array(keys[rows, cols]), pa.array(prints[rows])], ["anchor", "print"])


def stars(prints: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint linked to it in this group) for all that have one."""
    own = np.sort(prints)
    bits, open_ = own.view(np.uint64), np.ones(len(own), bool)
    nodes, roots = [], []
    for root in range(len(own)):
        if not open_[root]:
            continue
        open_[root] = False
        front = np.array([root])
        while len(front):
            rest, found = np.flatnonzero(open_), []
            for at in range(0, len(front), 64):
                if not len(rest):
                    break
                near = (np.bitwise_count(bits[front[at:at + 64], None] ^ bits[rest]) <= limit).any(axis=0)
                found.append(rest[near])
                rest = rest[~near]
            front = np.concatenate(found) if found else np.zeros(0, np.int64)
            open_[front] = False
            nodes.append(own[front])
            roots.append(np.full(len(front), own[root]))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *nodes]), np.concatenate([empty, *roots])


def _star_rows(batches):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def rows():
        for batch in batches:
            for group in batch.column(0):
                nodes, roots = stars(np.array(group.as_py(), np.int64))
                yield from zip(nodes.tolist(), roots.tolist())

    return row_batches(rows(), schema, lambda r: 16)


def links(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) that join all of the distinct fingerprints in column print that are linked."""
    homes = prints.mapInArrow(_home_rows, "anchor long").distinct()
    reach = prints.mapInArrow(_reach_rows, "anchor long, print long")
    met = materialize(reach.join(homes, "anchor", "left_semi"), "simhash-met")
    chunks = met.groupBy("anchor").count().where("count > 1").select(
        "anchor", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")
    )
    own = F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")
    dealt = met.join(chunks, "anchor").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    )
    groups = dealt.groupBy("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    lists = groups.agg(F.collect_list("print").alias("prints")).where(F.size("prints") > 1).select("prints")
    return lists.mapInArrow(_star_rows, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, for all nodes of edges (u, v).

    Large-star and small-star rounds: every node hands its neighbours to the
    smallest it knows, until the edges are stars.
    """
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "simhash-edges",
    )
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "simhash-edges")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (signed 64-bit fingerprint) and component_id, one row for each row of docs."""
    texts = id_and_text(docs, id_col, text_col)
    marked = materialize(texts.select("doc_id", fingerprints("text").alias("print")), "simhash-prints")
    named = _rooted(marked.groupBy("print").agg(F.min("doc_id").alias("first")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = named.join(least, "root").select("print", "component_id")
    return marked.join(groups, "print").select("doc_id", "print", "component_id")


def _rooted(classes: DataFrame) -> DataFrame:
    """classes, one row for each print, with their component's root; prints without a link are their own root."""
    roots = components(links(classes.select("print")))
    named = classes.join(roots, classes.print == roots.node, "left")
    return named.select(*classes.columns, F.coalesce("root", "print").alias("root"))


HELPER = "__llm_twin"


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, one of each component: that of the smallest id.

    A component is known by its root fingerprint, as rows of several components
    can share an id. Rows of one component that share its smallest id are told
    apart by their text's hash, then any of them stays. Of components without
    any id one row stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    texts = id_and_text(docs, id_col, text_col)
    marked = texts.select("doc_id", fingerprints("text").alias("print"), F.xxhash64("text").alias("hash"))
    rows = materialize(marked, "simhash-prints").groupBy("print", "doc_id", "hash").agg(F.count("*").alias("n"))
    # The smallest id, null last; then the smallest hash.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "n")).alias("best")
    classes = materialize(rows.groupBy("print").agg(best), "simhash-classes")
    chosen = _rooted(classes).groupBy("root").agg(F.min("best").alias("best")).select(
        F.col("root").alias(f"{HELPER}_root"), F.col("best.doc_id").alias(f"{HELPER}_id"),
        F.col("best.hash").alias(f"{HELPER}_hash"), (F.col("best.n") > 1).alias(f"{HELPER}_many"),
    )
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(f"{HELPER}_id")) & (
        F.xxhash64(text) == F.col(f"{HELPER}_hash")
    )
    first = docs.join(chosen, same)
    kept = first.where(~F.col(f"{HELPER}_many")).select(*columns)
    many = first.where(F.col(f"{HELPER}_many")).withColumn(HELPER, F.col(f"{HELPER}_hash"))
    return kept.unionByName(_one_each(many, f"{HELPER}_root").select(*columns))


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key, by the order of HELPER; partly combined before the shuffle."""
    names = rows.columns
    packed = rows.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.col(HELPER)).alias("row"))
    return packed.select("row.*")

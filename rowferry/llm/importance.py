"""Importance resampling with hashed n-gram models.

Words and word pairs are hashed to BUCKETS features. Two generative models,
one of target text and one of all raw text, are smoothed shares of the
features; a document's log weight is the sum of the log ratios of its features.
Gumbel noise, drawn from a hash of the document's id, turns the k largest sums of
weight and noise into a sample without replacement. Counts cover all documents;
tasks hand on one count for each feature, and the models have a fixed size.

Targets are documents labelled of good quality and not toxic. By default k is
the share of targets among all labelled documents, of all documents.

Defined cases: a text without words, or null, weighs 0; without labels, targets or
words all weights are 0 and without labels all are kept; a null id gets noise like
any other id; repeated rows have equal weights and noise, and where the cut falls
between equal rows either is kept; an empty table gives no row.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.llm.common import pairs, row_batches
from rowferry.operators.numbering import with_row_no
from rowferry.scratch import materialize

BITS = 14
BUCKETS = 1 << BITS
SMOOTHING = 1.0


def features(text: str) -> np.ndarray:
    """Buckets of all words and neighbouring pairs."""
    words = text.encode().lower().split()
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    mixed = np.concatenate([one, two ^ np.uint64(0x5555)]) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - BITS)).astype(np.int64)


def targets(labels: DataFrame) -> DataFrame:
    """doc_id and whether it is a target, one row for each labelled document."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    rows = labels.where("doc_id is not null and quality is not null")
    return rows.groupBy("doc_id").agg(F.min(good).alias("target"))


def counts(docs: DataFrame) -> DataFrame:
    """bucket, raw and target counts of docs (target boolean, text)."""
    schema = pa.schema([(c, pa.int64()) for c in ("bucket", "raw", "target")])

    def task(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for is_target, text in pairs(batches):
            buckets, n = np.unique(features(text), return_counts=True)
            raw[buckets] += n
            if is_target:
                target[buckets] += n
        used = np.flatnonzero(raw).tolist()
        return row_batches(((b, int(raw[b]), int(target[b])) for b in used), schema, lambda r: 24)

    rows = docs.select("target", "text").mapInArrow(task, "bucket long, raw long, target long")
    return rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counted: DataFrame) -> np.ndarray:
    """For each bucket, log of target share over raw share; at most BUCKETS rows come to the driver."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counted.collect():
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return np.zeros(BUCKETS)
    share = lambda x: (x + SMOOTHING) / (x.sum() + SMOOTHING * BUCKETS)
    return np.log(share(target)) - np.log(share(raw))


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id and log_weight."""
    schema = pa.schema([("doc_id", pa.int64()), ("log_weight", pa.float64())])

    def task(batches):
        rows = ((doc_id, float(ratios[features(text)].sum())) for doc_id, text in pairs(batches))
        return row_batches(rows, schema)

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, log_weight double")


def resample(
    docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", share: float | None = None, seed: int = 0
) -> DataFrame:
    """doc_id, log_weight, noisy_weight and kept for each row of docs; share of the rows are kept."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    known = targets(labels)
    # Always the same plan: broadcast at one size and sorted at another, its cost could not be foreseen.
    flagged = rows.join(known.where("target").hint("merge"), "doc_id", "left")
    ratios = log_ratios(counts(flagged.withColumn("target", F.coalesce("target", F.lit(False)))))
    if share is None:
        share = known.agg(F.avg(F.col("target").cast("int"))).first()[0]
        share = 1.0 if share is None else share
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    noisy = F.col("log_weight") - F.log(-F.log(unit))
    # Written before it is sorted: finding range bounds would weigh every text once more.
    weighed = materialize(weigh(rows, ratios).withColumn("noisy_weight", noisy), "importance")
    numbered = with_row_no(weighed, [F.col("noisy_weight").desc(), F.col("doc_id").asc_nulls_first()])
    k = round(share * numbered.count())
    return numbered.select("doc_id", "log_weight", "noisy_weight", (F.col("row_no") <= k).alias("kept"))

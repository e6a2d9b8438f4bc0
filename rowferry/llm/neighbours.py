"""Nearest neighbours by a block matrix join of int8 tiles.

Vectors are packed into blocks; every block of queries meets every block of
candidates in a tile of its own. A tile multiplies int8 codes (through floats
that hold the whole numbers exactly), bounds how far each product can be from
the true one, and keeps the pairs whose upper bound reaches the k-th largest
lower bound; those are computed again in double precision, so no neighbour is
lost. Tiles' lists are merged by heaps, a bounded number of lists at a time.

With v = s c + e (scale s, codes c, rest e), the error of a product is at most
|s c||e'| + |e||v'|.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do null ids; rows that share an id are queries and
candidates each, none of them a candidate of its own id, and the queries of one
id have one list, of the best pairs; rows equal in id and vector are worked on
once and counted as often as they are there; vectors of other lengths than the
query's are not its candidates; equal scores go to the smaller id; other columns
are not read.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 16384
#: Lists of a query that are merged at a time.
FAN = 16
LIST = "query_id long, vec_id long, score double, times long"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector (array of double), times (rows equal in both) and dim of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("times")).withColumn("dim", F.size("vector"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows with their block's number; as many blocks as their count needs."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")), n


def quantised(v: np.ndarray):
    """Codes of -127 to 127, scales, and norms of the coded vectors, the rests and the vectors."""
    scale = np.abs(v).max(axis=1) / 127
    scale[scale == 0] = 1
    codes = np.rint(v / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    norm = lambda x: np.sqrt((x * x).sum(axis=1)) * (1 + 1e-9) + 1e-300
    return codes, scale, norm(coded), norm(v - coded), norm(v)


def products(c: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of these rows with q, each summed from the first component to the last."""
    parts = [np.cumsum(c[rows[i:i + 4096]] * q, axis=1)[:, -1] for i in range(0, len(rows), 4096)]
    return np.concatenate(parts) if parts else np.zeros(0)


def tile(q_ids, q, c_ids, c, k: int):
    """The k best candidates of each query: places of queries, places of candidates, exact scores."""
    qc, qs, qn, qe, _ = quantised(q)
    cc, cs, _, ce, cn = quantised(c)
    # Sums of products of codes stay below 2**24 up to 1040 components: exact as 32-bit floats.
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    codes = cc.astype(kind).T
    ids, near, scores = [], [], []
    for at in range(0, len(q), 64):
        part = slice(at, at + 64)
        product = (qc[part].astype(kind) @ codes) * qs[part, None] * cs
        error = qn[part, None] * ce + qe[part, None] * cn
        error += 1e-12 * (qn[part, None] + qe[part, None]) * cn
        lower = product - error
        lower[q_ids[part, None] == c_ids] = -np.inf
        least = np.partition(lower, -k, axis=1)[:, -k] if len(c) > k else np.full(len(lower), -np.inf)
        for row in range(len(lower)):
            left = np.flatnonzero(product[row] + error[row] >= least[row])
            left = left[c_ids[left] != q_ids[at + row]]
            exact = products(c, left, q[at + row])
            best = np.lexsort((c_ids[left], -exact))[:k]
            ids.append(np.full(len(best), at + row))
            near.append(left[best])
            scores.append(exact[best])
    return np.concatenate(ids), np.concatenate(near), np.concatenate(scores)


def nearest(vectors: DataFrame, queries, id_col="vec_id", vector_col="embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k largest inner products.

    queries is a condition on vec_id that says which rows are queries; every
    other row is a candidate of each.
    """
    rows = usable(vectors, id_col, vector_col)
    asked, n_q = _blocks(rows.where(queries), QUERY_BLOCK)
    all_, n_c = _blocks(rows, CANDIDATE_BLOCK)

    def tiles(own: DataFrame, n: int, name: str) -> DataFrame:
        """Each row once for every block of the other side."""
        return own.withColumnRenamed("block", name).withColumn(
            "c" if name == "q" else "q", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        )

    def one(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = ([], [], [], [])
        if len(q) and len(c):
            parts = [x for f in (q, c) for x in (f["vec_id"].to_numpy(), np.array(f["vector"].tolist(), np.float64))]
            own, near, scores = tile(*parts, k)
            times = np.minimum(q["times"].to_numpy()[own], k) * np.minimum(c["times"].to_numpy()[near], k)
            out = parts[0][own], parts[2][near], scores, times
        group = int(c["c"].iloc[0]) if len(c) else 0
        block = int(q["q"].iloc[0]) if len(q) else 0
        found = pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "times"), out)))
        return found.assign(q=block, c=group)[["q", "c", "query_id", "vec_id", "score", "times"]]

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        """Lists of one block of queries into one list for each query."""
        kept = []
        for query, own in frame.groupby("query_id"):
            lists = [
                zip((-part["score"]).tolist(), part["vec_id"].tolist(), part["times"].tolist())
                for _, part in own.sort_values(["score", "vec_id"], ascending=[False, True]).groupby("c")
            ]
            kept += [(query, v, -s, n) for s, v, n in islice(heapq.merge(*lists), k)]
        block, group = int(frame["q"].iloc[0]), int(frame["c"].iloc[0]) // FAN
        found = pd.DataFrame(kept, columns=["query_id", "vec_id", "score", "times"])
        return found.assign(q=block, c=group)[["q", "c", "query_id", "vec_id", "score", "times"]]

    key, kind = ["dim", "q", "c"], "q int, c int, " + LIST
    # Both sides come from one frame; new names keep their columns apart in the cogroup.
    columns = [*key, "vec_id", "vector", "times"]
    left = tiles(asked, n_c, "q").select(*columns).toDF(*columns).groupBy(*key)
    right = tiles(all_, n_q, "c").select([F.col(c).alias(f"c_{c}") for c in columns])
    right = right.groupBy(*[f"c_{c}" for c in key])
    found = left.cogroup(right).applyInPandas(lambda q, c: one(q, c.rename(columns=lambda n: n[2:])), kind)
    groups = n_c
    while groups > 1:
        found = found.groupBy("q", F.floor(F.col("c") / FAN)).applyInPandas(merged, kind)
        groups = -(-groups // FAN)

    # One list for each block and id is left; those of one id meet, cut to k before they are shuffled.
    listed = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)))))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return listed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )

"""Language of a text by a bidirectional gated recurrent network over bytes.

A text is cut into windows of WINDOW bytes, the sequences the network is
trained on and reads. Two gated recurrent layers, one in each direction, and a
softmax over both states label every byte; a document's probabilities are the
mean over its letter bytes, of the whole text.

Training is numpy backpropagation through time on the driver, over a bounded
sample: SAMPLE_DOCS documents of each language, at most SAMPLE_WINDOWS distinct windows
each, taken all over the text. Only rows with a letter are drawn, those of FULL
letters first; a text without a window of FULL letters gives its fullest. The
sample is chosen by hashes of the ids, so it does not depend on how rows are
dealt. Prediction is a map over all documents
without a shuffle.

Defined cases: a text that is null or has no letter is `und` with score 0, as is
every text if no language was learned; null languages and ids are never learned
from; repeated rows are predicted each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowferry.llm.common import id_and_text, pairs, row_batches

WINDOW = 64
HIDDEN = 8
SAMPLE_DOCS = 300
SAMPLE_WINDOWS = 6
#: Groups of a language that are ranked apart before the language is.
MERGES = 16
STEPS = 500
BATCH = 96
RATE = 0.02
UNKNOWN = "und"
#: Bytes that count as letters: a-z (A-Z are lowered first) and parts of other alphabets' characters.
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
#: Letter bytes of a window that is learned from, where the text has any such window.
FULL = WINDOW // 3
#: The same of a text's characters, for Spark.
ANY_LETTER = r"[A-Za-z]|[^\x00-\x7F]"
FULL_LETTERS = rf"(?:(?:{ANY_LETTER})[\x00-@\[-`{{-\x7F]*+){{{FULL}}}"


def windows(data: bytes, width: int = WINDOW) -> np.ndarray:
    """The bytes as rows of equal width; the last is filled up with byte 0."""
    n = max(1, -(-len(data) // width))
    out = np.zeros(n * width, np.uint8)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, width)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


@dataclass
class Network:
    """For each direction: a row of gate inputs for each byte (256, 3H), recurrent weights (H, 3H) and
    output weights (H, C); gates are update, reset, candidate. One bias for the output."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    outputs: list[np.ndarray]
    bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
        rng, n = np.random.default_rng(seed), len(languages)
        draw = lambda *shape: (rng.normal(size=shape) * 0.3).astype(np.float32)
        return cls(
            languages, [draw(256, 3 * hidden) for _ in (0, 1)], [draw(hidden, 3 * hidden) for _ in (0, 1)],
            [draw(hidden, n) for _ in (0, 1)], np.zeros(n, np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, *self.recurrent, *self.outputs, self.bias]

    def states(self, side: int, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after every byte, (length, rows, H), in the text's order. keep gathers what training needs."""
        table, weights = self.tables[side], self.recurrent[side]
        hidden, (length, rows) = len(weights), x.shape
        out, h = np.empty((length, rows, hidden), np.float32), np.zeros((rows, hidden), np.float32)
        for t in range(length) if side == 0 else range(length - 1, -1, -1):
            gates, given = h @ weights, table[x[t]]
            zr = _sigmoid(gates[:, :2 * hidden] + given[:, :2 * hidden])
            inner = gates[:, 2 * hidden:]
            c = np.tanh(given[:, 2 * hidden:] + zr[:, hidden:] * inner)
            if keep is not None:
                keep.append((t, h, zr, inner, c))
            h = c + zr[:, :hidden] * (h - c)
            out[t] = h
        return out

    def label(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of every byte, (length, rows, C)."""
        scores = self.states(0, x) @ self.outputs[0] + self.states(1, x) @ self.outputs[1] + self.bias
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        return scores

    def gradients(self, x: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over letter bytes, and its gradients by backpropagation through time."""
        kept: list[list] = [[], []]
        states = [self.states(side, x, kept[side]) for side in (0, 1)]
        scores = states[0] @ self.outputs[0] + states[1] @ self.outputs[1] + self.bias
        scores -= scores.max(axis=2, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=2, keepdims=True)
        weight = LETTER[x] / max(1, LETTER[x].sum())
        rows = np.arange(x.shape[1])
        loss = float(-(np.log(p[:, rows, target] + 1e-9) * weight).sum())
        p[:, rows, target] -= 1
        d = p * weight[:, :, None].astype(np.float32)
        tables, recurrent, outputs = [], [], []
        for side in (0, 1):
            w, hidden = self.recurrent[side], len(self.recurrent[side])
            outputs.append(np.tensordot(states[side], d, axes=([0, 1], [0, 1])))
            above, back = d @ self.outputs[side].T, np.zeros((x.shape[1], hidden), np.float32)
            d_table, d_w = np.zeros_like(self.tables[side]), np.zeros_like(w)
            for t, h, zr, inner, c in reversed(kept[side]):
                dh = above[t] + back
                z, r = zr[:, :hidden], zr[:, hidden:]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * inner * r * (1 - r)
                d_gates = np.concatenate([dz, dr, dc * r], axis=1)
                d_w += h.T @ d_gates
                back = dh * z + d_gates @ w.T
                np.add.at(d_table, x[t], np.concatenate([dz, dr, dc], axis=1))
            tables.append(d_table)
            recurrent.append(d_w)
        return loss, [*tables, *recurrent, *outputs, d.sum(axis=(0, 1))]


def train(samples: np.ndarray, targets: np.ndarray, languages: list[str], steps: int = STEPS) -> Network:
    """Adam over batches that hold every language alike. samples: rows of bytes."""
    net, rng = Network.fresh(languages), np.random.default_rng(7)
    if len(languages) < 2 or not len(samples):
        return net
    by = [np.flatnonzero(targets == k) for k in range(len(languages))]
    each = max(1, BATCH // len(languages))
    first, second = ([np.zeros_like(p) for p in net.parameters()] for _ in (0, 1))
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(b, each) for b in by])
        _, grads = net.gradients(np.ascontiguousarray(samples[rows].T), targets[rows])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * (1 - 0.9 * step / steps) * min(1.0, 1.0 / max(size, 1e-9))
        for p, g, m, v in zip(net.parameters(), grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(id_: Column) -> Column:
    """The documents that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(True))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> tuple:
    """Windows and languages of the training sample, bounded by per_language and the number of languages."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
    ).where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    rows = rows.where(F.col("text").rlike(ANY_LETTER))
    # Only distinct ids and languages are ranked.
    ids = rows.groupBy("lang", "doc_id").agg(F.min(~F.col("text").rlike(FULL_LETTERS)).alias("short"))
    picked = _first(ids, "doc_id", per_language, "short")
    chosen = rows.join(F.broadcast(picked.select("doc_id", "lang")), ["doc_id", "lang"])
    schema = pa.schema([("lang", pa.string()), ("window", pa.binary()), ("short", pa.bool_())])

    def task(batches):
        def cut():
            for lang, text in pairs(batches):
                parts = windows((text or "").encode().lower())
                letters = LETTER[parts].sum(axis=1)
                least = min(FULL, max(1, int(letters.max())))
                parts = parts[letters >= least] if least == FULL else parts[[int(letters.argmax())]]
                for i in np.unique(np.linspace(0, len(parts) - 1, SAMPLE_WINDOWS).astype(int)):
                    yield lang, parts[i].tobytes(), least < FULL

        return row_batches(cut(), schema)

    # An id that many rows share brings more windows than one document; the sample's bound holds all the same.
    found = chosen.select("lang", "text").mapInArrow(task, "lang string, window binary, short boolean").distinct()
    found = _first(found, "window", per_language * SAMPLE_WINDOWS, "short").collect()
    found.sort(key=lambda r: (r[0], bytes(r[1])))
    languages = sorted({r[0] for r in found})
    number = {lang: i for i, lang in enumerate(languages)}
    data = np.frombuffer(b"".join(bytes(r[1]) for r in found), np.uint8).reshape(-1, WINDOW)
    return data, np.array([number[r[0]] for r in found], np.int64), languages


def _first(rows: DataFrame, column: str, n: int, last: str | None = None) -> DataFrame:
    """The n rows of each language whose column has the smallest hashes; rows where `last` is true only after all others.

    Each task hands on n rows of a language at most, a tournament of MERGES groups n each, so the last
    task of a language reads MERGES * n rows at most, however hot it is.
    """
    for keys in (["lang", "part"], ["lang"]):
        if "part" in keys:
            rows = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
        order = Window.partitionBy(*keys).orderBy(*[last] * bool(last), F.xxhash64(column), column)
        rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).drop("n")
    return rows.drop("part")


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_language: int = SAMPLE_DOCS) -> Network:
    return train(*sample(docs, id_col, text_col, lang_col, per_language))


def pooled(net: Network, texts: list[str]) -> Iterator[tuple[str, float]]:
    """(language, mean probability) of each text."""
    data = [t.encode().lower() for t in texts]
    counts = [max(1, -(-len(d) // WINDOW)) for d in data]
    rows = np.concatenate([windows(d) for d in data])
    sums = np.zeros((len(rows), len(net.languages)), np.float64)
    for at in range(0, len(rows), 2048):
        part = np.ascontiguousarray(rows[at:at + 2048].T)
        sums[at:at + 2048] = np.einsum("trc,tr->rc", net.label(part), LETTER[part].astype(np.float32))
    letters, at = LETTER[rows].sum(axis=1), 0
    for text, n in zip(texts, counts):
        own, total = sums[at:at + n].sum(axis=0), int(letters[at:at + n].sum())
        at += n
        if not total or not any(map(str.isalpha, text)):
            yield UNKNOWN, 0.0
        else:
            best = int(np.argmax(own))
            yield net.languages[best], float(min(1.0, max(0.0, own[best] / total)))


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score; only the text is an input of a prediction."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def task(batches):
        def rows():
            for held in _by_size(pairs(batches), 1 << 20):
                if not net.languages:
                    yield from ((doc_id, UNKNOWN, 0.0) for doc_id, _ in held)
                    continue
                for (doc_id, _), found in zip(held, pooled(net, [t for _, t in held])):
                    yield doc_id, *found

        return row_batches(rows(), schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(task, "doc_id long, lang_pred string, score double")


def _by_size(rows, limit: int):
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[1]) + WINDOW
        if weight >= limit:
            yield held
            held, weight = [], 0
    if held:
        yield held


def keep_known(docs: DataFrame, net: Network, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is known with this score at least."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = []
        for held in _by_size(((0, t) for t in texts), 1 << 20):
            out += [s for _, s in pooled(net, [t for _, t in held])] if net.languages else [0.0] * len(held)
        return pd.Series(out, dtype="float64")

    return docs.where(score(F.coalesce(F.col(text_col), F.lit(""))) >= least)

"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is one valid last token: the token that ends
the prefix's encoding. It is found from shorter prefixes alone: a token t is
valid at the end of a prefix if the rest's last token and t may stand side by
side, that is, if no merge across their border comes before both are complete.
The table of last tokens encodes every prefix of the piece at once, so bytes
can be appended, or changed near the end, without touching what stands before.

A text is split by a pattern; each match is encoded separately, and each task
remembers the ids of matches it has met (bounded; forgetting changes only speed).

Defined cases: a null or empty text has no ids and decodes to no bytes;
repeated rows are encoded each; other columns are not read.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowferry.llm.common import id_and_text, pairs, row_batches


class Vocabulary:
    """Ranks of byte strings, as read from lines of base64 text and rank."""

    _open: dict[str, Vocabulary] = {}

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks))
        self._split: dict[int, tuple[int, int] | None] = {}
        self._edges: dict[int, tuple[list, list]] = {}
        self._fits: dict[int, bool] = {}

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        if path not in cls._open:
            with open(path, "rb") as lines:
                pairs_ = (line.split() for line in lines if line.strip())
                cls._open[path] = cls({base64.b64decode(t): int(r) for t, r in pairs_})
        return cls._open[path]

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the merge that makes this token from its bytes.

        None for single bytes, and (-1, -1) for tokens that merging never makes.
        """
        if token not in self._split:
            parts = [self.ranks[bytes([b])] for b in self.tokens[token]]
            last = None
            while len(parts) > 1:
                found = [
                    (r, i)
                    for i in range(len(parts) - 1)
                    if (r := self.ranks.get(self.tokens[parts[i]] + self.tokens[parts[i + 1]])) is not None
                ]
                if not found:
                    last = (-1, -1)
                    break
                rank, i = min(found)
                last = (parts[i], parts[i + 1])
                parts[i:i + 2] = [rank]
            self._split[token] = last
        return self._split[token]

    def whole(self, token: int) -> bool:
        """Whether merging the token's bytes makes the token."""
        return self.split(token) != (-1, -1)

    def edges(self, token: int) -> tuple[list[int], list[int]]:
        """The tokens at its left and right border while it is being made, single byte first."""
        if token not in self._edges:
            two = self.split(token)
            if two is None:
                self._edges[token] = ([token], [token])
            else:
                self._edges[token] = (self.edges(two[0])[0] + [token], self.edges(two[1])[1] + [token])
        return self._edges[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b stay apart when their bytes are merged together.

        Both borders are followed in order of rank; a merge across them that
        comes before the next merge on either side joins them. Of equal ranks
        the one further left comes first.
        """
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self._apart(self.edges(a)[1], self.edges(b)[0])
        return known

    def _apart(self, ends: list[int], starts: list[int]) -> bool:
        tokens, ranks, i, j = self.tokens, self.ranks, 0, 0
        while True:
            across = ranks.get(tokens[ends[i]] + tokens[starts[j]])
            left = ends[i + 1] if i + 1 < len(ends) else None
            right = starts[j + 1] if j + 1 < len(starts) else None
            if across is not None and (left is None or across < left) and (right is None or across <= right):
                return False
            if left is None and right is None:
                return True
            if right is None or (left is not None and left <= right):
                i += 1
            else:
                j += 1


class Prefixes:
    """A byte string with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; the table so far stays as it is."""
        v, at = self.vocabulary, len(self.data)
        self.data = data = self.data + more
        last, ranks, tokens = self.last, v.ranks, v.tokens
        for end in range(at + 1, len(data) + 1):
            for start in range(max(0, end - v.longest), end):
                token = ranks.get(data[start:end])
                if token is not None and v.whole(token) and (not start or v.fits(last[start - 1], token)):
                    last.append(token)
                    break

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put new bytes in place of data[start:end].

        Prefixes before start keep their entries. Behind the edit the entries
        are made anew until those of a stretch of the longest token's length
        are as before; from there on they depend on nothing that changed.
        """
        old_data, old_last, moved = self.data, self.last, start + len(new)
        tail = old_data[end:]
        self.data, self.last = old_data[:start], old_last[:start]
        self.append(new)
        same = 0
        for i in range(len(tail)):
            self.append(tail[i:i + 1])
            same = same + 1 if self.last[-1] == old_last[end + i] else 0
            if same >= self.vocabulary.longest and i + 1 < len(tail):
                self.data += tail[i + 1:]
                self.last += old_last[end + i + 1:]
                break
        assert len(self.last) == len(self.data) == moved + len(tail)

    def ids(self, end: int | None = None) -> list[int]:
        """The encoding of the prefix of this many bytes, of all by default."""
        out, at = [], len(self.data) if end is None else end
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.tokens[self.last[at - 1]])
        return out[::-1]


def encode_piece(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """One match of the pattern: the token of exactly these bytes if there is one, else by prefixes."""
    token = vocabulary.ranks.get(piece)
    return [token] if token is not None else Prefixes(vocabulary, piece).ids()


class TextEncoder:
    """Whole texts to ids, as little-endian unsigned 32-bit integers."""

    _open: dict[tuple[str, str], TextEncoder] = {}

    def __init__(self, path: str, pattern: str, keep: int = 500_000):
        import regex

        self.vocabulary, self.find = Vocabulary.of(path), regex.compile(pattern).findall
        self.keep, self.seen = keep, {}

    @classmethod
    def of(cls, path: str, pattern: str) -> TextEncoder:
        if (path, pattern) not in cls._open:
            cls._open[path, pattern] = cls(path, pattern)
        return cls._open[path, pattern]

    def __call__(self, text: str) -> bytes:
        seen, pieces = self.seen, self.find(text)
        got = [seen.get(p) for p in pieces]
        if None in got:
            if len(seen) > self.keep:
                seen.clear()
            for i, (piece, ids) in enumerate(zip(pieces, got)):
                if ids is None:
                    if (ids := seen.get(piece)) is None:
                        made = encode_piece(self.vocabulary, piece.encode())
                        ids = b"".join([t.to_bytes(4, "little") for t in made])
                        if len(piece) <= 64:
                            seen[piece] = ids
                    got[i] = ids
        return b"".join(got)


def encode(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit); both paths and pattern reach all executors."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def task(batches):
        encoder = TextEncoder.of(vocabulary, pattern)
        rows = ((doc_id, encoder(text)) for doc_id, text in pairs(batches))
        return row_batches(rows, schema, lambda r: len(r[1]) + 64)

    return id_and_text(docs, id_col, text_col).mapInArrow(task, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids and data, the bytes that the ids stand for."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("data", pa.binary())])

    def task(batches):
        import numpy as np

        token = Vocabulary.of(vocabulary).tokens.__getitem__
        rows = (
            (doc_id, ids, b"".join(map(token, np.frombuffer(ids, "<u4").tolist())))
            for doc_id, ids in pairs(batches)
        )
        return row_batches(rows, schema, lambda r: len(r[1]) + len(r[2]) + 64)

    return encoded.select(F.col("doc_id"), F.col("ids")).mapInArrow(
        task, "doc_id long, ids binary, data binary"
    )

"""SentencePiece encoding that keeps track of where every piece comes from.

A model file holds pieces with scores and a compiled character map, a
double-array trie. A text is normalised by the longest prefix that the map
knows, and every normalised byte remembers the source byte that its prefix
began at. The best-scored neighbours are merged until none is left; a piece's
normalised bytes then lead back to its span of bytes of the source.

No piece goes on over the border before a run of spaces or over a control
character that no piece has (looked up when a model is read), so a text is merged stretch by stretch,
and each task remembers the stretches it has met (bounded; forgetting changes
only speed). Where a model has pieces over such borders, the whole text is one
stretch.

Defined cases: a null or empty text has its begin and end ids alone and decodes
to no text; characters without a piece become byte pieces, or the unknown id
where the model has none; of a character in byte pieces the last one has its
span, the others empty spans before it; repeated rows are encoded each; other
columns are not read.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowferry.errors import ConfigError
from rowferry.llm.common import Remembered, id_and_text, in_parts, pairs, row_batches

SPACE = "▁"
#: Fixed values of the model format: kinds of pieces, and the surface of the unknown id.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
UNKNOWN_SURFACE = " ⁇ "
#: Longer stretches (in characters) are merged by a heap, and not remembered.
SHORT = 48
NEVER = float("inf")
#: Characters of text that a task encodes at a time.
TEXT_PART = 400_000


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at:at + size]
        at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled double-array trie; an empty one changes nothing.

    The blob is the size of the trie in bytes, its 32-bit units, and the
    replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.texts = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of data[at:] and what replaces it."""
        if not self.units:
            return None
        found, unit, node = None, self.units[0], 0
        node ^= (unit >> 10) << ((unit & 512) >> 6)
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(self.units) or (unit := self.units[node]) & 0x800000FF != data[end]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = end + 1 - at, self.texts[start:self.texts.index(b"\0", start)]
        return found


class Model:
    """Pieces, scores and rules of normalisation of a BPE model file."""

    _open: dict[str, Model] = {}

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.costs: dict[str, float] = {}
        trainer, normal = {}, {}
        for field, value in wire_fields(data):
            if field == 1:
                self._add(dict(wire_fields(value)))
            elif field == 2:
                trainer = dict(wire_fields(value))
            elif field == 3:
                normal = dict(wire_fields(value))
        if trainer.get(3, 1) != 2 or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or trainer.get(24) or not normal.get(5, 1):
            raise ConfigError("only BPE models of normal, control and byte pieces, spaces leading and escaped, are read")
        self.ids = {p: i for i, p in enumerate(self.pieces)}
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.byte_ids = {b: i for i, b in self.bytes.items()} if trainer.get(35) else {}
        self.begin, self.end = (self.ids[trainer.get(k, d).decode()] for k, d in ((46, b"<s>"), (47, b"</s>")))
        self.map = CharacterMap(normal.get(2, b""))
        self.prefix, self.squeeze = (bool(normal.get(k, 1)) for k in (3, 4))
        lonely = "".join(c for c in map(chr, range(32)) if not any(c in p for p in self.costs))
        crossing = any(SPACE in p.lstrip(SPACE) for p in self.costs)
        self.letters = {c for p in self.costs if len(p) == 1 for c in (p, " " if p == SPACE else p)}
        self.of_letter = np.zeros(0x110000, np.int64)
        for c in self.letters:
            self.of_letter[ord(c)] = self.ids[SPACE if c == " " else c]
        self.cost_of = np.array([self.costs.get(p, NEVER) for p in self.pieces])
        self.pairs = self._pairs()
        self.stretches = re.compile(
            ".+" if crossing else f"[ {SPACE}]*[^ {SPACE}{lonely}]+|[ {SPACE}]+|.", re.S
        )

    def _add(self, piece: dict) -> None:
        name, kind = piece[1].decode(), piece.get(3, NORMAL)
        if kind == NORMAL:
            self.costs[name] = -struct.unpack("<f", piece.get(2, bytes(4)))[0]
        self.pieces.append(name)
        self.kinds.append(kind)

    @classmethod
    def of(cls, path: str) -> Model:
        if path not in cls._open:
            with open(path, "rb") as file:
                cls._open[path] = cls(file.read())
        return cls._open[path]

    def normalise(self, text: str) -> tuple[str, np.ndarray | None]:
        """The normalised text, spaces not yet escaped, and for each of its bytes and its end the source byte it comes from.

        Without a map and squeezing that is each byte itself behind the leading space: None.
        """
        if not self.map.units and not self.squeeze:
            return (" " + text if self.prefix and text else text), None
        return self.mapped(text.encode())

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        found = self.map.longest(data, at)
        if found:
            return found
        size = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
        return size, data[at:at + size]

    def mapped(self, data: bytes) -> tuple[str, np.ndarray]:
        out, origin, at = bytearray(), [], 0
        while self.squeeze and at < len(data):
            size, text = self._prefix(data, at)
            if text != b" ":
                break
            at += size
        if at == len(data):
            return "", np.array([at])
        if self.prefix:
            out += b" "
            origin.append(at)
        after_space = self.squeeze
        while at < len(data):
            size, text = self._prefix(data, at)
            text = text.lstrip(b" ") if after_space else text
            if text:
                out += text
                origin += [at] * len(text)
                after_space = self.squeeze and text.endswith(b" ")
            at += size
        while self.squeeze and out.endswith(b" "):
            out.pop()
            at = origin.pop()
        return out.decode(), np.array([*origin, at])

    def merged(self, stretch: str) -> list[str]:
        """A stretch in pieces: the best-scored neighbours first, of equal ones the leftmost."""
        parts, cost = list(stretch), self.costs.get
        if len(parts) > SHORT:
            return self._merged_by_heap(parts)
        costs = [cost(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) < NEVER:
            i = costs.index(least)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], NEVER)
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], NEVER)
        return parts

    def _merged_by_heap(self, parts: list[str]) -> list[str]:
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def offer(left: int, right: int) -> None:
            pair = parts[left] + parts[right]
            if (known := self.costs.get(pair)) is not None:
                heapq.heappush(heap, (known, left, right, pair))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, pair = heapq.heappop(heap)
            if not parts[left] or not parts[right] or len(parts[left]) + len(parts[right]) != len(pair):
                continue  # one of them has been merged since
            parts[left], parts[right] = pair, ""
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [p for p in parts if p]

    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Every two pieces that make a piece, as one sorted number, and the piece they make."""
        ids, base, keys, made = self.ids, len(self.pieces), [], []
        for piece in self.costs:
            for at in range(1, len(piece)):
                if piece[:at] in self.costs and piece[at:] in self.costs:
                    keys.append(ids[piece[:at]] * base + ids[piece[at:]])
                    made.append(ids[piece])
        order = np.argsort(keys)
        return np.array([*keys, -1], np.int64)[[*order, -1]], np.array([*made, 0], np.int64)[[*order, -1]]

    def numbered_all(self, stretches: list[str]) -> list[bytes]:
        """``numbered`` of many stretches: those whose characters all are pieces are merged side by side."""
        out, plain = {}, []
        for stretch in stretches:
            if len(stretch) <= SHORT and self.letters.issuperset(stretch):
                plain.append(stretch)
            else:
                out[stretch] = self.numbered(stretch)
        plain.sort(key=len)
        for at in range(0, len(plain), 4096):
            part = plain[at:at + 4096]
            out.update(zip(part, self._side_by_side(part)))
        return [out[s] for s in stretches]

    def _side_by_side(self, stretches: list[str]) -> list[bytes]:
        """Each round makes the best merge of every stretch; arrays go over the characters of all of them."""
        lengths = np.fromiter(map(len, stretches), np.int64, len(stretches))
        code = np.frombuffer("".join(stretches).encode("utf-32-le"), "<u4")
        symbol = self.of_letter[code]
        n, first = len(symbol), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        owner = np.repeat(np.arange(len(stretches)), lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[first[1:] - 1], after[-1] = n, n
        before[first] = -1
        cost, made, alive = np.full(n + 1, NEVER), np.zeros(n + 1, np.int64), np.ones(n, bool)

        def weigh(left: np.ndarray) -> None:
            """What merging these symbols with the next ones costs and makes."""
            left = left[after[left] < n]
            key = symbol[left] * len(self.pieces) + symbol[after[left]]
            at = np.minimum(np.searchsorted(self.pairs[0][:-1], key), len(self.pairs[0]) - 1)
            known = self.pairs[0][at] == key
            made[left] = self.pairs[1][at]
            cost[left] = np.where(known, self.cost_of[made[left]], NEVER)

        weigh(np.arange(n))
        while True:
            best = np.minimum.reduceat(cost[:-1], first)
            hits = np.flatnonzero((cost[:-1] == best[owner]) & (cost[:-1] < NEVER))
            if not len(hits):
                break
            left = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]  # of equal ones the leftmost
            right = after[left]
            symbol[left], after[left] = made[left], after[right]
            alive[right], cost[right], cost[left] = False, NEVER, NEVER
            follows = after[left] < n
            before[after[left][follows]] = left[follows]
            weigh(np.concatenate([left, before[left][before[left] >= 0]]))
        kept = np.flatnonzero(alive)
        width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        both = np.stack([symbol[kept], np.add.reduceat(width, kept)], axis=1).astype("<u4").tobytes()
        ends = (8 * np.cumsum(np.bincount(owner[kept], minlength=len(stretches)))).tolist()
        return [both[a:b] for a, b in zip([0, *ends], ends)]

    def numbered(self, stretch: str) -> bytes:
        """The ids of a stretch, each with the bytes of the stretch it takes up, as 32-bit integers."""
        out, at, plain = [], 0, SPACE not in stretch
        for piece in self.merged(stretch.replace(" ", SPACE)):
            own = piece.replace(SPACE, " ") if plain else stretch[at:at + len(piece)]
            at, data = at + len(piece), own.encode()
            if piece in self.costs:
                out += (self.ids[piece], len(data))
            elif self.byte_ids:
                ids = [self.byte_ids[b] for b in piece.encode()]
                for i in ids[:-1]:
                    out += (i, 0)
                out += (ids[-1], len(data))
            else:
                out += (self.unknown, len(data))
        return struct.pack(f"<{len(out)}I", *out)


class PieceEncoder:
    """Whole texts to ids and spans."""

    _open: dict[str, PieceEncoder] = {}

    def __init__(self, path: str, keep: int = 500_000):
        self.model = Model.of(path)
        self.seen = Remembered(self.model.numbered, keep)

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first bytes, bytes behind the last) of all pieces of each text, begin and end ids included."""
        shown = [self.model.normalise(t) for t in texts]
        lists = [self.model.stretches.findall(s) for s, _ in shown]
        fresh = list(set(chain.from_iterable(lists)).difference(self.seen))
        self.seen.update(zip(fresh, self.model.numbered_all(fresh)))
        out = [self._placed(b"".join(self.seen.of(own)), *s, t) for own, s, t in zip(lists, shown, texts)]
        for stretch in fresh:
            if len(stretch) > SHORT:
                self.seen.pop(stretch, None)
        return out

    def _placed(self, data: bytes, shown: str, origin: np.ndarray | None, text: str):
        model, found = self.model, np.frombuffer(data, "<u4").reshape(-1, 2)
        ids, sizes = found[:, 0], found[:, 1]
        if not model.byte_ids and len(ids):  # neighbours without a piece are one
            again = (ids[1:] == model.unknown) & (ids[:-1] == model.unknown)
            first = np.flatnonzero(np.append(True, ~again))
            ids, sizes = ids[first], np.add.reduceat(sizes, first)
        out = np.empty((3, len(ids) + 2), "<u4")
        out[0, 0], out[0, 1:-1], out[0, -1] = model.begin, ids, model.end
        bounds = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=bounds[1:])
        if origin is not None:
            bounds = origin[bounds]
        elif len(shown) > len(text):  # the leading space comes from no byte
            bounds[1:] -= 1
        out[1:, 0], out[1, 1:-1], out[2, 1:-1], out[1:, -1] = 0, bounds[:-1], bounds[1:], bounds[-1]
        return tuple(out)


class PieceDecoder:
    """Ids to text: byte pieces in a row are one string of bytes, broken ones become U+FFFD."""

    _open: dict[str, PieceDecoder] = {}

    def __init__(self, path: str):
        self.model = m = Model.of(path)
        self.controls = {i for i, kind in enumerate(m.kinds) if kind == CONTROL}
        self.surface = [p.replace(SPACE, " ").encode() for p in m.pieces]
        for i, kind in enumerate(m.kinds):
            if kind == CONTROL:
                self.surface[i] = b""
            elif kind == UNKNOWN:
                self.surface[i] = UNKNOWN_SURFACE.encode()
            elif kind == BYTE:
                self.surface[i] = bytes([m.bytes[i]])

    @classmethod
    def of(cls, path: str) -> PieceDecoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __call__(self, ids: list[int]) -> bytes:
        m = self.model
        first = next((i for i in ids if m.kinds[i] != CONTROL), None)
        lead = first is not None and (m.prefix or m.squeeze) and m.pieces[first].startswith(SPACE)
        data = b"".join(map(self.surface.__getitem__, ids))
        if not self.controls.isdisjoint(ids[1:-1]) or not _valid(data):  # a control id ends a run of bytes
            data = self._mended(ids)
        return data[1:] if lead else data

    def _mended(self, ids: list[int]) -> bytes:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.model.bytes:
                run.append(self.model.bytes[i])
                continue
            while run:
                size = next((n for n in range(1, min(4, len(run)) + 1) if _valid(run[:n])), 0)
                out.append(bytes(run[:size]) if size else "�".encode())
                del run[:size or 1]
            if i is not None:
                out.append(self.surface[i])
        return b"".join(out)


def _valid(data: bytes) -> bool:
    try:
        data.decode()
        return True
    except UnicodeDecodeError:
        return False


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with ids, begins and ends (binary, little-endian unsigned 32-bit).

    Piece i is bytes begins[i] up to ends[i] of the text in UTF-8. model is the
    path of a model file that all executors can read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("begins", pa.binary()), ("ends", pa.binary())])

    def task(batches):
        encoder = PieceEncoder.of(model)

        def rows():
            for held in in_parts(pairs(batches), lambda row: len(row[1]), TEXT_PART):
                for (doc_id, _), found in zip(held, encoder([t for _, t in held])):
                    yield doc_id, *(a.tobytes() for a in found)

        return row_batches(rows(), schema, lambda r: 3 * len(r[1]) + 64)

    return id_and_text(docs, id_col, text_col).mapInArrow(task, "doc_id long, ids binary, begins binary, ends binary")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """The encoded rows with data, the bytes of the text that their ids stand for; null ids give null."""

    def task(batches):
        decoder = PieceDecoder.of(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = part.column(part.schema.get_field_index(ids_col)).to_pylist()
                data = [None if i is None else decoder(np.frombuffer(i, "<u4").tolist()) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(data, pa.binary())], names=[*part.schema.names, "data"]
                )

    return encoded.mapInArrow(task, T.StructType([*encoded.schema.fields, T.StructField("data", T.BinaryType())]))

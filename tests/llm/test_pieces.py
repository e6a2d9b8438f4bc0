"""SentencePiece encoding against the library, and its character map against hand-made tries."""

import random

import numpy as np
import sentencepiece

from rowferry.llm import pieces, queries

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)
PARTS = [
    "a", "the", " ", "  ", "▁", "\n", "\t", "é", "漢", "\U0001f600", "\0", "�", "<s>", "<0x0A>", "<unk>",
    "ing", "́", "\r", "1", "'", " ⁇ ", "", "Zürich", "word word",
]


def _texts(n):
    pick = random.Random(3)
    return ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 30))) for _ in range(n)]


def test_ids_spans_and_text_as_the_library():
    encode, decode = pieces.PieceEncoder.of(queries.PIECE_BPE), pieces.PieceDecoder.of(queries.PIECE_BPE)
    for text in [*_texts(3000), "", " ", "word " * 20000, "x" * 5000, "漢字" * 3000, " " * 9000]:
        ids, begins, ends = encode([text])[0]
        assert ids.tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)
        spans = [(p.id, p.begin, p.end) for p in LIBRARY.encode(text, return_type="proto").pieces]
        assert list(zip(ids.tolist(), begins.tolist(), ends.tolist()))[1:-1] == spans
        assert decode(ids.tolist()).decode() == LIBRARY.decode(ids.tolist()) == text.replace("▁", " ")
        covered = [bytes(text.encode()[b:e]) for b, e in zip(begins.tolist(), ends.tolist())]
        assert b"".join(covered) == text.encode()


def test_any_ids_decode_as_the_library():
    decode, pick = pieces.PieceDecoder.of(queries.PIECE_BPE), random.Random(5)
    for _ in range(5000):
        ids = [pick.choice([0, 1, 2, 29871, pick.randint(3, 258), pick.randint(131, 258), pick.randint(259, 31999)]) for _ in range(8)]
        assert decode(ids).decode() == LIBRARY.decode(ids)


def _trie(words):
    """A double array of the words, each with the place of its replacement: nodes are placed at free multiples of 256."""
    units, texts, children = {}, b"", {b"": set()}
    for word in words:
        for i in range(len(word)):
            children.setdefault(word[:i], set()).add(word[i])
        children.setdefault(word, set())
    places, free = {b"": 0}, 0
    for prefix in sorted(children, key=len):
        at = places[prefix]
        free += 256
        base = free
        shift = at ^ base
        own = units.get(at, 0) & 0xFF
        assert shift < 1 << 21
        units[at] = shift << 10 | own
        if prefix in words:
            units[at] |= 1 << 8
            units[base] = 1 << 31 | len(texts)
            texts += words[prefix] + b"\0"
        for byte in children[prefix]:
            places[prefix + bytes([byte])] = base ^ byte
            units[base ^ byte] = byte
    array = np.zeros(free + 256, "<u4")
    for at, unit in units.items():
        array[at] = unit
    return len(array.tobytes()).to_bytes(4, "little") + array.tobytes() + texts


def test_longest_prefix_and_its_source():
    words = {b"a": b"A", b"abc": b"xyz", "é".encode(): b"e", b"\t": b" ", "　".encode(): b" ", b"q": b""}
    table = pieces.CharacterMap(_trie(words))
    assert table.longest(b"zabcd", 1) == (3, b"xyz") and table.longest(b"abd", 0) == (1, b"A") and table.longest(b"z", 0) is None
    model = pieces.Model.of(queries.PIECE_BPE)
    own = object.__new__(pieces.Model)
    own.__dict__ = {**model.__dict__, "map": table}
    text, origin = own.normalise("abé\tqabc\U0001f600")
    assert text == " Abe xyz\U0001f600"
    assert origin.tolist() == [0, 0, 1, 2, 4, 6, 6, 6, 9, 9, 9, 9, 13]
    own.squeeze = True
    text, origin = own.normalise(" \t a 　 b  ")
    assert text == " A b" and origin.tolist() == [3, 3, 4, 9, 10]
    assert own.normalise(" \t ")[0] == "" and own.normalise("")[0] == ""
    own.squeeze, own.map = False, pieces.CharacterMap(b"")
    for text in filter(None, _texts(300)):
        plain, mapped = own.normalise(text), own.mapped(text.encode())
        starts = [len(text[:i].encode()) for i, c in enumerate(text) for _ in c.encode()]
        assert plain == (mapped[0], None) and mapped[1].tolist() == [0, *starts, len(text.encode())]


def test_short_and_long_stretches_are_merged_alike():
    model = pieces.Model.of(queries.PIECE_BPE)
    for text in _texts(2000):
        stretch = text.replace(" ", "▁")
        if len(stretch) <= pieces.SHORT:
            assert model._merged_by_heap(list(stretch)) == model.merged(stretch)
    many = [t for text in _texts(500) for t in model.stretches.findall(" " + text)]
    assert model.numbered_all(many) == list(map(model.numbered, many)) and model.numbered_all([]) == []


def test_tables(spark):
    texts = [None, "", " a  b ", "same", "same", "word " * 30000]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, data int")
    out = pieces.decode(pieces.encode(docs, queries.PIECE_BPE), queries.PIECE_BPE).collect()
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.data.decode()) for r in out}
    assert got == {i: (LIBRARY.encode(t or "", add_bos=True, add_eos=True), t or "") for i, t in enumerate(texts)}
    assert pieces.encode(docs.where("false"), queries.PIECE_BPE).count() == 0

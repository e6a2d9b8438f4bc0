"""The operators of the training-data pipeline against brute force, round trips and edge cases."""

import base64
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from conftest import SF
from oracle import duck, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rowferry.llm import bpe, idstore, importance, langid, neighbours, packing, pii, queries, rules, simhash, warc
from rowferry.scratch import scratch_path

ODD = [
    (1, "One two three four. " * 30, "en"), (1, "One two three four. " * 30, "en"), (None, "no id here", None),
    (2, None, "en"), (3, "", None), (4, " \n\t ", "de"), (5, "word " * 60000, "en"), (6, "a", "en"),
    (7, "\u00e9t\u00e9 \u6f22\u5b57 \U0001f600 it's", "fr"), (-8, "mail me: bob@example.com, +1 (487) 555-7209", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, repeats, ties, empty and long texts, and columns with the names that operators use."""
    data = [(*r, "x", 1, i, "p", 0.5, "q", 7) for i, r in enumerate(ODD)]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, n_chars long, print long, ids string, "
        "score double, kept string, root int",
    )


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    got = queries.QUERIES[name](spark, SF)
    cur = duck(SF).execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    want = rows(columns, cur.fetchall())
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want


def test_warc(spark):
    pages = spark.createDataFrame(
        [(1, "http://a", "x\r\n\r\ny"), (2, None, "x\r\n\r\ny"), (3, "http://c\r\nd", None), (4, "u", ""), (5, "u", "\u00e9"), (5, "u", "\u00e9")],
        "page_id long, url string, html string",
    )
    path = scratch_path(spark, "t")
    warc.write_archives(pages, path)
    read = warc.read_archives(spark, path)
    got = sorted(tuple(r) for r in warc.resolved(read).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    assert got == [(1, 6, "revisit", 2), (2, 6, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 2, "response", None), (5, 2, "revisit", 5)]
    assert {r.payload for r in read.collect()} == {None, "x\r\n\r\ny", "", "\u00e9"}
    empty = scratch_path(spark, "t")
    warc.write_archives(pages.where("false"), empty)
    assert warc.resolved(warc.read_archives(spark, empty)).count() == 0


def test_byte_bpe(spark, odd, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(queries.BYTE_BPE, "rb"))}
    other = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    done = bpe.decode(bpe.encode(odd, queries.BYTE_BPE, public_tokenizers.PATTERN), queries.BYTE_BPE).collect()
    want = sorted((t or "", other.encode_ordinary(t or "")) for _, t, _ in ODD)
    assert sorted((bytes(r.data).decode(), np.frombuffer(r.ids, "<u4").tolist()) for r in done) == want
    assert bpe.encode(none, queries.BYTE_BPE, public_tokenizers.PATTERN).count() == 0
    words = bpe.Prefixes(bpe.Vocabulary.of(queries.BYTE_BPE), b"unbelievable encodings")
    words.replace(3, 9, b"abc")
    assert words.last == bpe.Prefixes(words.vocabulary, words.data).last
    assert words.ids() == other._encode_single_piece(words.data)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    data = [(i, rng.normal(size=5).tolist()) for i in range(60)] + [(100 + i, [1.0] * 5) for i in range(40)]
    data += [(200, None), (220, [0.0] * 5), (240, [float("nan")] * 5), (260, [1.0, None, 1.0, 1.0, 1.0]), (None, [1.0] * 5)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    good = [(i, np.array(v)) for i, v in data[:100]]
    want = {}
    for q, v in good:
        if q % 20 == 0:
            near = sorted((-float(np.cumsum(v * w)[-1]), i) for i, w in good if i != q)[:20]
            want[q] = [(i, -s) for s, i in near]
    old = neighbours.CANDIDATE_BLOCK, neighbours.QUERY_BLOCK
    neighbours.CANDIDATE_BLOCK, neighbours.QUERY_BLOCK = 4, 3  # many tiles, and two rounds of merging
    try:
        got = {}
        for r in neighbours.nearest(table, "vec_id % 20 = 0").orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    finally:
        neighbours.CANDIDATE_BLOCK, neighbours.QUERY_BLOCK = old
    assert got == want
    assert neighbours.nearest(table.where("false"), "vec_id % 20 = 0").count() == 0


def _library():
    t = Tokenizer.from_file(queries.WORD_BPE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_packing(spark, odd, none):
    encode = _library()
    found = packing.pack(odd, queries.WORD_BPE).collect()
    by_sequence, by_doc = {}, {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length * 4 == len(r.ids)
            at += r.length
        assert at <= r.padded_length <= packing.CAPACITY
    for doc_id, text, _ in ODD:
        if doc_id != 1:
            ids = b"".join(bytes(r.ids) for r in sorted(by_doc[doc_id], key=lambda r: r.start))
            assert np.frombuffer(ids, "<u4").tolist() == encode(text) + [2]
    assert all(len(r.ids) == 4 * 4096 or len(r.ids) & (len(r.ids) - 1) == 0 for r in packing.sequences(packing.pack(odd, queries.WORD_BPE)).collect())
    assert packing.pack(none, queries.WORD_BPE).count() == 0
    sizes = np.random.default_rng(2).integers(1, 4096, 500).tolist()
    dealt = packing.windows_of(sizes, 4096)
    assert sorted(i for w in dealt for i in w) == list(range(500)) and max(sum(sizes[i] for i in w) for w in dealt) <= 4096


def test_id_store(spark, odd, none):
    encode, path = _library(), scratch_path(spark, "t")
    idstore.write_ids(odd, path, queries.WORD_BPE, block_ids=50)
    read = idstore.read_shards(spark, path)
    sizes = idstore.block_sizes(spark, path)
    got = read.join(idstore.starts(sizes), ["shard", "block"]).selectExpr("doc_id", "base + block_start as start", "ids").collect()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += len(r.ids) // 4
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((d for d, _, _ in ODD), key=lambda d: (d is not None, d or 0))
    want = sorted((d or 0, zlib.crc32(np.array(encode(t) + [1], "<u4").tobytes())) for d, t, _ in ODD)
    assert sorted((r.doc_id or 0, zlib.crc32(r.ids)) for r in got) == want
    idstore.write_index(spark, path)
    asked = spark.createDataFrame([(5,), (999,), (None,), (1,)], "doc_id long")
    assert sorted(r.doc_id for r in idstore.lookup(spark, path, asked).collect()) == [1, 1, 5]
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 3000)
    assert sorted(idstore.PerfectHash.build(keys).slots(keys).tolist()) == list(range(3000))
    path = scratch_path(spark, "t")
    idstore.write_ids(none, path, queries.WORD_BPE)
    assert idstore.read_shards(spark, path).count() == 0


def test_language(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.fit(docs)
    found = langid.predict(docs, net).withColumn("held_out", langid.held_out(F.col("doc_id"))).join(docs.select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert np.mean([r.lang == r.lang_pred for r in test]) > 0.95
    by = {r.doc_id: r for r in langid.predict(odd, net).collect()}
    assert [by[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and all(0 <= r.score <= 1 for r in by.values())
    empty = langid.fit(none)
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}
    # Slopes of the loss against differences.
    shared = spark.range(400).selectExpr("0L doc_id", "concat(repeat(concat('row ', id, ' of one id '), 20)) text", "'en' lang")
    assert len(langid.sample(shared, "doc_id", "text", "lang", 3)[0]) == 3 * langid.SAMPLE_WINDOWS
    small = langid.Network.fresh(["a", "b"], 3)
    for part in (small.tables, small.recurrent, small.outputs):
        part[:] = [p.astype(np.float64) for p in part]
    x = np.random.default_rng(0).integers(97, 123, (6, 4)).astype(np.uint8)
    y = np.array([0, 1, 0, 1])
    for p, g in list(zip(small.parameters(), small.gradients(x, y)[1]))[2:6]:
        p[0, 0] += 1e-4
        up = small.gradients(x, y)[0]
        p[0, 0] -= 2e-4
        assert abs((up - small.gradients(x, y)[0]) / 2e-4 - g[0, 0]) < 1e-3
        p[0, 0] += 1e-4


def test_language_sample_is_the_same_however_rows_are_dealt(spark):
    """A hot language over many partitions; the rounds keep what one ranking would."""
    ids = spark.range(4000).select(F.when(F.col("id") % 10 < 8, "en").otherwise("de").alias("lang"), F.col("id").alias("doc_id"))
    hashed = ids.withColumn("h", F.xxhash64("doc_id")).collect()
    expected = {(lang, r.doc_id) for lang in ("en", "de") for r in sorted((r for r in hashed if r.lang == lang), key=lambda r: r.h)[:30]}
    for n in (1, 37):
        kept = [tuple(r) for r in langid._first(ids.repartition(n), "doc_id", 30).collect()]
        assert len(kept) == 60 and set(kept) == expected


def test_personal_data(spark, odd, none):
    text = "x@y.z a@b @c.d@e.f +12 345-678 (9)0 k 1.2.3.256 k 1.2.3.4.5 k 4111 1111-1111 1111 k 4111111111111112 +1"
    mail = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    want = [("email", *m.span()) for m in re.finditer(mail, text)]
    want += [(k, text.index(t), text.index(t) + len(t)) for k, t in (
        ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+12 345-678 (9)0"))]
    assert pii.base_spans(text) == want and len(want) == 5
    assert pii.find(odd).count() == len(ODD) and pii.find(none).count() == 0
    lines = [(i, f"please call me under +1 487 555 72{i:02d} today") for i in range(20)]
    lines += [(50, "please call me under 487 555 7299 today"), (51, "exactly 487 555 7298 things")]
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert found[50] == "phone:21:33" and found[51] == "" and found[3] == "phone:21:36"
    hidden = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert hidden[50] == "please call me under [PHONE] today"
    masked = pii.mask(odd)
    assert masked.columns == odd.columns and masked.count() == len(ODD)


def test_importance(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    got = importance.resample(odd, labels, share=0.5).collect()
    assert sum(r.kept for r in got) == 5 and len(got) == len(ODD)
    assert min(r.noisy_weight for r in got if r.kept) >= max(r.noisy_weight for r in got if not r.kept)
    assert {r.log_weight for r in got if r.doc_id in (2, 3, 4)} == {0.0}
    assert all(r.kept for r in importance.resample(odd, labels.where("false")).collect())
    assert importance.resample(none, labels).count() == 0


def test_rules(odd, none):
    got = {r.doc_id: r for r in rules.quality(odd).collect()}
    assert got[1].n_repeat_words == 120 and got[1].base_failed and not got[2].kept and got[4].n_words == 0
    assert got[5].n_words == 60000 and rules.quality(none).count() == 0
    assert rules.keep_good(odd).columns == odd.columns


def _brute_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, odd, none):
    rng = np.random.default_rng(5)
    bases = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = {int(b) for b in bases}
    for b in bases.tolist():
        for _ in range(12):
            b ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False))
            prints.add(b)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    up = list(range(len(prints)))
    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    want = {}
    for i, p in enumerate(signed):
        want.setdefault(root(i), set()).add(p)
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    got = {p: {p} for p in signed}
    classes = {}
    for r in simhash.components(simhash.links(frame, chunk=8)).collect():
        classes.setdefault(r.root, {r.root}).add(r.node)
    for c in classes.values():
        for p in c:
            got[p] = c
    assert {frozenset(c) for c in got.values()} == {frozenset(c) for c in want.values()}

    found = simhash.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(ODD) and {by[i].component_id for i in (2, 3, 4)} == {2}
    assert {d: by[d].print & (1 << 64) - 1 for d in by} == {d: _brute_print(t) for d, t, _ in ODD}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [-8, 0, 1, 2, 5, 6, 7]
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_pipeline(spark, odd, none):
    docs = odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, none, SF).count()
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            docs = out.cache()
    assert out.selectExpr("sum(length)").first()[0] > 0


def test_sha1_base32(spark):
    df = spark.createDataFrame([("",), ("abc",)], "p string")
    got = [r[0] for r in df.select(warc.base32_sha1(df.p)).collect()]
    assert got == [base64.b32encode(hashlib.sha1(x).digest()).decode() for x in (b"", b"abc")]

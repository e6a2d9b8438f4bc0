"""Rows that share ids, payloads or vectors, against the SQL twins."""

import duckdb
import pytest
from oracle import rows

from rowferry.llm import pii, queries, warc
from rowferry.scratch import scratch_path


def against_twin(spark, folder, name, table, frame):
    frame.write.parquet(f"{folder}/{table}.parquet")
    got = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet/*.parquet')")
    cur = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, cur.fetchall())


def test_nearest_keeps_every_vector_of_an_id(spark, folder):
    data = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [9.0, 9.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 2.0])]
    data += [(100 + i % 7, [float(i % 5), float(-i)]) for i in range(60)] + [(40, [3.0, 1.0])] * 3
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5)
    against_twin(spark, folder, "op3_nearest", "embeddings", frame)


def test_archives_of_repeated_rows(spark, folder):
    data = [(i % 9, f"http://u/{i % 2}", f"payload {i % 4}") for i in range(80)] + [(None, None, "payload 1"), (None, None, "alone")]
    frame = spark.createDataFrame(data, "page_id long, url string, html string").repartition(6)
    against_twin(spark, folder, "op1_warc", "pages", frame)
    path = scratch_path(spark, "t")
    warc.write_archives(frame, path)
    read = warc.read_archives(spark, path).collect()
    assert len({r.record_id for r in read}) == len(read) == 82
    ids = {r.record_id: r for r in read if r.record_type == "response"}
    assert len(ids) == 5
    assert all(ids[r.refers_to_record].stated_digest == r.stated_digest for r in read if r.record_type == "revisit")


def test_dates_are_utc(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
    try:
        path = scratch_path(spark, "t")
        warc.write_archives(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), path)
        now = spark.sql("select date_format(to_utc_timestamp(now(), current_timezone()), \"yyyy-MM-dd'T'HH\")").first()[0]
        data = spark.read.format("binaryFile").load(path).first().content
        assert f"WARC-Date: {now}".encode() in warc.unzip(bytes(data))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("n", [10, 60, 64, 65, 500])
def test_context_words_are_whole(n):
    word = "x" * n
    text = f"far {word} near 487 555 7299 {word} end"
    start = text.index("487")
    seen = word if n <= pii.LONG else "<long>"
    assert pii.patterns(text, start, start + 12) == [f"{seen} near _", f"near _ {seen}"]
    assert pii.patterns(f"{word} 1", n + 1, n + 2) == []


def _graph_scores(rows):
    """The scores by hand: rows of (value, seed, patterns)."""
    edges = {(v, p) for v, _, ps in rows for p in ps}
    seeds = {v for v, seed, ps in rows if seed and ps}
    values = {v for v, _ in edges}
    score = {v: float(v in seeds) for v in values}
    while True:
        trust = {}
        for p in {p for _, p in edges}:
            own = [score[v] for v, q in edges if q == p]
            if sum(s >= pii.MIN_SCORE for s in own) >= pii.MIN_SUPPORT and sum(own) / len(own) >= pii.MIN_CONFIDENCE:
                trust[p] = sum(own) / len(own)
        new = {}
        for v in values:
            miss = 1.0
            for w, p in edges:
                if w == v and p in trust:
                    miss *= 1 - min(trust[p], 0.999)
            new[v] = 1.0 if v in seeds else 1 - miss
        if max(abs(new[v] - score[v]) for v in values) <= pii.STILL:
            return trust, new
        score = new


def test_scores_rise_until_none_moves(spark):
    """A chain of contexts, each known only through the values of the one before."""
    lines = [f"please call me under +1 487 555 {i:04d} today" for i in range(240)]
    lines += [f"please call me under 487 600 {i:04d} today" for i in range(60)]
    for step, (known, new) in enumerate([(60, 14), (14, 3), (3, 0)]):
        lines += [f"go{step} at{step} 487 {600 + step} {i:04d} end{step}" for i in range(known)]
        lines += [f"go{step} at{step} 487 {601 + step} {i:04d} end{step}" for i in range(new)]
    lines += [f"some other {i % 4} words 555 12{i % 5} 000{i} behind" for i in range(9)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert all(found[i] for i in range(len(lines) - 9)) and not any(found[i] for i in range(len(lines) - 9, len(lines)))
    few = {r.doc_id: r.spans for r in pii.find(docs, rounds=3).collect()}
    assert sum(not s for s in few.values()) == 9 + 17 + 3
    rows = [(s["value"], s["seed"], s["patterns"]) for r in pii.scan(docs).collect() for s in r.seen]
    trust, scores = _graph_scores(rows)
    got_trust, got_scores = pii.confident(pii.scan(docs).selectExpr("inline(seen)").select("kind", "value", "seed", "patterns"))
    assert {r.pattern: r.confidence for r in got_trust.collect()} == pytest.approx(trust, abs=1e-5)
    assert {r.value: r.score for r in got_scores.collect()} == pytest.approx(scores, abs=1e-5)

"""One row of each component stays, whatever ids its rows share."""

import numpy as np

from rowferry.llm import simhash


def _texts(rng, n):
    return [" ".join(f"w{k}" for k in rng.integers(0, 10**6, 60)) for _ in range(n)]


def test_keep_one_where_components_share_an_id(spark):
    a, b, *many = _texts(np.random.default_rng(3), 42)
    rows = [(5, a), (5, b), (3, b), *[(7, t) for t in many], (7, many[0]), (None, many[1]), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r.doc_id or 0, r.text) for r in simhash.keep_one(docs).collect()))
    assert kept == sorted([(5, a), (3, b), *[(7, t) for t in many], (0, "alone")])
    links = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert (5, 3) in links and (5, 5) in links

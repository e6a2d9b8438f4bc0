"""Importance weights, packing, and the pipeline's filters, each against a plain version."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from rowferry.llm import importance, langid, packing, rules


def _model(rows):
    total = Counter()
    for text in rows:
        total.update(importance.features(text).tolist())
    n = sum(total.values())
    share = importance.SMOOTHING / (n + importance.SMOOTHING * importance.BUCKETS)
    return lambda b: math.log(share + total[b] / (n + importance.SMOOTHING * importance.BUCKETS))


def test_importance_weights_and_cut(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    known = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            known[r.doc_id] = known.get(r.doc_id, True) and r.quality == 1 and not r.toxic
    good, raw = _model([t for i, t in rows if known.get(i)]), _model([t for _, t in rows])
    want = {}
    for i, text in rows:
        found = Counter(importance.features(text).tolist())
        want.setdefault(i, []).append(sum(n * (good(b) - raw(b)) for b, n in found.items()))
    got = importance.resample(docs, labels).collect()
    for r in got:
        assert min(abs(r.log_weight - w) for w in want[r.doc_id]) < 1e-6 * max(1.0, abs(r.log_weight))
    k = round(sum(known.values()) / len(known) * len(rows))
    ranked = sorted(got, key=lambda r: (-r.noisy_weight, r.doc_id))
    assert [r.kept for r in ranked] == [True] * k + [False] * (len(rows) - k)


def _fewest(sizes, capacity):
    """The fewest windows that hold all sizes, by trying."""
    for k in range(1, len(sizes) + 1):
        loads = [0] * k

        def place(i):
            if i == len(sizes):
                return True
            for w in range(k):
                if loads[w] + sizes[i] <= capacity:
                    loads[w] += sizes[i]
                    if place(i + 1):
                        return True
                    loads[w] -= sizes[i]
                if not loads[w]:
                    break
            return False

        if place(0):
            return k
    return len(sizes)


@pytest.mark.parametrize("seed", range(30))
def test_windows_are_close_to_the_fewest(seed):
    sizes = np.random.default_rng(seed).integers(1, 40, 9).tolist()
    dealt = packing.windows_of(sizes, 40)
    assert sorted(itertools.chain(*dealt)) == list(range(9)) and all(sum(sizes[i] for i in w) <= 40 for w in dealt)
    assert len(dealt) <= _fewest(sizes, 40) + 1
    parts = list(itertools.chain(*packing.fitted(sizes, 40)))
    whole = {i: sorted((start, n) for j, start, n in parts if j == i) for i in range(9)}
    for i, own in whole.items():
        ends = list(itertools.accumulate([n for _, n in own], initial=0))
        assert [s for s, _ in own] == ends[:-1] and ends[-1] == sizes[i]


def test_filters_keep_what_their_operators_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in rules.quality(docs).where("kept").collect()}
    assert {r.doc_id for r in rules.keep_good(docs).collect()} == kept and 0 < len(kept) < docs.count()
    net = langid.fit(docs.where("doc_id % 2 = 0"))
    known = {r.doc_id for r in langid.predict(docs, net).collect() if r.score >= 0.5}
    assert {r.doc_id for r in langid.keep_known(docs, net, 0.5).collect()} == known and known

"""The Merkle manifest against a tree built by hand, with blocks of one and of several levels."""

import hashlib
import zlib

import pytest

from rowferry.llm import merkle

ROWS = [
    (1, "s", "en", 3, "Abc"), (1, "s", "en", 3, "Abc"), (1, "s", "en", 4, "other"), (None, None, None, None, None),
    (None, "s", None, 2, "X"), (-4, "t", "é", 0, ""), (6, "t", "z", 1, "ÉTÉ Q"), (9, "", "", 5, None),
] + [(i, "w", "many", i, f"Text Number {i}") for i in range(100, 241)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(level):
    """Levels of runs of eight, from the given nodes up to one."""
    levels = [level]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + 8])) for i in range(0, len(last), 8)])
    return levels


def walk(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at - at % 8
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + 8])))
        at //= 8
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, sha("".join(map(field, r))), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for n, g in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path, now = walk(trees[g], i) + walk(top, n), leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                small = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
                now = sha("".join(map(field, (*r[:4], small))))
            for left, right in path:
                now = sha(left + now + right)
            proof = sha("".join(a + b for a, b in path))
            out.append((r[0], leaf, trees[g][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [1, 3])
def test_manifest(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "_BLOCK", merkle.ARITY**depth)
    docs = spark.createDataFrame(
        [(*r, 7, "x", 0.5) for r in ROWS],
        "doc_id long, source string, lang string, n_chars long, text string, tree int, pos string, node double",
    )
    got = merkle.verified(merkle.manifest(docs.repartition(5))).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS)
    assert {r.verified for r in got} == {True, False}


def test_lone_leaf_and_empty_table(spark):
    docs = spark.createDataFrame([ROWS[0]], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.verified(merkle.manifest(docs)).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")
    assert merkle.verified(merkle.manifest(docs.where("false"))).count() == 0

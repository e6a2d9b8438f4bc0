"""Merkle manifest of a table: one tree a group, the groups' roots under one root.

A leaf is the digest of a row's fields. Aligned blocks of ARITY ** DEPTH nodes
keep each of their levels as one string of hex digits side by side; parents are
digests of its fixed-width substrings, and what flanks a node's substring in its
run is its segment of siblings. Block roots are the nodes of the next round, so
a tree of any size takes one round for every DEPTH levels. Paths are put
together on the way back, joined once a block, not once a leaf.

Rows are ranked by a range-partitioned sort of digests, not of texts, and equal
rows are told apart by a stored number, so neither a hot group nor a hot row
ends in one task.

Defined cases: a null field counts as `-`, a null group is a group, before all
others; a null id comes first in its group and is never tampered with; rows of
one id are ordered by leaf, repeated rows are leaves each; a lone leaf is its
group's root and a lone group's root is the root; an empty table gives no row;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowferry.llm.common import bound
from rowferry.operators.numbering import with_row_no
from rowferry.scratch import materialize

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ARITY = 8
#: Levels that a block folds in one round.
DEPTH = 3
#: Hex digits of a digest.
WIDTH = 64

_BLOCK = ARITY**DEPTH
_PART_BITS = 33
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf_digest(values: list[Column]) -> Column:
    """Digest of the values' texts, each led by its length in bytes; `-` stands for null."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


def leaves(docs: DataFrame, id_col: str, group_col: str, fields: list[str], text_col: str) -> DataFrame:
    """(doc_id, grp, leaf, tampered); tampered is the leaf of the text in small letters where 3 divides the id's CRC."""
    small = {text_col: F.translate(F.col(text_col).cast("string"), _CAPITALS, _CAPITALS.lower())}
    chosen = F.crc32(F.encode(F.col(id_col).cast("string"), "utf-8")) % 3 == 0
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(group_col).cast("string").alias("grp"),
        leaf_digest([F.col(f) for f in fields]).alias("leaf"),
        F.when(chosen, leaf_digest([small.get(f, F.col(f)) for f in fields])).alias("tampered"),
        F.monotonically_increasing_id().alias("nth"),
    )


def ranked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves as nodes (tree, pos, m, node, item), and (tree, grp); m is the tree's number of leaves.

    Groups and leaves get consecutive numbers from counts by partition of one sort.
    """
    order = ["grp", "doc_id", "leaf", "nth"]
    placed = materialize(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()),
        "merkle-order",
    ).withColumn("part", F.shiftright("at", _PART_BITS))
    runs = materialize(
        placed.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "merkle-runs"
    )
    whole = Window.partitionBy("grp")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    trees = materialize(with_row_no(runs.select("grp").distinct(), ["grp"], first=0, name="tree"), "merkle-trees")
    bases = runs.select(
        "part", "grp", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(whole).alias("m")
    )
    bases = bases.join(trees.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g"))).select(
        F.col("part").alias("p"), "g", "first", "base", "m", "tree"
    )
    nodes = placed.join(bases, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
    return nodes.select(
        "tree", (F.col("base") + F.col("at") - F.col("first")).alias("pos"), "m", F.col("leaf").alias("node"),
        F.struct("doc_id", "tampered").alias("item"),
    ), trees


def _parents(level: Column) -> Column:
    """The next level's string: a digest for every ARITY nodes, the last ones fewer."""
    runs = F.sequence(F.lit(0), ((F.octet_length(level) - 1) / (ARITY * WIDTH)).cast("int"))
    digests = F.transform(
        runs, lambda i: F.sha2(level.substr(i * (ARITY * WIDTH) + 1, F.lit(ARITY * WIDTH)), 256)
    )
    return F.array_join(digests, "").cast("binary")


def _round(nodes: DataFrame) -> DataFrame:
    """(tree, block, m, items, s0 ... sDEPTH, node): the levels of each block, null above a tree's root."""
    members = F.sort_array(F.collect_list(F.struct("pos", "node", "item")))
    blocks = nodes.groupBy("tree", F.floor(F.col("pos") / _BLOCK).cast("long").alias("block")).agg(
        F.max("m").alias("m"), members.alias("members")
    )
    out = blocks.select(
        "tree", "block", "m", F.transform("members", lambda x: x["item"]).alias("items"),
        F.array_join(F.col("members.node"), "").cast("binary").alias("s0"),
    )
    for level in range(DEPTH):  # a tree still has several nodes on this level
        out = out.withColumn(f"s{level + 1}", F.when(F.col("m") > ARITY**level, _parents(F.col(f"s{level}"))))
    tops = [F.col(f"s{level}") for level in range(DEPTH, -1, -1)]
    return out.withColumn("node", F.coalesce(*tops).cast("string"))


def grow(nodes: DataFrame) -> list[DataFrame]:
    """Written rounds of blocks, from the leaves up to one block a tree."""
    rounds = []
    while True:
        blocks = materialize(_round(nodes), f"merkle-round{len(rounds)}")
        rounds.append(blocks)
        if (blocks.agg(F.max("m")).first()[0] or 0) <= _BLOCK:
            return rounds
        nodes = blocks.select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("m") / _BLOCK).alias("m"), "node", F.struct("block").alias("item")
        )


def _own_path(i: Column) -> Column:
    """Sibling segments of the block's i-th node: what stands left and right of it in its run, level by level."""
    steps = []
    for level in range(DEPTH):
        at = F.floor(i / ARITY**level).cast("int")
        inside, string = at % ARITY, F.col(f"s{level}")
        left = string.substr((at - inside) * WIDTH + 1, inside * WIDTH)
        right = string.substr((at + 1) * WIDTH + 1, (ARITY - 1 - inside) * WIDTH)
        steps.append(F.when(F.col(f"s{level + 1}").isNotNull(), F.struct(left.alias("l"), right.alias("r"))))
    return F.array_compact(F.array(*steps))


def descend(rounds: list[DataFrame], up: DataFrame) -> DataFrame:
    """(tree, item, node, path, what else up has) of the lowest round's nodes; up has (tree, block, path) of the highest one's blocks."""
    carried = [c for c in up.columns if c not in ("tree", "block", "path")]
    for blocks in reversed(rounds):
        joined = blocks.drop("m", "node").join(up.withColumnRenamed("path", "above"), ["tree", "block"])
        nodes = F.transform(
            "items",
            lambda item, i: F.struct(
                item.alias("item"),
                F.col("s0").substr(i * WIDTH + 1, F.lit(WIDTH)).cast("string").alias("node"),
                F.concat(_own_path(i), F.col("above")).alias("path"),
            ),
        )
        up = joined.select("tree", F.explode(nodes).alias("x"), *carried).select("tree", "x.*", *carried)
        if blocks is not rounds[0]:
            up = up.select("tree", F.col("item.block").alias("block"), "path", *carried)
    return up


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(
        path, leaf, lambda node, step: F.sha2(F.concat(step["l"], node.cast("binary"), step["r"]), 256)
    )


def siblings(path: Column) -> Column:
    """All siblings' digests side by side, level by level, left to right."""
    return F.aggregate(path, F.lit("").cast("binary"), lambda text, step: F.concat(text, step["l"], step["r"]))


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: list[str] | None = None,
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, grp, leaf, tampered, path, subroot, root), one row for each row of docs.

    path is the array of (l, r) segments from the leaf to root; ``fold`` and
    ``siblings`` read it. tampered is null where the row was not tampered with.
    """
    rows = materialize(leaves(docs, id_col, group_col, fields or FIELDS, text_col), "merkle-leaves")
    nodes, trees = ranked(rows)
    rounds = grow(nodes)
    subroots = rounds[-1].select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees.count()).cast("long").alias("m"), "node",
        F.struct("tree").alias("item"),
    )
    upper = grow(subroots)
    empty = F.array().cast("array<struct<l:binary,r:binary>>")
    top = upper[-1].select("tree", "block", empty.alias("path"), F.col("node").alias("root"))
    supers = descend(upper, top).select(
        F.col("item.tree").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("node").alias("subroot"), "root"
    )
    found = descend(rounds, materialize(supers.join(trees, "tree"), "merkle-subroots"))
    return found.select(
        "item.doc_id", "grp", F.col("node").alias("leaf"), "item.tampered", "path", "subroot", "root"
    )


def verified(found: DataFrame) -> DataFrame:
    """Every leaf, proof and the root that the leaf as it is now leads to."""
    now = bound(F.coalesce("tampered", "leaf"), lambda leaf: fold(leaf, F.col("path")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        now.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    """The same for DuckDB: every level is a table; up to 8 levels below the groups' roots and 5 above."""

    def climb(start: str, key: str, levels: int) -> str:
        out = []
        for i in range(levels):
            last = f"{start}{i}"
            out.append(f"""{last}_s as (select {key}, pos, m, node,
              case when m > 1 then coalesce(string_agg(node, '') over (partition by {key}, pos // 8 order by pos
                rows between unbounded preceding and 1 preceding), '') else '' end as l,
              case when m > 1 then coalesce(string_agg(node, '') over (partition by {key}, pos // 8 order by pos
                rows between 1 following and unbounded following), '') else '' end as r from {last}),
            {start}{i + 1} as (select {key}, pos // 8 as pos, (m + 7) // 8 as m,
              case when m > 1 then sha256(string_agg(node, '' order by pos)) else any_value(node) end as node
              from {last} group by {key}, pos // 8, m)""")
        return ",\n".join(out)

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"

    small = f"translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}')"
    plain, changed = ("sha256(" + " || ".join(map(field, fs)) + ")" for fs in (FIELDS, [*FIELDS[:-1], small]))
    crc = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''),
        lambda c: ascii(c)::bigint)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)),
        lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""
    low, high = 8, 5
    joins = [f"join a{i}_s on a{i}_s.g = w.g and a{i}_s.pos = w.pos // {8**i}" for i in range(low)]
    joins += [f"join b{i}_s on b{i}_s.pos = w.g // {8**i}" for i in range(high)]
    steps = [f"a{i}_s" for i in range(low)] + [f"b{i}_s" for i in range(high)]
    folds, last = [], "coalesce(w.tampered, w.leaf)"
    for i, s in enumerate(steps):
        folds.append(f"case when {s}.m > 1 then sha256({s}.l || {last} || {s}.r) else {last} end as f{i}")
        last = f"f{i}"
    return f"""
      with d as (select doc_id, dense_rank() over (order by lang nulls first) - 1 as g, {plain} as leaf,
          case when {crc} % 3 = 0 then {changed} end as tampered from documents),
      w as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos,
          count(*) over (partition by g) as m from d),
      a0 as (select g, pos, m, leaf as node from w),
      {climb("a", "g", low)},
      b0 as (select 0 as z, g as pos, (select max(g) + 1 from w) as m, node from a{low}),
      {climb("b", "z", high)},
      o as (select w.doc_id, w.leaf, a{low}.node as subroot, b{high}.node as root,
          sha256({" || ".join(f"{s}.l || {s}.r" for s in steps)}) as proof_sha256, {", ".join(folds)}
        from w {" ".join(joins)} join a{low} on a{low}.g = w.g cross join b{high})
      select doc_id, leaf, subroot, root, proof_sha256, {last} as folded_root, {last} = root as verified from o"""


SQL = _sql()

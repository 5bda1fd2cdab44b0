"""Merkle manifest of a dataset by butterfly exchange.

Leaves are ranked within their tree (here: a language) by a range-partitioned sort, and cut into aligned blocks of
``fanout ** levels`` leaves. A block builds its subtree and the lower part of every proof by itself. Then the blocks
swap subtree roots, round by round: in round r each of the ``fanout`` aligned groups of ``fanout ** r`` blocks meets
the others block by block (equal place in their groups), and every block hashes the parent for itself. A block thus
holds, after the last round, the root and the upper part of the proof of all its leaves; nothing is sent down again.
The last group of a tree may be ragged: its blocks stand in for the places that it lacks.

Digests are SHA-256; ``H`` of nodes hashes their lowercase hex digests, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.common import small, stored

#: Per level from the leaf up: how many siblings stand before the node, and all siblings from left to right.
PATH = "array<struct<place:int,others:array<binary>>>"
_PATH = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.binary()))]))


@dataclass(frozen=True)
class MerkleParams:
    """fanout: children of a node, and groups that meet in a round; levels: levels that a block builds alone;
    rounds: rounds of the exchange between two written tables."""

    fanout: int = 2
    levels: int = 12
    rounds: int = 4

    @property
    def block(self) -> int:
        return self.fanout**self.levels


def leaf_digest(*values: Column) -> Column:
    """Hex SHA-256 of the values: ``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    fields = []
    for v in values:
        s = v.cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*fields), 256)


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def tree_key(name: Column) -> Column:
    """A text that is never null and orders as the name does: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with _at, the rank within the tree by ``order`` (nulls first), and _nodes, the rows of the tree.

    A sort over ranges, then one offset a (range, tree). Rows that agree in everything are dealt by a number of
    their own, so that repeated rows spread over ranges too.
    """
    keys = [tree, *order, "_copy"]
    dealt = rows.withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    lined = stored(dealt.drop("_copy").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).alias("_part")
    runs = lined.groupBy(part, tree).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    mine = Window.partitionBy(tree)
    before = F.coalesce(F.sum("_n").over(mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select("_part", tree, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(mine).alias("_nodes")))
    return lined.withColumn("_part", part).join(small(runs), ["_part", tree]).withColumn("_at", F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def _depth(nodes: int, fanout: int) -> int:
    depth = 0
    while nodes > 1:
        nodes, depth = -(-nodes // fanout), depth + 1
    return depth


def _subtree(leaves: list[bytes], depth: int, fanout: int) -> tuple[bytes, pa.Array]:
    """Root of the subtree of ``depth`` levels and the path of every leaf in it."""
    level, levels = leaves, [leaves]
    for _ in range(depth):
        level = [hashlib.sha256("".join(d.hex() for d in level[i : i + fanout]).encode()).digest() for i in range(0, len(level), fanout)]
        levels.append(level)
    n = len(leaves)
    held, there = np.zeros((n, depth, fanout, 32), np.uint8), np.zeros((n, depth, fanout), bool)
    place = np.zeros((n, depth), np.int32)
    for k in range(depth):
        nodes = np.frombuffer(b"".join(levels[k]), np.uint8).reshape(-1, 32)
        mine = np.arange(n) // fanout**k
        place[:, k] = mine % fanout
        near = (mine - mine % fanout)[:, None] + np.arange(fanout)
        there[:, k] = (near < len(nodes)) & (near != mine[:, None])
        held[:, k] = nodes[np.minimum(near, len(nodes) - 1)]
    values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), int(there.sum()), [None, pa.py_buffer(held[there].tobytes())]).cast(pa.binary())
    inner = np.concatenate([[0], there.sum(2).ravel().cumsum()]).astype(np.int32)
    steps = pa.StructArray.from_arrays([pa.array(place.ravel()), pa.ListArray.from_arrays(pa.array(inner), values)], fields=list(_PATH.value_type))
    return level[0], pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * depth), steps)


def _grow(tree: str, digest: str, params: MerkleParams):
    """Batches of rows sorted by (tree, _block, _at) -> the same rows with the block's root and their paths in it."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        nodes, block = rows["_nodes"][0].as_py(), params.block
        depth = params.levels if nodes > block else _depth(nodes, params.fanout)
        top, path = _subtree(rows[digest].to_pylist(), depth, params.fanout)
        out = rows.drop_columns(["_at"]).append_column("_top", pa.array([top] * len(rows), pa.binary())).append_column("_path", path.cast(_PATH))
        return out.combine_chunks().to_batches()[0]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([waiting, rows]) if waiting is not None else rows
            other = pc.or_(pc.not_equal(rows[tree][1:], rows[tree][:-1]), pc.not_equal(rows["_block"][1:], rows["_block"][:-1]))
            cuts = [0, *(np.flatnonzero(other.to_numpy()) + 1).tolist()]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                yield done(rows.slice(lo, hi - lo))
            waiting = rows.slice(cuts[-1])
        if waiting is not None:
            yield done(waiting)

    return grow


def exchange(state: DataFrame, tree: str, width: int, fanout: int) -> DataFrame:
    """One round: groups of ``width`` blocks become groups of ``width * fanout``.

    state: tree, _block, _blocks (of the tree), _top, _path. A tree that is one group already is left as it is.
    """
    group, low = F.floor(F.col("_block") / width), F.col("_block") % width
    groups = F.ceil(F.col("_blocks") / width)
    slot, active = group % fanout, groups > 1
    has = F.least(F.lit(width).cast("long"), F.col("_blocks") - group * width)
    alone = ~active | ((slot == 0) & (group == groups - 1))
    places = F.when(alone, F.array(low)).otherwise(F.sequence(low, F.lit(width - 1).cast("long"), has))
    sent = state.select(
        tree, F.when(active, F.floor(group / fanout)).otherwise(group).alias("_to"), F.explode(places).alias("_place"), low.alias("_low"),
        F.struct(slot.cast("int").alias("slot"), F.col("_top").alias("top")).alias("_sent"), F.struct("_block", "_blocks", slot.cast("int").alias("slot"), active.alias("active"), "_top", "_path").alias("_own"),
    )
    own = F.collect_list(F.when(F.col("_place") == F.col("_low"), F.col("_own")))
    met = sent.groupBy(tree, "_to", "_place").agg(F.sort_array(F.collect_list("_sent")).alias("_met"), own.alias("_mine"))
    met = met.select(tree, "_met", F.explode("_mine").alias("m"))
    top = F.unhex(F.sha2(F.array_join(F.transform("_met", lambda s: hexed(s["top"])), ""), 256))
    others = F.transform(F.filter("_met", lambda s: s["slot"] != F.col("m.slot")), lambda s: s["top"])
    step = F.array(F.struct(F.col("m.slot").alias("place"), others.alias("others")))
    return met.select(
        tree, F.col("m._block").alias("_block"), F.col("m._blocks").alias("_blocks"), F.when(F.col("m.active"), top).otherwise(F.col("m._top")).alias("_top"),
        F.when(F.col("m.active"), F.concat("m._path", step)).otherwise(F.col("m._path")).cast(PATH).alias("_path"),
    )


def grow_trees(rows: DataFrame, tree: str, order: list[str], digest: str, params: MerkleParams) -> tuple[DataFrame, DataFrame]:
    """(leaves, blocks): ``rows`` with _block and _path in it, and per (tree, _block) its _path on to the root, _top.

    Both are stored tables. ``digest`` is a binary column, ``tree`` never null.
    """
    size = params.block
    cut = ranked(rows, tree, order).withColumn("_block", F.floor(F.col("_at") / size))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name != "_at")
    dealt = cut.repartition(tree, "_block").sortWithinPartitions(tree, "_block", "_at")
    leaves = stored(dealt.mapInArrow(_grow(tree, digest, params), f"{schema}, _top binary, _path {PATH}"))
    state = leaves.groupBy(tree, "_block").agg(F.first("_top").alias("_top"), F.ceil(F.first("_nodes") / size).alias("_blocks"))
    state = stored(state.select(tree, "_block", "_blocks", "_top", F.array().cast(PATH).alias("_path")))
    most = state.agg(F.max("_blocks")).first()[0] or 0
    width, done = 1, 0
    while width < most:
        state, width, done = exchange(state, tree, width, params.fanout), width * params.fanout, done + 1
        if done % params.rounds == 0 or width >= most:
            state = stored(state)
    return leaves.drop("_top", "_nodes"), state


def manifest(rows: DataFrame, tree: Column, order: list[str], leaf: str, params: MerkleParams | None = None) -> DataFrame:
    """``rows`` with path (the proof, from the leaf to the root), subroot and root, both hex.

    rows: any columns but _tree and names with a leading underscore; ``leaf``: a hex digest. Rows with an equal
    ``tree`` form one, leaves ascending by ``order`` (nulls first), ties by digest; a null is a tree of its own. The
    subroots, null first and then by the UTF-8 bytes of the tree's name, are the leaves of the top tree. Rows that
    repeat are leaves each; a lone leaf is the subroot itself. An empty table has an empty manifest.
    """
    params = params or MerkleParams()
    keyed = rows.withColumns({"_tree": tree_key(tree), "_leaf": F.unhex(leaf)})
    leaves, blocks = grow_trees(keyed, "_tree", [*order, "_leaf"], "_leaf", params)
    subroots = blocks.where("_block = 0").select(F.lit("").alias("_all"), "_tree", F.col("_top").alias("_subroot"))
    below, above = grow_trees(subroots, "_all", ["_tree"], "_subroot", params)
    upper = above.select("_all", "_block", F.col("_top").alias("_root"), F.col("_path").alias("_p2"))
    top = below.select("_all", "_block", "_tree", F.col("_path").alias("_p1")).join(small(upper), ["_all", "_block"]).select("_tree", "_root", F.concat("_p1", "_p2").alias("_high"))
    reach = blocks.join(small(stored(top)), "_tree").select("_tree", "_block", F.col("_top").alias("_subroot"), "_root", F.concat("_path", "_high").alias("_upper"))
    proven = leaves.join(small(stored(reach)), ["_tree", "_block"])
    return proven.select(*rows.columns, F.concat("_path", "_upper").alias("path"), hexed(F.col("_subroot")).alias("subroot"), hexed(F.col("_root")).alias("root"))


def siblings(path: Column) -> Column:
    """Hex digests of all siblings of a path, level by level and left to right, in one text."""
    return F.array_join(F.transform(F.flatten(F.transform(path, lambda s: s["others"])), hexed), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hex digest and its path lead to."""

    def up(node: Column, step: Column) -> Column:
        text = lambda some: F.array_join(F.transform(some, hexed), "")
        before, after = F.slice(step["others"], 1, step["place"]), F.slice(step["others"], step["place"] + 1, F.size(step["others"]))
        return F.sha2(F.concat(text(before), node, text(after)), 256)

    return F.aggregate(path, leaf, up)

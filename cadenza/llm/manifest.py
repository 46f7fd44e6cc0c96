"""Merkle manifest of a table: a digest of every row, a tree for every group of rows, and a tree over the groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, written

#: Hex digits of a digest.
HEX = 64
PATH = "array<struct<left: string, right: string>>"


def leaf_digest(*values: Column) -> Column:
    """SHA-256 (hex) of the values, each its UTF-8 byte count, a colon and itself, or a dash where it is null."""
    said = lambda v: F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(said, values)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to; a row is as the manifest has it if this is the manifest's root."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s.left, node, s.right), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level from the leaf up, left to right, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s.left, s.right)), "")


def height(total: int, fanout: int) -> int:
    """Levels above `total` nodes until one is left."""
    levels = 0
    while total > 1:
        total, levels = -(-total // fanout), levels + 1
    return levels


def hashed(leaves: np.ndarray, levels: int, fanout: int) -> list[np.ndarray]:
    """Digest matrices (nodes x 64 hex bytes) of a block: the leaves, then each level above, whose nodes are the digests
    of rows of the matrix below, reshaped to `fanout` digests a row (the last row may have fewer)."""
    out = [leaves]
    for _ in range(levels):
        whole = len(out[-1]) // fanout * fanout
        rows = [*out[-1][:whole].reshape(-1, fanout * HEX), *([out[-1][whole:].reshape(-1)] if whole < len(out[-1]) else [])]
        out.append(np.frombuffer("".join(sha256(row).hexdigest() for row in rows).encode(), np.uint8).reshape(-1, HEX))
    return out


def _strings(digests: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.Array:
    """Strings of n[i] digests from row first[i] on."""
    before = np.cumsum(n) - n
    rows = np.arange(int(n.sum())) + np.repeat(first - before, n)
    offsets = np.concatenate([[0], np.cumsum(n)]) * HEX
    return pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(digests[rows]))])


def paths(levels: Sequence[np.ndarray], fanout: int, above: Sequence[Mapping[str, str]]) -> pa.Array:
    """The path of every leaf of a block to its root and on along `above`: on each level the digests left and right of
    its node in the run of `fanout` nodes that they share. Rows of all levels lie in one matrix; where a leaf's siblings
    begin and end in it follows from the leaf's number alone."""
    n = len(levels[0])
    sizes = [len(x) for x in levels[:-1]]
    base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    upper = "".join(s["left"] + s["right"] for s in above).encode()
    digests = np.concatenate([*levels[:-1], np.frombuffer(upper, np.uint8).reshape(-1, HEX)])
    k = np.arange(len(sizes))
    node = np.arange(n)[:, None] // fanout**k
    begin = node // fanout * fanout
    end = np.minimum(begin + fanout, np.array(sizes, np.int64))
    first, left, right = base[:-1] + begin, node - begin, end - node - 1
    a, b = (np.array([len(s[side]) // HEX for s in above], np.int64) for side in ("left", "right"))
    tail = base[-1] + np.cumsum(a + b) - a - b
    wide = lambda own, rest: np.concatenate([own, np.broadcast_to(rest, (n, len(rest)))], axis=1).ravel()
    first, left, right = wide(first, tail), wide(left, a), wide(right, b)
    own = (first < base[-1]).astype(np.int64)  # a block's own node stands between its siblings
    both = pa.StructArray.from_arrays([_strings(digests, first, left), _strings(digests, first + left + own, right)], ["left", "right"])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (len(sizes) + len(above)), pa.int32()), both)


def _matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("node").to_pylist()).hex().encode(), np.uint8).reshape(-1, HEX)


def climbed(leaves: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """The nodes (tree, number, total, node) of every `levels`-th level of each tree, leaves first, roots last.

    An aligned block of fanout^levels nodes of a tree is one group and gives one node of the next table. How many
    tables there are follows from the largest tree.
    """
    block = fanout**levels

    def up(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        total = table.column("total")[0].as_py()
        top = hashed(_matrix(table), min(levels, height(total, fanout)), fanout)[-1]
        return pa.table({"tree": [key[0].as_py()], "number": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([-(-total // block)], pa.int64()), "node": [bytes.fromhex(top.tobytes().decode())]})

    tables = [leaves]
    largest = leaves.agg(F.max("total")).first()[0] or 1
    while largest > 1:
        nodes = tables[-1].select("tree", "number", "total", "node")
        tables.append(written(nodes.groupBy("tree", F.expr(f"number div {block}").alias("b")).applyInArrow(up, "tree string, number long, total long, node binary")))
        largest = -(-largest // block)
    return tables


def descended(tables: Sequence[DataFrame], tops: DataFrame, fanout: int, levels: int, carry: Sequence[str] = ()) -> DataFrame:
    """The leaves with their carried columns, subroot, root and path. tops: (tree, number, subroot, root, path) of roots."""
    block = fanout**levels

    def run(names: Sequence[str]):
        def down(nodes: pa.Table, parents: pa.Table) -> pa.Table:
            nodes, parent = nodes.sort_by("number"), parents.slice(0, 1).to_pylist()[0]
            total = nodes.column("total")[0].as_py()
            own = hashed(_matrix(nodes), min(levels, height(total, fanout)), fanout)
            same = {c: pa.array([parent[c]] * nodes.num_rows, pa.string()) for c in ("subroot", "root")}
            return pa.table({**{c: nodes.column(c) for c in names}, **same, "path": paths(own, fanout, parent["path"])})

        return down

    for table in reversed(tables[:-1]):
        leaf = table is tables[0]
        names = ["tree", "number", *(["node", *carry] if leaf else [])]
        kinds = dict(table.dtypes)
        schema = ", ".join(f"{c} {kinds[c]}" for c in names) + f", subroot string, root string, path {PATH}"
        nodes = table.select(*dict.fromkeys([*names, "total", "node"])).groupBy("tree", F.expr(f"number div {block}").alias("b"))
        tops = nodes.cogroup(tops.groupBy("tree", F.col("number").alias("b"))).applyInArrow(run(names), schema)
        tops = tops if leaf else written(tops)
    if len(tables) == 1:
        tops = tables[0].drop("total").join(tops.drop("number"), "tree")
    return tops


def manifest(docs: DataFrame, fields: Sequence[str], group: str = "source", order: str = "doc_id", carry: Mapping[str, Column] | None = None, fanout: int = 16, levels: int = 2) -> DataFrame:
    """(id, group, leaf, subroot, root, path) and the carried columns of every row of docs.

    A leaf is the digest of the row's fields (see leaf_digest). In a group, leaves ascend by the order column; while there
    is more than one node, runs of `fanout` become their digest. What is left is the group's subroot; subroots, ordered by
    the group's name (bytewise, null first), give the root likewise. path holds what stands left and right of the row's
    node on every level, so that a row is proved by folded() alone. carry: further columns by name, made from docs' columns.

    Aligned blocks of fanout^levels nodes are hashed by a task each, as matrices in numpy: up for one node a block, then
    down for the paths. A group is numbered and cut into blocks however large it is; the driver learns the largest number
    of leaves only. Nulls are values of their own everywhere, a null group is a group, and a null id comes first. Rows of
    one id are ordered by their leaf; equal rows are leaves of their own. A group of one row has its leaf as subroot, and
    a single group its subroot as root. Other columns of docs, whatever their names, are not read. No rows give no rows.
    """
    carry = carry or {}
    hidden = {f"_c{k}": c for k, c in enumerate(carry.values())}
    name = F.col(group).cast("string")
    rows = docs.select(
        F.col(order).alias("id"), F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("tree"), F.unhex(leaf_digest(*[F.col(f) for f in fields])).alias("node"),
        *[c.alias(k) for k, c in hidden.items()], F.monotonically_increasing_id().alias("u"),
    )
    leaves = written(numbered(written(rows), ["tree"], ["id", "node", "u"]).drop("u").withColumnRenamed("number_total", "total"))
    tables = climbed(leaves, fanout, levels)
    subroots = tables[-1].select(F.col("tree").alias("name"), F.lit("").alias("tree"), "node")
    subroots = written(numbered(subroots, ["tree"], ["name"]).withColumnRenamed("number_total", "total"))
    upper = climbed(subroots, fanout, levels)
    hexed = lambda c: F.lower(F.hex(c))
    root = upper[-1].select("tree", "number", F.lit("").alias("subroot"), hexed("node").alias("root"), F.expr(f"cast(array() as {PATH})").alias("path"))
    tops = descended(upper, root, fanout, levels, ["name"]).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("number"), hexed("node").alias("subroot"), "root", "path")
    out = descended(tables, written(tops), fanout, levels, ["id", *hidden])
    label = F.when(F.col("tree") != "", F.substr("tree", F.lit(2)))
    return out.select("id", label.alias("group"), *[F.col(k).alias(c) for k, c in zip(hidden, carry, strict=True)], hexed("node").alias("leaf"), "subroot", "root", "path")

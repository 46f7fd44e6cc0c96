"""Repeated passages: runs of successive lines of one text that resemble another run of the same text."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD, normal_line, plain_line, words
from ..sources.tables import written

#: A text of at most so many lines and signs is worked whole in one task; lines of longer texts are joined over all tasks.
MOST_LINES, MOST_SIGNS = 1024, 1 << 18


def _apart(df: DataFrame) -> DataFrame:
    """df, never broadcast in a join: repeated numbers and words are small as files but large in the driver's memory."""
    return df.hint("merge")


def similar_bags(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc_id, i, node) and their likeness (doc_id, a, b), both ways, of lines (doc_id, i, w): w is an array of words.

    Lines of equal words, counted, are one node, named by its first line. Nodes are alike from a Dice similarity of 0.75.
    A line of n words shares at least 0.6 n with any that resembles it, so two that do share a word among the first
    n - ceil(0.6 n) + 1 of any fixed order: only these, longest words first, are joined. Lines without words are no node.
    """
    counted = lines.select("doc_id", "i", F.explode("w").alias("x")).groupBy("doc_id", "i", "x").agg(F.count(F.lit(1)).alias("c"))
    tokens = counted.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))))
    token = F.struct((-F.length("x")).alias("l"), "x", "c")
    bags = written(tokens.select("doc_id", "i", token.alias("t")).groupBy("doc_id", "i").agg(F.array_sort(F.collect_list("t")).alias("bag")))
    nodes = bags.groupBy("doc_id", "bag").agg(F.min("i").alias("node")).withColumn("n", F.size("bag"))
    nodes = written(nodes)

    # tokens by hash: a collision only adds a pair to look at
    head = F.transform(F.slice("bag", F.lit(1), F.expr("n - (3 * n + 4) div 5 + 1")), lambda t: F.xxhash64(t.x, t.c))
    first = nodes.select("doc_id", "node", "n", F.explode(head).alias("t"))
    a, b = (first.select("doc_id", "t", F.col("node").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    near = a.join(_apart(b), ["doc_id", "t"]).where("a < b AND 5 * na >= 3 * nb AND 5 * nb >= 3 * na").select("doc_id", "a", "b").distinct()
    side = lambda x: nodes.select("doc_id", F.col("node").alias(x), F.col("bag").alias(f"bag{x}"))
    alike = near.join(_apart(side("a")), ["doc_id", "a"]).join(_apart(side("b")), ["doc_id", "b"]).where(8 * F.size(F.array_intersect("baga", "bagb")) >= 3 * (F.size("baga") + F.size("bagb")))
    alike = written(alike.select("doc_id", "a", "b"))
    return bags.join(_apart(nodes), ["doc_id", "bag"]).select("doc_id", "i", "node"), alike.unionByName(alike.select("doc_id", F.col("b").alias("a"), F.col("a").alias("b")))


def similar_runs(nodes: DataFrame, alike: DataFrame) -> DataFrame:
    """(doc_id, i, d, n): lines i .. i + n - 1 are equal to or like lines i + d .. i + d + n - 1, n >= 2 and as large as can be.

    No pair of lines inside a run is formed, so a passage repeated M times costs its M runs, not M^2 pairs. A run begins at
    two places whose two next lines match and whose lines before do not. Places of the same two lines are grouped by the
    line before (a place without one is its own group), and only groups with lines before that do not match are joined: each pair of places they give is a
    beginning. Ends are found likewise by the lines after, and on one distance the k-th beginning goes with the k-th end.

    nodes: (doc_id, i, node), a line that matches nothing may be missing; alike: (doc_id, a, b) both ways, without a = b.
    """
    line = Window.partitionBy("doc_id").orderBy("i")
    beside = lambda k: F.when(F.lead("i", k).over(line) == F.col("i") + k, F.lead("node", k).over(line))
    two = nodes.select("doc_id", "i", F.col("node").alias("x"), beside(1).alias("y"), beside(-1).alias("before"), beside(2).alias("after"))
    two = written(two.where("y IS NOT NULL"))

    # pairs of two lines (x, y) and (p, q) of other nodes that match
    kinds = two.select("doc_id", "x", "y").distinct()
    other = kinds.select("doc_id", F.col("x").alias("p"), F.col("y").alias("q"))
    second = kinds.join(_apart(alike.select("doc_id", F.col("a").alias("y"), F.col("b").alias("q"))), ["doc_id", "y"]).withColumn("p", F.col("x")).join(_apart(other), ["doc_id", "p", "q"])
    moved = kinds.join(_apart(alike.select("doc_id", F.col("a").alias("x"), F.col("b").alias("p"))), ["doc_id", "x"]).join(_apart(other), ["doc_id", "p"])
    both = moved.join(_apart(alike.select("doc_id", F.col("a").alias("y"), F.col("b").alias("q"))), ["doc_id", "y", "q"], "left_semi")
    columns = ["doc_id", "x", "y", "p", "q"]
    kin = second.select(*columns).unionByName(moved.where("y = q").select(*columns)).unionByName(both.select(*columns))
    kin = written(kin.where("x < p OR (x = p AND y < q)"))

    def edges(context: str) -> DataFrame:
        groups = two.groupBy("doc_id", "x", "y", F.coalesce(context, -1 - F.col("i")).alias("u")).agg(F.collect_list("i").alias("at"))
        groups = written(groups)
        there = groups.select("doc_id", F.col("x").alias("p"), F.col("y").alias("q"), F.col("u").alias("v"), F.col("at").alias("to"))
        same = groups.join(_apart(there.withColumns({"x": F.col("p"), "y": F.col("q")})), ["doc_id", "x", "y"]).where("u < v")
        changed = kin.join(_apart(groups), ["doc_id", "x", "y"]).join(_apart(there), ["doc_id", "p", "q"]).where("u <> v")
        columns = ["doc_id", "u", "v", "at", "to"]
        free = same.select(*columns).unionByName(changed.select(*columns)).join(_apart(alike.select("doc_id", F.col("a").alias("u"), F.col("b").alias("v"))), ["doc_id", "u", "v"], "left_anti")
        places = free.select("doc_id", "to", F.explode("at").alias("s")).select("doc_id", "s", F.explode("to").alias("t"))
        return places.select("doc_id", F.abs(F.col("s") - F.col("t")).alias("d"), F.least("s", "t").alias("i"))

    ends = edges("before").withColumn("end", F.lit(0)).unionByName(edges("after").withColumn("end", F.lit(1)))
    paired = ends.withColumn("last", F.lead("i").over(Window.partitionBy("doc_id", "d").orderBy("i", "end")))
    return paired.where("end = 0").select("doc_id", "i", "d", (F.col("last") - F.col("i") + 2).alias("n"))


def alike_inside(lines: Sequence[str | None]) -> tuple[list[int], list[tuple[int, int]]]:
    """As similar_bags, of the plain lines of one text: each line's node, -1 without words, and the pairs of nodes that are alike."""
    node, of, bags, split = [], {}, [], re.compile(WORD).findall
    for line in lines:
        counts = Counter(split(line or ""))
        bag = frozenset(counts).union(f"{w} {k}" for w, c in counts.items() if c > 1 for k in range(2, c + 1))
        if bag and bag not in of:
            of[bag] = len(bags)
            bags.append(bag)
        node.append(of.get(bag, -1))
    # rarest words first: a word of one node only is shared with none
    many, seen, pairs = Counter(), defaultdict(list), []
    for bag in bags:
        many.update(bag)
    for b, bag in enumerate(bags):
        n = len(bag)
        shared = [t for t in bag if many[t] > 1]
        head = n - (3 * n + 4) // 5 + 1 - (n - len(shared))
        if head <= 0:
            continue
        first = sorted(shared, key=lambda t: (many[t], t))[:head]
        for a in {a for t in first for a in seen[t]}:
            m = len(bags[a])
            if 5 * m >= 3 * n and 5 * n >= 3 * m and 8 * len(bag & bags[a]) >= 3 * (n + m):
                pairs.append((a, b))
        for t in first:
            seen[t].append(b)
    return node, pairs


def runs_inside(lines: Sequence[str | None]) -> np.ndarray:
    """Rows (i, d, n) as similar_runs gives them, of the plain lines of one text."""
    node, pairs = alike_inside(lines) if len(lines) > 2 else ([], [])
    known = [k for k in node if k >= 0]
    if not pairs and len(set(known)) == len(known):
        return np.empty((0, 3), dtype=np.int64)
    like = np.eye(max(known) + 2, dtype=bool)
    like[-1, -1] = False  # lines without words
    for a, b in pairs:
        like[a, b] = like[b, a] = True
    m = np.zeros((len(node) + 2,) * 2, dtype=bool)
    m[1:-1, 1:-1] = np.triu(like[np.ix_(node, node)], 1)
    here, before, after = m[1:-1, 1:-1], m[:-2, :-2], m[2:, 2:]
    # on one distance the k-th beginning goes with the k-th end
    (a, to), (b, end) = (np.nonzero(here & x & ~y) for x, y in ((after, before), (before, after)))
    a, d = (x[np.lexsort((a, to - a))] for x in (a, to - a))
    return np.stack([a, d, b[np.lexsort((b, end - b))] - a + 1], axis=1)


def marks_inside(lines: Sequence[str | None]) -> np.ndarray:
    """Whether each plain line of one text lies in a run without a line in common with where it comes again."""
    found = runs_inside(lines)
    a, d, n = found[found[:, 1] >= 2].T
    steps = np.zeros(len(lines) + 1, dtype=np.int64)
    for at in (a, a + d):
        np.add.at(steps, at, 1)
        np.add.at(steps, at + n, -1)
    return np.cumsum(steps)[:-1] > 0


def _texts(arrays: pa.Array) -> Iterator[list[str | None]]:
    for x in arrays:
        yield x.as_py() or []


def runs_of(lines: Column) -> Column:
    """runs_inside() of an array of lines, as an array of structs (i, d, n)."""

    @F.arrow_udf("array<struct<i:long,d:long,n:long>>")
    def run(arrays: pa.Array) -> pa.Array:
        found = [runs_inside(x) for x in _texts(arrays)]
        rows = np.concatenate([np.empty((0, 3), dtype=np.int64), *found])
        at = np.cumsum([0, *map(len, found)])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in rows.T], ["i", "d", "n"]))

    return run(F.transform(lines, plain_line))


def marks_of(lines: Column) -> Column:
    """marks_inside() of an array of lines, as an array of booleans."""

    @F.arrow_udf("array<boolean>")
    def run(arrays: pa.Array) -> pa.Array:
        return pa.array([marks_inside(x) for x in _texts(arrays)], pa.list_(pa.bool_()))

    return run(F.transform(lines, plain_line))


def parted(lines: DataFrame, key: str, sizes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Lines (key, ...) of texts that one task can hold, as (key, rows), all lines of a text in order of their columns, and
    the lines of longer texts, None where there are none. So a short text's lines move once and are joined with nothing.

    sizes: (key, lines, signs) of all texts or parts of them, too high rather than too low.
    """
    total = sizes.groupBy(F.col(key).alias("_long")).agg(F.sum("lines").alias("lines"), F.sum("signs").alias("signs"))
    longer, rest = written(total.where((F.col("lines") > MOST_LINES) | (F.col("signs") > MOST_SIGNS)).select("_long")), None
    if not longer.isEmpty():
        same = F.col(key).eqNullSafe(F.col("_long"))
        lines, rest = lines.join(longer, same, "left_anti"), lines.join(longer, same, "left_semi")
    row = F.struct(*[c for c in lines.columns if c != key])
    return lines.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows")), rest


def repeated_runs(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """similar_runs() of lines (doc_id, pos, text), counted from 0 by pos. sizes: as parted() takes them."""
    short, rest = parted(lines.where("doc_id IS NOT NULL").select("doc_id", "pos", "text"), "doc_id", sizes)
    found = short.select("doc_id", F.explode(runs_of(F.col("rows.text"))).alias("x")).select("doc_id", "x.i", "x.d", "x.n")
    if rest is None:
        return found
    line = Window.partitionBy("doc_id").orderBy("pos", "text")
    o = rest.select("doc_id", (F.row_number().over(line) - 1).cast("long").alias("i"), words(normal_line(F.col("text"))).alias("w"))
    return found.unionByName(similar_runs(*similar_bags(o)))

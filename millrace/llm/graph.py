"""Connected components over a table of links, without a driver-side graph."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import tidied, written

#: Nodes that a task holds before it hands on what it has joined.
FLUSH = 1 << 20


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) in, a spanning forest of each task's share out: every node with the root that it has there."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root[x]) != x:
            root[x] = x = root[up]
        return x

    def out() -> pa.RecordBatch:
        own = [(x, r) for x in root if (r := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in own], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            root.setdefault(a, a)
            root.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > FLUSH:
            yield out()
            root.clear()
    yield out()


def components(links: DataFrame, made: Callable | None = None) -> DataFrame:
    """(node, component) for each node of ``links`` (a, b, both long); component is the smallest node reachable.

    With ``made``, a generator function over Arrow batches, ``links`` are the rows that it makes links (without nulls) of,
    in the Python worker that joins them.

    Each task first joins the links that it has to a forest. Then rounds contract
    the graph: every node moves to the least of its neighbours and itself, in an
    order that each round draws anew, and links between nodes that moved together
    are gone. A star is gone after one round, a chain loses a part of its nodes in
    each. The least neighbour of a hub is a minimum that tasks take before rows are
    dealt; what it moves to is joined from a written table, so that adaptive
    execution can split a hub's links over tasks. Each round is written to the
    shared folder. Links with a null end and loops are left out; repeated links
    change nothing; without links the result is empty.
    """
    if made is None:
        links = links.select("a", "b").where("a is not null and b is not null and a <> b")
    joined = tidied(lambda batches: _forests(made(batches) if made else batches))
    edges = written(links.mapInArrow(joined, "a long, b long").distinct(), "links")
    moves: list[DataFrame] = []
    order = random.Random(11)
    while not moves or not edges.isEmpty():
        mark = F.lit(order.getrandbits(62))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mark)).alias("m"))
        to = F.least(F.col("m"), F.col("a").bitwiseXOR(mark)).bitwiseXOR(mark)
        moves.append(written(least.select(F.col("a").alias("node"), to.alias("to")), "moves"))
        if len(moves) == 1 and moves[0].isEmpty():
            break
        for end in ("a", "b"):
            edges = edges.join(moves[-1].select(F.col("node").alias(end), F.col("to").alias(f"to_{end}")), end)
        moved = edges.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b"))
        edges = written(moved.where("a <> b").distinct(), "links")
    label = moves.pop()
    while moves:  # from the last round, which has the fewest nodes, to the first, which has all
        then = label.select(F.col("node").alias("to"), F.col("to").alias("then"))
        label = moves.pop().join(then, "to", "left").select("node", F.coalesce("then", "to").alias("to"))
    label = written(label, "labels")
    low = written(label.groupBy("to").agg(F.min("node").alias("component")), "components")
    return label.join(low, "to").select("node", "component")

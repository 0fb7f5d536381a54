"""Connected components of a table of links: tasks join what they hold, stars grow until each component is one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siren.llm.rows import written

#: Links of one task, and nodes that a task holds before it hands them on.
LINKS_PER_TASK, HELD_NODES = 250_000, 500_000
#: Nodes with more neighbours than this, or 1/10,000 of all links, get their smallest neighbour by broadcast.
HEAVY_LINKS = 100_000


def _joined(edges: DataFrame, n: int) -> DataFrame:
    """Links (u, v), u > v, of the same components: each task links every node of a group it knows of to the smallest."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = parent[x]
            return x

        def stars() -> pa.RecordBatch:
            rows = [(x, top(x)) for x in list(parent)]
            rows = [(x, t) for x, t in rows if x != t]
            parent.clear()
            arrays = [pa.array([x for x, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, ["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = top(u), top(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > HELD_NODES:
                yield stars()
        yield stars()

    return edges.coalesce(n // LINKS_PER_TASK + 1).mapInArrow(join, "u long, v long")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or none, and those with one are no other's."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("to")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("long").alias("to"))
    )
    met = ends.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.count(F.when(F.col("to").isNull(), 1)).alias("below"))
    return met.where("low != high OR (low IS NOT NULL AND below > 0)").isEmpty()


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """Links (u, v) both ways with ``m``, the smallest of u and its neighbours.

    The few nodes with very many neighbours get it by broadcast, so no node's links meet in one task.
    """
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("links"))
    many = F.col("links") > max(HEAVY_LINKS, n // 10_000)  # at most 20,000 nodes
    marked = both.join(F.broadcast(least.where(many).select("u", F.col("m").alias("_m"))), "u", "left")
    light = marked.where("_m IS NULL").select("u", "v").join(least.where(~many).select("u", "m"), "u")
    return marked.where("_m IS NOT NULL").select("u", "v", F.col("_m").alias("m")).unionAll(light.select("u", "v", "m"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node of its component.

    Each task first joins the links it holds, with a bounded number of nodes at a time; often that leaves one star a
    component. While it does not, each round points every neighbour above a node, and then every neighbour below it, at
    the node's smallest neighbour, and tasks join again. Rounds are written to the shared folder. Links of a node with
    itself count, NULLs do not.
    """
    nodes = links.where("a IS NOT NULL AND b IS NOT NULL")
    every = written(nodes.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    edges = every.where("u != v")
    n = every.count()
    edges = written(_joined(edges, n), "stars")
    while not _are_stars(edges):
        large = _with_least(edges, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large-stars")
        small = _with_least(large, n).where("v < u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            small.select("u", F.col("m").alias("v"))
        )
        edges = written(_joined(written(small.distinct(), "small-stars"), n), "stars")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = found.unionAll(edges.select("v", "v")).unionAll(every.where("u = v").select("u", "v"))
    return written(found.groupBy("node").agg(F.min("component").alias("component")), "components")

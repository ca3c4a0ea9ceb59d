"""Connected components of a graph whose edges stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, save


#: Edges that a task contracts at once, roughly; tasks grow in number with the edges, not in size.
EDGES_A_TASK = 200_000


def _contract(batches):
    """Within a task, replaces its edges by a star of each connected part: fewer rows, same components."""
    import pyarrow as pa

    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = top(a), top(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > 500_000:
            rows = [(x, top(x)) for x in up if top(x) != x]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])
            up = {}
    rows = [(x, top(x)) for x in up if top(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _stars(edges: DataFrame) -> bool:
    """Whether each node of distinct edges (a, b), a > b, either has a single edge from it or only edges to it: then each component is a star around its smallest node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("away"), F.lit(0).alias("to")).union(edges.select("b", F.lit(0), F.lit(1)))
    other = ends.groupBy("node").agg((F.sum("away") + F.max("to")).alias("roles")).where("roles > 1")
    return other.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b: long, no nulls), a saved table; root is the smallest node of the component.

    The files of the table are read in as few tasks as its rows need, each of which contracts what it reads. Large-star and small-star steps in turn, on a written table each, until every component is a star. Every edge
    points from the larger to the smaller node, and no step gathers the neighbours of a node: it joins their minimum.
    """
    tasks = 1 + edges.count() // EDGES_A_TASK
    now = save(edges.select("a", "b").where("a <> b").coalesce(tasks).mapInArrow(releasing(_contract), "a long, b long").distinct())
    while not _stars(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = save(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())

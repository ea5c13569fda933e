"""Connected components of a graph given by links, in rounds of contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shuffles, forget, written

#: Links that one task joins; more are contracted in rounds until so few are left.
FEW = 10_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to) of at most FEW links: each node and one node of its component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "to"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b: long); root is one node of its component.

    In each round every node takes, of itself and its neighbours, the one with the
    smallest hash (of another seed each round, so that no order of the nodes is
    slow), the links are drawn between what the nodes took, and links within one
    are dropped: the nodes shrink by a share each round.  Once FEW links are left, one task
    joins them.  The choices are then followed backwards, round by round.  Each round is a written table, so a lost executor
    repeats one round at most.  Null ends are ignored; an empty table gives no
    rows."""
    spark = links.sparkSession
    left = written(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct(), "links")
    steps: list[DataFrame] = []
    while (n := left.count()) > FEW:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("rank"), F.col(c).alias("to"))  # noqa: B023, E731
        took = both.groupBy("a").agg(F.min(ranked("b")).alias("near")).select(F.col("a").alias("node"), F.least("near", ranked("a"))["to"].alias("to"))
        took = written(took, "took")
        steps.append(took)
        one, two = took.select(F.col("node").alias("a"), F.col("to").alias("x")), took.select(F.col("node").alias("b"), F.col("to").alias("y"))
        drawn = left.join(one, "a").join(two, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        was, left = left, written(drawn, "links")
        forget(was)
        drop_shuffles(spark)
    if n:
        steps.append(written(left.coalesce(1).mapInArrow(_joined, "node long, to long"), "took"))
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # what the first round's nodes ended as: later rounds know fewer and fewer nodes
    ends = steps[-1]
    for step in reversed(steps[:-1]):
        later = ends.select(F.col("node").alias("to"), F.col("to").alias("end"))
        was, ends = ends, written(step.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to")), "ends")
        forget(was, step)
    return ends.select("node", F.col("to").alias("root"))

"""Connected components: local contraction, then spreading the least label and jumping along labels."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import written


class Joined:
    """Components that a task has joined so far; each is named by its least node."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as stars around their least nodes."""
    joined, nodes = Joined(), set()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            joined.join(a, b)
            nodes.update((a, b))
    rows = [(x, t) for x in nodes if (t := joined.top(x)) != x]
    x, y = zip(*rows) if rows else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, component for every node of an edge (a, b) with another.

    Without `rounds` the component is the least node; the rounds grow with the logarithm of the longest path. After a
    fixed number of rounds nodes of one label are connected, though not all connected nodes have one label.
    """
    stars = written(edges.select("a", "b").filter("a != b").mapInArrow(_contracted, "x long, y long"), "stars")
    both = stars.unionByName(stars.select(F.col("y").alias("x"), F.col("x").alias("y")))
    labels = written(both.groupBy(F.col("x").alias("node")).agg(F.least("node", F.min("y")).alias("component")), "labels")
    done = 0
    while rounds is None or done < rounds:
        done += 1
        heard = both.join(labels.withColumnRenamed("node", "y"), "y").select(F.col("x").alias("node"), "component", F.lit(None).cast("long").alias("own"))
        lower = (heard.unionByName(labels.select("node", "component", F.col("component").alias("own")))
                 .groupBy("node").agg(F.min("component").alias("to"), F.max("own").alias("old")))
        beyond = labels.select(F.col("node").alias("to"), F.col("component").alias("beyond"))
        now = written(lower.join(beyond, "to", "left").select("node", "old", F.least("to", "beyond").alias("component")), "labels")
        labels = now.select("node", "component")
        if rounds is None and now.filter("old != component").isEmpty():
            break
    return labels

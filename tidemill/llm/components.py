"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import cut, table

#: Rounds after which the steps must have ended; each about halves the depth of the trees.
MOST_ROUNDS = 60
#: A table of so many links or fewer, as counted, is settled in one task; the result is the same.
FEW_LINKS = 400_000

_NODE = pa.schema([("node", pa.int64()), ("component", pa.int64())])


class Sets:
    """Disjoint sets of numbers, each named by its least member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def _settled(edges: DataFrame) -> DataFrame:
    """The same for a table whose size is known to be small, in one task."""

    def run(batches):
        sets, nodes = Sets(), set()
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sets.join(x, y)
                nodes |= {x, y}
        if nodes:
            order = sorted(nodes)
            yield table({"node": order, "component": [sets.root(x) for x in order]}, _NODE)

    return cut(edges.select("a", "b").repartition(1).mapInArrow(run, "node long, component long"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b): component is the smallest node reachable.

    Each node's links go to the least of its neighbours, larger ones first and then smaller ones,
    until nothing changes. A step is one aggregation with counts before the shuffle and one join
    that may be split where a node has very many links; no node's links are gathered in one place,
    and nothing is brought to the driver but a count and a checksum. What is left once FEW_LINKS
    links remain is settled at once.
    """
    edges = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = _state(edges)
    for _ in range(MOST_ROUNDS):
        if before[0] <= FEW_LINKS:
            return _settled(edges)
        # Large star: every larger neighbour goes to the least of the closed neighbourhood.
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the least of these.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").unionByName(low.select(F.col("m").alias("a"), "b"))
        edges = cut(small.distinct())
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    stars = edges.groupBy("b").agg(F.min("a").alias("component"))
    roots = edges.select(F.col("a").alias("node")).distinct()
    leaves = stars.select(F.col("b").alias("node"), "component")
    return leaves.unionByName(roots.select("node", F.col("node").alias("component")))

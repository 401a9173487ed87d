"""Connected components of a link table, distributed: local contraction, then minima and pointer jumps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embspark.llm.common import checkpoint

#: Nodes that a task holds while it contracts its links; beyond that it gives out what it has and starts again.
CONTRACTED = 500_000
#: Rows that are broadcast at most (two longs each); more are joined by a shuffle that may be split.
BROADCAST_NODES = 200_000


def stars(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links ``a, b`` as links of every node to the smallest one that this task connects it with."""
    up: dict[int, int] = {}

    def root(n: int) -> int:
        top = n
        while (above := up.setdefault(top, top)) != top:
            top = above
        while n != top:
            n, up[n] = up[n], top
        return top

    def given() -> pa.RecordBatch:
        pairs = [(n, r) for n in list(up) if (r := root(n)) != n]
        up.clear()
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
        if len(up) > most:
            yield given()
    yield given()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for the nodes of ``links(a long, b long)`` that are not themselves the smallest.

    Tasks first turn their own links into stars. Each round then links a node, and its
    other smaller neighbours, to the smallest of them, and from there to that one's
    smallest, until nothing moves. Minima are pre-aggregated; they come back in joins
    with a small side, or with sides that adaptive execution may split, so that a hub
    is not one task's to gather.
    """
    most = CONTRACTED
    links = links.where("a <> b").mapInArrow(lambda batches: stars(batches, most), "a long, b long")
    # a > b from here on
    links = checkpoint(links.distinct())
    while True:
        least = checkpoint(links.groupBy("a").agg(F.min("b").alias("m")))
        small = F.broadcast(least) if least.count() <= BROADCAST_NODES else least
        moved = links.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        flat = moved.union(least.select("a", F.col("m").alias("b"), F.lit(False)))
        jump = flat.join(small.select(F.col("a").alias("b"), F.col("m").alias("next")), "b", "left")
        jump = jump.groupBy("a", F.coalesce("next", "b").alias("b")).agg(F.max(F.col("moved") | F.col("next").isNotNull()).alias("moved"))
        rows = checkpoint(jump)
        links = rows.select("a", "b")
        if rows.where("moved").isEmpty():
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))

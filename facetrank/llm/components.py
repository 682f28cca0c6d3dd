"""Connected components over an edge table, without collecting links or components anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.sources.session import cut, drop, prepare

#: Links that one task joins by itself (some 50 MB of its memory); more are brought down by rounds over all tasks first.
LOCAL_LINKS = 500_000


def dealt_anew(sums: DataFrame, key: str) -> DataFrame:
    """An aggregate by ``key``, dealt by something else, so that a join on ``key`` shuffles both of its sides itself.

    Spark splits a skewed partition only of such a join; one that takes an aggregate as it lies would put a hot key in one
    task.
    """
    return sums.repartition(F.xxhash64(key))


def _neighbour_minimum(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the smallest of u and all that u is linked with.

    A node with very many links is summed on the map side, and the join that follows can be split by Spark.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(dealt_anew(least, "u").hint("merge"), "u")


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each node of the links, the smallest node that it reaches): roots hook to smaller ones, then paths are halved."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, (a, b) = np.arange(len(nodes)), np.split(place, 2)
    while True:
        a, b = root[a], root[b]
        between = a != b
        if not between.any():
            return nodes, nodes[root]
        a, b = a[between], b[between]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(after := root[root], root):
            root = after


def _joined(edges: DataFrame) -> DataFrame:
    """(node, component) of few links, in one task."""
    prepare(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.asarray(b.column(c)) for c in "uv"] for b in batches if b.num_rows]
        if held:
            found = least_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "component"])

    return edges.where("u <> v").select("u", "v").coalesce(1).mapInArrow(run, "node bigint, component bigint")


def components(edges: DataFrame, max_rounds: int = 64, local: int = LOCAL_LINKS) -> DataFrame:
    """(node, component) of every node that occurs in ``edges`` (u bigint, v bigint); component is its smallest node.

    Up to ``local`` links are joined by one task. More go through rounds that alternate large-star and small-star steps:
    the edge count never grows, a star stays a star, and a component of any shape ends as a star after a number of rounds
    that is logarithmic in practice. Each round is cut, so that a lost executor repeats one round at most; the result is
    cut as well, and the rounds are dropped. ``edges`` is counted first, so it had better be a table that is cut.
    """
    if edges.count() <= local:
        return cut(_joined(edges))
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = now.count()
    for _ in range(max_rounds):
        if n <= local:
            out = cut(_joined(now))
            drop(now)
            return out
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _neighbour_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        joined = _neighbour_minimum(large)
        small = joined.select("v", "m").union(joined.select("u", "m")).toDF("u", "v").where("u <> v").distinct()
        after = cut(small)
        before, n = n, after.count()
        same = n == before and after.join(now, ["u", "v"], "left_anti").isEmpty()
        drop(now)
        now = after
        if same:
            break
    else:
        raise RuntimeError("the components did not settle")
    # A settled table is a set of stars: each node beside its component.
    out = cut(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct())
    drop(now)
    return out

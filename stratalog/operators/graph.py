"""Traversal of relations: bounded breadth-first search, impact, levels of a dependency graph."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import MAX_DEPTH
from ..session import cut, cut_partitioned

#: Sources with 1/HOT of the edges are kept apart.
HOT = 1000


def one_hop(edges: DataFrame, frontier: DataFrame, relations: Sequence[str] = ()) -> DataFrame:
    """Distinct ``id`` reached from ``frontier`` (id) by one edge forward, with the least ``relation`` that leads there.

    ``edges`` may have hot sources: the frontier is distinct and the join keeps only ids, combined before the shuffle.
    """
    e = edges.where(F.col("relation").isin(*relations)) if relations else edges
    hop = e.join(frontier.select(F.col("id").alias("from_id")), "from_id")
    return hop.groupBy(F.col("to_id").alias("id")).agg(F.min("relation").alias("via"))


class Adjacency:
    """Edges made ready for many hops: written once, partitioned by from_id, so that a hop shuffles its frontier and none of the edges.

    A source with a share of the edges that would overload its partition (1/HOT of them or more, so there are at most HOT such sources) is kept
    apart, its edges spread as they come; a hop sends it those of its frontier that are such sources by broadcast.
    """

    def __init__(self, edges: DataFrame, relations: Sequence[str] = ()):
        e = edges.where(F.col("relation").isin(*relations)) if relations else edges
        e = e.select("relation", "from_id", "to_id")
        top = F.call_function("approx_top_k", F.xxhash64("from_id"), F.lit(2 * HOT), F.lit(16 * HOT))
        e = cut(e)
        found = e.agg(top.alias("t"), F.count(F.lit(1)).alias("of")).select("of", F.explode("t").alias("t")).where(F.col("t.count") * HOT >= F.col("of"))
        # a few numbers, at most about HOT
        self.hot = [r[0] for r in found.select("t.item").collect()]
        is_hot = F.xxhash64("from_id").isin(*self.hot) if self.hot else F.lit(False)
        self.spread = e.where(is_hot)
        self.by_source = cut_partitioned(e.where(~is_hot), "from_id")

    def hop(self, frontier: DataFrame) -> DataFrame:
        """Distinct ``id`` reached from ``frontier`` (distinct id) by one edge forward, with the least ``relation`` that leads there."""
        f = frontier.select(F.col("id").alias("from_id"))
        out = self.by_source.join(f.hint("shuffle_hash"), "from_id")
        if self.hot:
            out = out.unionByName(self.spread.join(F.broadcast(f.where(F.xxhash64("from_id").isin(*self.hot))), "from_id"))
        return out.groupBy(F.col("to_id").alias("id")).agg(F.min("relation").alias("via"))


def bfs(edges: DataFrame, starts: DataFrame, relations: Sequence[str] = (), max_depth: int = MAX_DEPTH) -> DataFrame:
    """``id``, ``depth``, ``via`` of all that is reached from ``starts`` (id) within ``max_depth`` hops forward, starts excluded even
    where a cycle leads back to them. Depth 0 or less, or no starts: empty. The edges are written once (Adjacency) and each level is written out,
    so a level costs a shuffle of its frontier and of what is seen, whatever the depth, and a lost executor costs no level again."""
    begin = starts.select("id").dropna().distinct()
    if max_depth < 1:
        return begin.where(F.lit(False)).select("id", F.lit(0).alias("depth"), F.lit("").alias("via"))
    near, frontier, seen, levels = Adjacency(edges, relations), begin, begin, None
    for depth in range(1, max_depth + 1):
        fresh = cut(near.hop(frontier).join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth"), "via"))
        if fresh.isEmpty():
            break
        levels = fresh if levels is None else levels.unionByName(fresh)
        seen, frontier = seen.unionByName(fresh.select("id")), fresh
    if levels is None:
        return begin.where(F.lit(False)).select("id", F.lit(0).alias("depth"), F.lit("").alias("via"))
    return levels


def impacted(edges: DataFrame, touched: DataFrame, relations: Sequence[str] = (), max_depth: int = MAX_DEPTH) -> DataFrame:
    """The touched ids (depth 0, reason direct_touch) and all that they lead to (reason impacted_via, with the relation)."""
    direct = touched.select("id").dropna().distinct().select("id", F.lit(0).alias("depth"), F.lit("direct_touch").alias("reason"), F.lit(None).cast("string").alias("via"))
    return direct.unionByName(bfs(edges, touched, relations, max_depth).select("id", "depth", F.lit("impacted_via").alias("reason"), "via"))


def topological(depends: dict[str, list[str]]) -> list[str]:
    """Layers so that each follows what it depends on, of several possible ones the least name first. A cycle or a missing layer is
    an error. For the few layers of a registry; peel_levels() is for graphs of any size."""
    left = {n: set(d) for n, d in depends.items()}
    unknown = {x for d in left.values() for x in d} - set(left)
    if unknown:
        raise ValueError(f"missing layers: {', '.join(sorted(unknown))}")
    ready = sorted(n for n, d in left.items() if not d)
    heapq.heapify(ready)
    out = []
    while ready:
        n = heapq.heappop(ready)
        out.append(n)
        for m, d in left.items():
            if n in d:
                d.remove(n)
                if not d:
                    heapq.heappush(ready, m)
    if len(out) < len(left):
        raise ValueError(f"cycle among {', '.join(sorted(set(left) - set(out)))}")
    return out


def peel_levels(nodes: DataFrame, depends: DataFrame) -> DataFrame:
    """``name``, ``level`` for nodes (name) and edges (name, on): level 0 depends on nothing, the next on lower ones only. Nodes on or
    behind a cycle, or behind a missing node, have level -1. One round per level."""
    rest, edges, done, level = nodes.select("name").distinct(), depends.select("name", "on").dropna().distinct(), None, 0
    while True:
        free = cut(rest.join(edges.select("name"), "name", "left_anti").select("name", F.lit(level).alias("level")))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        rest = cut(rest.join(free, "name", "left_anti"))
        edges = cut(edges.join(free.select(F.col("name").alias("on")), "on", "left_anti").select("name", "on"))
        level += 1
    stuck = rest.select("name", F.lit(-1).alias("level"))
    return stuck if done is None else done.unionByName(stuck)

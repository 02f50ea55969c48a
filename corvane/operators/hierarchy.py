"""Parent-child links to full hierarchies.

Method: weighted disjoint-set forests. Every node is a set element whose link carries the number
of steps to the node it points at. Links that lie in one partition are compressed there; forests of
different partitions then merge in rounds: a join gives each open node the link of its top (offsets add
up, so the reach at least doubles), and as soon as the open rest fits one block it is compressed as one
forest before the next join. Nodes that reached a root take no part in later rounds. Paths come from a
traversal of the parents by index: with the depths known, each round joins a node's ancestors so far
with those of the last of them, so log2 of the largest depth rounds are enough.

Defined results
    ids: compared and returned in lower case without outer blanks; null and blank ids aren't nodes.
    repeated rows of a node: its parent is the smallest non-blank ``parent_id`` of any row.
    no ``parent_id``: the smallest node that lists it as a child; a ``parent_id`` without a row: a root.
    on or beneath a cycle (also a node that is its own parent): depth -1, the root is the cycle's
    smallest id, no path and no descendants.
    empty tables: no rows. Null child lists: no children. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_key
from ..session import cut

#: Links that one task compresses at once (about 300 bytes each in Python).
BLOCK_ROWS = 200_000

_FOREST = "id string, top string, steps long, low string, ring string"


def parents(nodes: DataFrame) -> DataFrame:
    """(id, parent) of each node; parent is null for a root."""
    own = nodes.select(norm_key("id").alias("id"), norm_key("parent_id").alias("parent"), "child_ids").where("id is not null")
    stated = own.groupBy("id").agg(F.min("parent").alias("parent"))
    listed = (
        own.select(F.col("id").alias("by"), F.explode("child_ids").alias("child"))
        .select(norm_key("child").alias("id"), "by")
        .where("id is not null")
        .groupBy("id")
        .agg(F.min("by").alias("by"))
    )
    both = stated.join(listed, "id", "left").select("id", F.coalesce("parent", "by").alias("parent"))
    there = both.select("parent").where("parent is not null").distinct().join(stated.select(F.col("id").alias("parent")), "parent", "left_semi")
    return both.join(there.withColumn("there", F.lit(True)), "parent", "left").select("id", F.when(F.col("there"), F.col("parent")).alias("parent"))


def _compress(forest: dict[str, list]) -> None:
    """Point every node at the furthest node that the links in ``forest`` reach.

    forest: id -> [top, steps, low, ring]; ``low`` is the smallest id from the node up to, without, its top.
    """
    done: set[str] = set()
    for start in forest:
        chain: list[str] = []
        place: dict[str, int] = {}
        at = start
        while at in forest and at not in done and at not in place and forest[at][3] is None:
            place[at] = len(chain)
            chain.append(at)
            at = forest[at][0]
        if at in place:
            ring = chain[place[at] :]
            low = min(forest[x][2] for x in ring)
            for x in ring:
                forest[x][:] = [low, -1, low, low]
            done.update(ring)
            del chain[place[at] :]
        for x in reversed(chain):
            mine, nxt = forest[x], forest.get(forest[x][0])
            if nxt is not None:
                if nxt[3] is not None:
                    mine[:] = [nxt[3], -1, nxt[3], nxt[3]]
                else:
                    mine[:] = [nxt[0], mine[1] + nxt[1], min(mine[2], nxt[2]), None]
            done.add(x)


def _compressed(links: DataFrame, limit: int | None = None) -> DataFrame:
    """The links, compressed in blocks of ``limit``, or each partition as one block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(forest: dict[str, list]) -> pd.DataFrame:
            _compress(forest)
            return pd.DataFrame([[k, *v] for k, v in forest.items()], columns=["id", "top", "steps", "low", "ring"])

        forest: dict[str, list] = {}
        for b in batches:
            for row in b.itertuples(index=False):
                forest[row.id] = [row.top, row.steps, row.low, row.ring]
            if limit is not None and len(forest) >= limit:
                yield flush(forest)
                forest = {}
        if forest:
            yield flush(forest)

    return links.mapInPandas(run, _FOREST)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def roots(links: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, root_id, depth) of each (id, parent) link."""
    start = links.select("id", F.col("parent").alias("top"), F.lit(1).cast("long").alias("steps"), F.col("id").alias("low"), F.lit(None).cast("string").alias("ring"))
    forest = cut(_compressed(start, block_rows))
    left, reach = forest.count(), 1
    closed: list[DataFrame] = [forest.limit(0).withColumn("low", F.lit(None).cast("string"))] if not left else []

    def lookup(df: DataFrame, over: bool) -> DataFrame:
        return df.select(F.col("id").alias("top"), F.col("top").alias("t2"), F.col("steps").alias("s2"), F.col("low").alias("l2"), F.col("ring").alias("r2"), F.lit(over).alias("over"))

    while left:
        n = left
        # Closed rows stay in the lookup side: an open row may still point at them.
        ahead = _union([lookup(forest, False), *[lookup(c, True) for c in closed]])
        ring = F.coalesce("ring", "r2")
        step = forest.join(ahead, "top", "left").select(
            "id",
            F.coalesce("ring", "r2", "t2", "top").alias("top"),
            F.when(ring.isNotNull(), F.lit(-1)).otherwise(F.col("steps") + F.coalesce("s2", F.lit(0))).cast("long").alias("steps"),
            F.least("low", "l2").alias("low"),
            ring.alias("ring"),
            # A top without a link is a root, and so is the top of a closed row.
            (ring.isNotNull() | F.coalesce("over", F.lit(True))).alias("closed"),
        )
        step = cut(step)
        closed.append(step.where("closed").drop("closed"))
        forest = step.where("not closed").drop("closed")
        left = forest.count()
        reach *= 2
        if left == n and reach > 2 * n:
            # Only cycles and what hangs on them are left, and every top lies on its cycle by now.
            low = forest.select(F.col("id").alias("top"), F.col("low").alias("ring"))
            closed.append(forest.drop("ring").join(low, "top").select("id", F.col("ring").alias("top"), F.lit(-1).cast("long").alias("steps"), "low", "ring"))
            break
        if 0 < left <= block_rows:
            forest = cut(_compressed(forest.coalesce(1)))
    return _union(closed).select("id", F.coalesce("ring", "top").alias("root_id"), F.when(F.col("ring").isNotNull(), -1).otherwise(F.col("steps")).cast("long").alias("depth"))


def ancestors(links: DataFrame, depths: DataFrame) -> DataFrame:
    """(id, above): the ancestors, nearest first, of each node with a positive depth. ``depths``: (id, depth) of the links."""
    state = cut(links.join(depths.where("depth > 0"), "id").select("id", F.col("parent").alias("top"), "depth", F.array("parent").alias("above")))
    most = state.agg(F.max("depth")).first()[0] or 1
    done = [state.where("depth = 1")]
    more = state.where("depth > 1")
    reach = 1
    while reach < most:
        ahead = _union([more, *done]).select(F.col("id").alias("top"), F.col("top").alias("t2"), F.col("above").alias("a2"))
        step = cut(more.join(ahead, "top").select("id", F.col("t2").alias("top"), "depth", F.concat("above", "a2").alias("above")))
        done.append(step.where(F.size("above") == F.col("depth")))
        more = step.where(F.size("above") < F.col("depth"))
        reach *= 2
    return _union(done).select("id", "above")


def hierarchy(nodes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, parent, root_id, depth, path) of every node; path runs from the root down to the node."""
    p = cut(parents(nodes))
    links = p.where("parent is not null")
    found = roots(links, block_rows)
    return p.join(found, "id", "left").join(ancestors(links, found), "id", "left").select(
        "id",
        "parent",
        F.coalesce("root_id", "id").alias("root_id"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.when(F.col("depth").isNull(), F.array("id")).when(F.col("depth") > 0, F.concat(F.reverse("above"), F.array("id"))).alias("path"),
    )


def descendants(nodes: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, descendant_id, distance), one row per pair: a node with many descendants is many rows, never one list."""
    p = cut(parents(nodes)).where("parent is not null")
    found = roots(p, block_rows)
    above = ancestors(p, found)
    return above.select(F.posexplode("above").alias("pos", "id"), F.col("id").alias("descendant_id")).select("id", "descendant_id", (F.col("pos") + 1).cast("long").alias("distance"))

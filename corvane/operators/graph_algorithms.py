"""Graph algorithms as rounds of joins: projection, components, communities, links between levels, paths.

Each round cuts its lineage through the shared checkpoint folder; what is collected is one number a round.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .chunking import numbered

#: Graphs of up to so many edge ends run the rounds of ``communities`` in one task (about 80 bytes each at most, in arrays).
SMALL_GRAPH = 8_000_000
#: Larger graphs of up to so many nodes run them over blocks of ends in many tasks; the driver holds about 60 bytes a node and resolution, a task about 30 a node.
ARRAY_NODES = 2_000_000
#: Edge ends of a block, about; a node's ends are in one block.
BLOCK_ENDS = 400_000
#: Edge ends whose moves are found at once.
SLICE_ENDS = 1_000_000


def projection(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: no dangling ends, no loops, parallel weights summed, then 1 + ln(max(w, 1))."""
    ids = entities.select("id").distinct()
    kept = relations.where("source_id <> target_id")
    kept = kept.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    pair = kept.groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).agg(F.sum("weight").alias("w"))
    return pair.select("a", "b", (F.lit(1.0) + F.ln(F.greatest("w", F.lit(1.0)))).alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable. Labels take the neighbours' minimum and then jump to their label's label."""
    rows = cut(edges.select("a", "b").unionByName(nodes.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))))
    if 2 * rows.count() <= SMALL_GRAPH:
        return rows.withColumn("weight", F.lit(1.0)).coalesce(1).mapInArrow(_one_forest, "id string, component string")
    ends = cut(both_ways(edges.withColumn("weight", F.lit(1.0))).select("src", "dst").distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = ends.join(labels.select(F.col("id").alias("src"), "component"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("jump"))
        new = cut(lower.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("jump", "component")).alias("component")))
        changed = new.where("component <> old").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels


def _one_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rounds of ``components`` on arrays: edges (a, b), and a row (a, null) for each node -> (id, component)."""
    names, a, b, _ = _read(batches)
    node = np.zeros(len(names), bool)
    node[a[b < 0]] = True
    inside = (a >= 0) & (b >= 0) & (a != b)
    a, b = a[inside], b[inside]
    inside = node[a] & node[b]
    a, b = a[inside], b[inside]
    label, old = np.arange(len(names)), None
    while old is None or (label != old).any():
        old = label.copy()
        # The roots of both ends, so that whole trees are joined.
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
    ids = np.flatnonzero(node)
    for k in range(0, len(ids), 10_000):
        own = ids[k : k + 10_000]
        yield pa.RecordBatch.from_pydict({"id": [names[v] for v in own], "component": [names[v] for v in label[own]]})


def distances(edges: DataFrame, start: str, max_depth: int = 5) -> DataFrame:
    """(id, hops, parent): breadth first from ``start``; of several parents the smallest id."""
    spark = edges.sparkSession
    ends = both_ways(edges.withColumn("weight", F.lit(1.0))).select("src", "dst").distinct()
    seen = spark.createDataFrame([(start, 0, None)], "id string, hops int, parent string")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = ends.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        frontier = cut(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("hops"), "parent"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str, max_depth: int = 5) -> list[str] | None:
    """Ids from ``start`` to ``end``, or None. Each step back reads one row."""
    if start == end:
        return [start]
    seen = cut(distances(edges, start, max_depth))
    path = [end]
    while path[-1] != start:
        row = seen.where(F.col("id") == path[-1]).select("parent").head()
        if row is None or row["parent"] is None:
            return None
        path.append(row["parent"])
    return path[::-1]


def path_edges(relations: DataFrame, path: list[str]) -> DataFrame:
    """(step, source, target, relation_id, type): the heaviest relation between each node of a path and the next, in either direction; null where there is none."""
    steps = relations.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(path, path[1:]))], "step int, source string, target string")
    ends = [relations.select(F.col(a).alias("source"), F.col(b).alias("target"), "id", "type", "weight") for a, b in (("source_id", "target_id"), ("target_id", "source_id"))]
    # The path has a handful of steps.
    hits = ends[0].unionByName(ends[1]).join(F.broadcast(steps), ["source", "target"])
    best = hits.groupBy("step").agg(F.min(F.struct((-F.col("weight")).alias("w"), "id", "type")).alias("e"))
    return steps.join(best, "step", "left").select("step", "source", "target", F.col("e.id").alias("relation_id"), "e.type")


def modularity(edges: DataFrame, membership: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``modularity`` of a given partition (id, community)."""
    m = membership.select("id", "community")
    ends = edges.join(m.select(F.col("id").alias("a"), F.col("community").alias("ca")), "a").join(m.select(F.col("id").alias("b"), F.col("community").alias("cb")), "b")
    inside = F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0).alias("inside")
    ends = ends.select(F.explode(F.array(*[F.struct(F.col(c).alias("c"), "weight", inside) for c in ("ca", "cb")])).alias("e")).select("e.*")
    per = ends.groupBy("c").agg(F.sum("weight").alias("tot"), F.sum("inside").alias("inside"))
    total = per.agg(F.sum("tot").alias("m2"))
    return per.join(F.broadcast(total), F.lit(True)).agg(F.sum(F.col("inside") / F.col("m2") - resolution * (F.col("tot") / F.col("m2")) ** 2).alias("modularity"))


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, min_size: int = 3, levels: int = 4, rounds: int = 8) -> DataFrame:
    """(id, community): greedy modularity by synchronous local moves and aggregation.

    In each half-round only one half of the nodes (by hash, changing every round) moves, so neighbours don't
    swap for ever; ties go to the smallest community. Communities are named by their smallest member,
    so the result doesn't depend on the order of the input. Communities below ``min_size`` are left out.
    """
    return communities_at(nodes, edges, [resolution], min_size, levels, rounds).drop("level")


def communities_at(nodes: DataFrame, edges: DataFrame, resolutions: list[float], min_size: int = 3, levels: int = 4, rounds: int = 8) -> DataFrame:
    """(id, community, level): ``communities`` at each of the resolutions, numbered from 0."""
    n_edges, weight = edges.agg(F.count(F.lit(1)), F.sum("weight")).head()
    names = None
    if n_edges and weight:
        edges = edges.select("a", "b", F.col("weight").cast("double").alias("weight"))
        if 2 * n_edges <= SMALL_GRAPH:
            # A task for each resolution; a union of single partitions would be one task, so each is a job of its own.
            run = lambda k: cut(edges.coalesce(1).mapInArrow(_one_task(k, resolutions[k], levels, rounds), "id string, name string, level int"))
            names = reduce(DataFrame.unionByName, _side_by_side(edges, run, range(len(resolutions))))
        else:
            names = _by_blocks(edges, 2 * n_edges, resolutions, levels, rounds)
    if names is not None:
        member = nodes.select("id", F.explode(F.array(*map(F.lit, range(len(resolutions))))).alias("level"))
        member = cut(member.join(names, ["id", "level"], "left").select("id", "level", F.coalesce("name", "id").alias("community")))
        named = member.groupBy("level", "community").agg(F.min("id").alias("name"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
        return member.join(named, ["level", "community"]).select("id", F.col("name").alias("community"), "level")
    return reduce(DataFrame.unionByName, [_by_joins(nodes, edges, r, min_size, levels, rounds).withColumn("level", F.lit(k)) for k, r in enumerate(resolutions)])


def _by_joins(nodes: DataFrame, edges: DataFrame, resolution: float, min_size: int, levels: int, rounds: int) -> DataFrame:
    """``communities`` of a graph of any size, as rounds of joins."""
    member = cut(nodes.select("id", F.col("id").alias("community")))
    graph = cut(both_ways(edges))
    m2 = graph.agg(F.sum("weight")).head()[0] or 0.0
    if not m2:
        whole = member.agg(F.min("id").alias("community"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
        return member.select("id").join(whole.select("community"), F.lit(True))
    for level in range(levels):
        k = graph.groupBy("src").agg(F.sum("weight").alias("k"))
        state = cut(k.select(F.col("src").alias("id"), F.col("src").alias("c"), "k"))
        any_move = False
        for r in range(rounds):
            sums = state.groupBy("c").agg(F.sum("k").alias("tot"))
            half = F.crc32(F.concat("src", F.lit(f":{r // 2 + 100 * level}"))) % 2 == r % 2
            near = graph.where((F.col("src") != F.col("dst")) & half).join(state.select(F.col("id").alias("dst"), "c"), "dst").groupBy("src", "c").agg(F.sum("weight").alias("w"))
            own = state.select(F.col("id").alias("src"), F.col("c").alias("mine"), "k")
            # The community that a node is in is always a candidate, also without a neighbour in it.
            stay = own.where(half).select("src", F.col("mine").alias("c"), F.lit(0.0).alias("w"))
            cand = near.unionByName(stay).groupBy("src", "c").agg(F.sum("w").alias("w")).join(own, "src").join(sums, "c")
            gain = F.col("w") - resolution * F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / m2
            cand = cand.select("src", "c", "mine", F.round(gain, 9).alias("gain"))
            best = cand.groupBy("src").agg(F.max("gain").alias("g"), F.max(F.when(F.col("c") == F.col("mine"), F.col("gain"))).alias("now"))
            to = cand.join(best, "src").where("gain = g and g > now").groupBy("src").agg(F.min("c").alias("to"))
            new = cut(state.join(to.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("to", "c").alias("c"), "k", F.col("to").isNotNull().alias("moved")))
            moved = new.where("moved").limit(1).count()
            state = new.drop("moved")
            any_move |= bool(moved)
            if not moved and r % 2:
                break
        if not any_move:
            break
        name = state.groupBy("c").agg(F.min("id").alias("name"))
        label = cut(state.join(name, "c").select("id", "name"))
        member = cut(member.join(label.select(F.col("id").alias("community"), "name"), "community", "left").select("id", F.coalesce("name", "community").alias("community")))
        graph = cut(
            graph.join(label.select(F.col("id").alias("src"), F.col("name").alias("s")), "src")
            .join(label.select(F.col("id").alias("dst"), F.col("name").alias("d")), "dst")
            .groupBy(F.col("s").alias("src"), F.col("d").alias("dst"))
            .agg(F.sum("weight").alias("weight"))
        )
    named = member.groupBy("community").agg(F.min("id").alias("name"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    return member.join(named, "community").select("id", F.col("name").alias("community"))


def _read(batches: Iterator[pa.RecordBatch]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The ids of edges (a, b, weight) in order, and the edges by the places of their ids; -1 for null."""
    code: dict[str, int] = {}
    none = (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0))
    parts = [none]
    for b in batches:
        ends = [np.fromiter((-1 if x is None else code.setdefault(x, len(code)) for x in b.column(c).to_pylist()), np.int32, b.num_rows) for c in ("a", "b")]
        parts.append((*ends, b.column("weight").to_numpy(zero_copy_only=False)))
    names = sorted(code)
    rank = np.full(len(names) + 1, -1, np.int32)
    rank[[code[x] for x in names]] = np.arange(len(names))
    return names, rank[np.concatenate([x[0] for x in parts])], rank[np.concatenate([x[1] for x in parts])], np.concatenate([x[2] for x in parts])


def _one_task(level: int, resolution: float, levels: int, rounds: int):
    """The rounds of ``communities`` over the edges of a small graph, on arrays: (a, b, weight) -> (id, name, level).

    Nodes are numbered in the order of their ids, so the smallest number is the smallest id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, a, b, w = _read(batches)
        # Sums follow the order of the ids, whatever the order of the rows.
        ends = _summed(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w]), len(names))
        del a, b, w
        crc = np.fromiter((zlib.crc32(x.encode()) for x in names), np.uint32, len(names))
        member = _moved(_Ends(*ends, len(names)), crc, resolution, levels, rounds)
        for k in range(0, len(names), 10_000):
            own = member[k : k + 10_000]
            yield pa.RecordBatch.from_pydict({"id": names[k : k + 10_000], "name": [names[v] for v in own], "level": pa.array([level] * len(own), pa.int32())})

    return run


def _side_by_side(df: DataFrame, run, each) -> list:
    """What ``run`` gives for each, its Spark jobs at the same time."""
    with ThreadPoolExecutor(len(each)) as pool:
        return list(pool.map(inheritable_thread_target(df.sparkSession)(run), each))


def _by_blocks(edges: DataFrame, n_ends: int, resolutions: list[float], levels: int, rounds: int) -> DataFrame | None:
    """(id, name, level): the rounds of ``communities`` over blocks of edge ends, in many tasks; None of too many nodes.

    The driver holds the communities of the nodes, the tasks find the moves of the nodes of their blocks.
    """
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    nodes = cut(numbered(ids, [F.col("id")]).select("id", F.col("pos").alias("v"), F.crc32("id").alias("crc")))
    n = nodes.count()
    if n > ARRAY_NODES:
        return None
    place = nodes.select("v", "crc").toArrow()
    crc = np.empty(n, np.uint32)
    crc[place["v"].to_numpy()] = place["crc"].to_numpy()
    del place
    a, b = (nodes.select(F.col("id").alias(c), F.col("v").cast("int").alias(f"v{c}")) for c in "ab")
    both = F.array(*[F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), "weight") for x, y in (("va", "vb"), ("vb", "va"))])
    ends = edges.join(a, "a").join(b, "b").select(F.explode(both).alias("e")).select("e.*")
    n_blocks = -(-n_ends // BLOCK_ENDS)
    blocks = ends.groupBy((F.col("src") % n_blocks).alias("block")).applyInArrow(_block_of_rows(n), _BLOCK)
    graph = _Blocks(cut(blocks), n, n_blocks)
    members = _side_by_side(edges, lambda r: _moved(graph, crc, r, levels, rounds), resolutions)
    sent = edges.sparkSession.sparkContext.broadcast(np.stack(members).astype(np.int32))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            v = x.column("v").to_numpy()
            for level, m in enumerate(sent.value):
                yield pa.RecordBatch.from_pydict({"id": x.column("id"), "v": m[v].astype(np.int64), "level": pa.array(np.full(len(v), level, np.int32))})

    return nodes.select("id", "v").mapInArrow(places, "id string, v long, level int").join(nodes.select("v", F.col("id").alias("name")), "v").select("id", "name", "level")


#: A block: the ends (src, dst, weight) of its nodes in order, as bytes of int32, int32 and float64.
_BLOCK = "src binary, dst binary, w binary"


def _block(src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> pa.Table:
    return pa.table({"src": [src.astype(np.int32).tobytes()], "dst": [dst.astype(np.int32).tobytes()], "w": [w.tobytes()]}, pa.schema([(c, pa.binary()) for c in ("src", "dst", "w")]))


def _block_of_rows(n: int):
    def run(rows: pa.Table) -> pa.Table:
        return _block(*_summed(rows["src"].to_numpy(), rows["dst"].to_numpy(), rows["weight"].to_numpy(), n))

    return run


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for x in batches:
        for row in range(x.num_rows):
            yield tuple(np.frombuffer(x.column(c)[row].as_buffer(), t) for c, t in (("src", np.int32), ("dst", np.int32), ("w", np.float64)))


class _Ends:
    """Edge ends of ``n`` nodes in order of (src, dst), as arrays."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> None:
        self.ends, self.n = (src.astype(np.int32), dst.astype(np.int32), w), n

    def degrees(self) -> np.ndarray:
        return np.bincount(self.ends[0], self.ends[2], self.n)

    def moves(self, *state) -> list[tuple[np.ndarray, np.ndarray]]:
        return _moves(*self.ends, *state)

    def merged(self, label: np.ndarray, n: int) -> _Ends:
        src, dst, w = self.ends
        label = label.astype(np.int32)
        return _Ends(*_summed(label[src], label[dst], w, n), n)


class _Blocks:
    """The same as rows of ``_BLOCK``."""

    def __init__(self, rows: DataFrame, n: int, n_blocks: int) -> None:
        self.rows, self.n, self.n_blocks = rows, n, n_blocks

    def _map(self, each, shared, schema: str) -> tuple[DataFrame, Broadcast]:
        """The tables of the schema that ``each``(shared, src, dst, w) gives for each block, and what to destroy when they are read."""
        sent = self.rows.sparkSession.sparkContext.broadcast(shared)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ends in _each_block(batches):
                for t in each(sent.value, *ends):
                    yield from t.to_batches()

        return self.rows.mapInArrow(run, schema), sent

    def _pairs(self, each, shared) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs of arrays (nodes, values of the type of ``shared[0]``) that ``each`` gives, at the driver."""

        def run(shared, *ends):
            for v, x in each(shared, *ends):
                yield pa.table({"v": [v.astype(np.int32).tobytes()], "x": [x.tobytes()]}, pa.schema([("v", pa.binary()), ("x", pa.binary())]))

        found, sent = self._map(run, shared, "v binary, x binary")
        rows = found.collect()
        sent.destroy()
        return [(np.frombuffer(r.v, np.int32), np.frombuffer(r.x, shared[0].dtype)) for r in rows]

    def degrees(self) -> np.ndarray:
        k = np.zeros(self.n)
        for v, x in self._pairs(_degrees, (k[:0],)):
            k[v] = x
        return k

    def moves(self, c: np.ndarray, *state) -> list[tuple[np.ndarray, np.ndarray]]:
        return self._pairs(lambda shared, *ends: _moves(*ends, *shared), (c.astype(np.int32), *state))

    def merged(self, label: np.ndarray, n: int) -> _Blocks:
        n_blocks = self.n_blocks

        def parts(label, src, dst, w):
            s, d, x = _summed(label[src], label[dst], w, n)
            to, own = s % n_blocks, int(src[0])
            for t in np.unique(to):
                at = to == t
                yield _block(s[at], d[at], x[at]).append_column("block", pa.array([int(t)])).append_column("first", pa.array([own]))

        def sums(rows: pa.Table) -> pa.Table:
            each = list(_each_block(rows.sort_by("first").to_batches()))
            return _block(*_summed(*(np.concatenate([x[k] for x in each]) for k in range(3)), n))

        pieces, sent = self._map(parts, label.astype(np.int32), _BLOCK + ", block long, first long")
        rows = cut(pieces.groupBy("block").applyInArrow(sums, _BLOCK))
        sent.destroy()
        return _Blocks(rows, n, n_blocks)


def _degrees(shared, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    first = _starts(src)
    yield src[first], np.bincount(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(src)))), w)


def _moves(
    src: np.ndarray, dst: np.ndarray, w: np.ndarray, c: np.ndarray, half: np.ndarray, k: np.ndarray, tot: np.ndarray, m2: float, resolution: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes, communities) of the nodes of ``half`` that move. Ends in order of (src, dst), a node's all there; ``tot`` by community."""
    first = _starts(src)
    # Whole nodes at a time.
    stops = np.unique(np.append(first[np.searchsorted(first, np.arange(0, len(src), SLICE_ENDS), "right") - 1], len(src)))
    for lo, hi in zip(stops, stops[1:]):
        s = src[lo:hi]
        own = s[_starts(s)]
        own = own[half[own]]
        at = half[s] & (s != dst[lo:hi])
        # The community that a node is in is always a candidate, also without a neighbour in it.
        to = np.concatenate([c[dst[lo:hi][at]], c[own]])
        v, q, x = _summed(np.concatenate([s[at], own]), to, np.concatenate([w[lo:hi][at], np.zeros(len(own))]), len(c))
        if not len(v):
            continue
        mine = q == c[v]
        gain = np.round(x - resolution * k[v] * (tot[q] - np.where(mine, k[v], 0.0)) / m2, 9)
        first_of = _starts(v)
        best = np.maximum.reduceat(gain, first_of)
        top = np.flatnonzero(gain == np.repeat(best, np.diff(np.append(first_of, len(v)))))
        top = top[_starts(v[top])]
        better = best > gain[mine]
        yield v[first_of][better], q[top][better].astype(c.dtype)


def _moved(graph: _Ends | _Blocks, crc: np.ndarray, resolution: float, levels: int, rounds: int) -> np.ndarray:
    """The number of the smallest member of each node's community. ``crc``: of the nodes' ids."""
    ids, member, m2 = np.arange(len(crc)), np.arange(len(crc)), None
    for level in range(levels):
        n = len(ids)
        k, c, any_move = graph.degrees(), np.arange(n), False
        m2 = k.sum() if m2 is None else m2
        for r in range(rounds):
            if r % 2 == 0:
                odd = _crc32_on(crc[ids], f":{r // 2 + 100 * level}") % 2
            found = list(graph.moves(c, odd == r % 2, k, np.bincount(c, k, n), m2, resolution))
            for v, to in found:
                c[v] = to
            moved = any(len(v) for v, _ in found)
            any_move |= moved
            if not moved and r % 2:
                break
        if not any_move:
            break
        name = np.full(n, n)
        np.minimum.at(name, c, np.arange(n))
        kept, label = np.unique(name[c], return_inverse=True)
        member, ids = label[member], ids[kept]
        if level + 1 < levels:
            graph = graph.merged(label, len(ids))
    return ids[member]


#: The table of CRC-32 by bytes.
_CRC = np.array([~zlib.crc32(bytes([k ^ 255])) & 0xFFFFFFFF ^ 0xFFFFFF for k in range(256)], np.uint32)


def _crc32_on(crc: np.ndarray, text: str) -> np.ndarray:
    """CRC-32 of texts of the given CRC-32 followed by ``text``."""
    crc = ~crc
    for x in text.encode():
        crc = _CRC[(crc ^ np.uint32(x)) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return ~crc


def _starts(v: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.append(True, v[1:] != v[:-1])[: len(v)])


def _summed(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weights of equal pairs of numbers below ``n``, added up in order of the pairs."""
    if not len(a):
        return a, b, w
    key = a.astype(np.int64)
    key *= n
    key += b
    del a, b
    order = np.argsort(key, kind="stable")
    key, w = key[order], w[order]
    del order
    first = _starts(key)
    key, w = key[first], np.add.reduceat(w, first)
    return key // n, key % n, w


def community_levels(
    entities: DataFrame, edges: DataFrame, resolutions: tuple[float, ...] = (0.5, 1.0, 2.0), min_size: int = 3, link: float = 0.3
) -> DataFrame:
    """(id, level, entity_ids, parent_id, child_ids): communities at each resolution, the lowest first, linked to those of the next level.

    Ids depend on level and members only. Without edges all entities are one community if they are enough;
    fewer than two communities' worth of entities run once, at resolution 1.
    """
    ids = entities.select("id").where("id is not null").distinct()
    n = ids.count()
    wanted = [1.0] if n < 2 * min_size or edges.isEmpty() else sorted(resolutions)
    # A community's members are one list, as in the stored table.
    found = communities_at(ids, edges, wanted, min_size).groupBy("level", "community").agg(F.array_sort(F.collect_set("id")).alias("entity_ids"))
    level_id = F.concat(F.lit("comm:"), F.col("level"), F.lit(":"), F.substring(F.sha2(F.array_join("entity_ids", "\0"), 256), 1, 10))
    found = cut(found.select(level_id.alias("id"), "level", "entity_ids"))
    links = cut(level_links(found, link).select(F.col("child_id").alias("id"), "parent_id"))
    children = links.groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_set("id")).alias("child_ids"))
    none = F.array().cast("array<string>")
    return found.join(links, "id", "left").join(children, "id", "left").select("id", "level", "entity_ids", "parent_id", F.coalesce("child_ids", none).alias("child_ids"))


def link_report(communities: DataFrame, least: float = 0.3, split: float = 0.7) -> DataFrame:
    """(id, level, state, share) of communities whose tie to the next level is weak: 'split' below ``split``, 'orphan' without a parent."""
    top = communities.agg(F.max("level").alias("top"))
    below = communities.select("id", "level").join(F.broadcast(top), F.lit(True)).where("level < top").drop("top")
    links = level_links(communities, least).select(F.col("child_id").alias("id"), "share")
    state = F.when(F.col("share").isNull(), "orphan").when(F.col("share") < split, "split")
    return below.join(links, "id", "left").select("id", "level", state.alias("state"), F.round("share", 6).alias("share")).where("state is not null")


def hubs(relations: DataFrame, top: int = 3) -> DataFrame:
    """(id, degree, place) of the entities with most distinct neighbours; ties by id."""
    pairs = relations.where("source_id <> target_id").select(F.col("source_id").alias("id"), F.col("target_id").alias("other"))
    both = pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other")))
    best = both.groupBy("id").agg(F.countDistinct("other").alias("degree")).orderBy(F.desc("degree"), "id").limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("degree"), "id")))


def reused_summaries(new: DataFrame, old: DataFrame, least: float = 0.7) -> DataFrame:
    """(id, old_id, title, summary) of the communities that can take over a summary: that of the same id, else of the nearest set above ``least``.

    ``new``: id, level, entity_ids; ``old`` also title and summary. A nearest set without a summary gives none.
    """
    said = old.where(F.coalesce(F.trim("summary") != "", F.lit(False))).select(F.col("id").alias("old_id"), "title", "summary")
    same = new.select("id").join(said.withColumn("id", F.col("old_id")), "id").select("id", "old_id", "title", "summary")
    rest = new.join(same.select("id"), "id", "left_anti")
    near = jaccard_matches(rest, old, least).join(said, "old_id").select("id", "old_id", "title", "summary")
    return same.unionByName(near)


def community_id(level: int, ids: F.Column) -> F.Column:
    """Content id of a community: it depends on the members only."""
    return F.concat(F.lit(f"comm:{level}:"), F.substring(F.sha2(F.array_join(F.array_sort(ids), "\0"), 256), 1, 10))


def level_links(communities: DataFrame, least: float = 0.3) -> DataFrame:
    """(child_id, parent_id, overlap, share): each community's best match one level up, where more than ``least`` of it lies there."""
    m = communities.select("id", "level", F.explode(F.array_distinct("entity_ids")).alias("e"))
    size = communities.select(F.col("id").alias("child_id"), F.size(F.array_distinct("entity_ids")).alias("n"))
    child, parent = m.select(F.col("id").alias("child_id"), (F.col("level") + 1).alias("level"), "e"), m.select(F.col("id").alias("parent_id"), "level", "e")
    over = child.join(parent, ["level", "e"]).groupBy("child_id", "parent_id").agg(F.count(F.lit(1)).alias("overlap"))
    best = over.groupBy("child_id").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "parent_id")).alias("b"))
    rows = best.join(size, "child_id").select("child_id", "b.parent_id", (-F.col("b.o")).alias("overlap"), (-F.col("b.o") / F.col("n")).alias("share"))
    return rows.where(F.col("share") > least)


def jaccard_matches(new: DataFrame, old: DataFrame, least: float = 0.7) -> DataFrame:
    """(id, old_id, jaccard): the most similar old set of the same level, above ``least``. Both: id, level, entity_ids."""
    def sets(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("id").alias(name), "level", F.array_distinct("entity_ids").alias("s")).select(name, "level", F.size("s").alias(f"n_{name}"), F.explode("s").alias("e"))

    over = sets(new, "id").join(sets(old, "old_id"), ["level", "e"]).groupBy("id", "old_id", "n_id", "n_old_id").agg(F.count(F.lit(1)).alias("o"))
    over = over.select("id", "old_id", (F.col("o") / (F.col("n_id") + F.col("n_old_id") - F.col("o"))).alias("jaccard")).where(F.col("jaccard") > least)
    return over.groupBy("id").agg(F.min(F.struct((-F.col("jaccard")).alias("j"), "old_id")).alias("b")).select("id", "b.old_id", (-F.col("b.j")).alias("jaccard"))

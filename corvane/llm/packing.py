"""Filling containers of fixed capacity.

Method: mixture-controlled packing. Items queue by source; deficit round-robin fills one window
after the other to the target token proportions of the sources, and what a source got too little or
too much of is carried to the next window. Blocks of items are packed by tasks of their own: the
deficits at the start of a block are those that all blocks before it leave, from sums per block and
source. Within a window the largest items are placed first, each in the open container with the
least room that holds it; open containers are carried from window to window.

Items above the capacity are cut into full containers and a rest; others are never cut.

Defined results
    empty items (size 0 or null): one row of size 0 in a container. Null source: a source of its own.
    repeated ids: each row is an item; of equal rows too many for one block some go to further blocks.
    Empty tables: no rows. Ties: by id.
    ``container``: block number * 2^32 + number within the block.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Items that one task packs (about 200 bytes each in Python).
BLOCK_ITEMS = 50_000
#: Containers that a window fills.
WINDOW = 64


def deficit_round_robin(queues: dict[int, deque], weights: dict[int, float], deficit: dict[int, float], budget: float):
    """Windows of (source, index) drawn from the queues of (index, size), until they are empty.

    A source may draw while its deficit is positive; what it draws is taken from it, so the
    overdraft or the rest stays with the source for the next window.
    """
    while queues:
        active = sum(weights[s] for s in queues) or 1.0
        for s in queues:
            deficit[s] += budget * (weights[s] / active if sum(weights[x] for x in queues) else 1 / len(queues))
        window, filled = [], 0.0
        order = sorted(queues, key=lambda s: (-deficit[s], s))
        while order and filled < budget:
            still = []
            for s in order:
                q = queues.get(s)
                if q and (deficit[s] > 0 or q[0][1] == 0):
                    i, size = q.popleft()
                    window.append(i)
                    deficit[s] -= size
                    filled += size
                    if q:
                        still.append(s)
                    else:
                        del queues[s]
            order = still
        if window:
            yield window


class Containers:
    """Best fit: of the open containers the one with the least room that is enough."""

    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0

    def place(self, size: int) -> tuple[int, int]:
        """(container, offset) of an item of at most the capacity."""
        fits = self.mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            c = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask &= ~(1 << room)
        else:
            c, room = self.n, self.capacity
            self.n += 1
        self.by_room[room - size].append(c)
        self.mask |= 1 << (room - size)
        return c, self.capacity - room


def _pack(block: pd.DataFrame, capacity: int, window: int) -> pd.DataFrame:
    block = block.sort_values(["id", "size", "source"], kind="stable", na_position="first").reset_index(drop=True)
    code = pd.factorize(block["source"], sort=True, use_na_sentinel=False)[0]
    sizes = block["size"].to_numpy()
    queues: dict[int, deque] = {}
    for i, (s, n) in enumerate(zip(code.tolist(), sizes.tolist())):
        queues.setdefault(s, deque()).append((i, n))
    first = np.unique(code, return_index=True)[1]
    weights = {s: float(block["weight"].iloc[i]) for s, i in enumerate(first.tolist())}
    deficit = {s: float(block["deficit"].iloc[i]) for s, i in enumerate(first.tolist())}
    box, rows = Containers(capacity), []
    for w, members in enumerate(deficit_round_robin(queues, weights, deficit, float(window * capacity))):
        parts = []
        for i in members:
            n = int(sizes[i])
            full, rest = divmod(n, capacity)
            parts += [(capacity, i, p) for p in range(full)]
            if rest or not full:
                parts.append((rest, i, full))
        for n, i, p in sorted(parts, key=lambda x: (-x[0], x[1], x[2])):
            c, at = box.place(n)
            rows.append((i, p, c, at, n, w))
    out = pd.DataFrame(rows, columns=["i", "piece", "c", "at", "n_tokens", "win"])
    return pd.DataFrame({
        "id": block["id"].to_numpy()[out["i"]], "source": block["source"].to_numpy()[out["i"]], "piece": out["piece"], "start": out["piece"] * capacity, "n_tokens": out["n_tokens"],
        "container": (int(block["block"].iloc[0]) << 32) + out["c"], "at": out["at"], "win": out["win"],
    })


def _spread(rows: DataFrame, blocks: int, block_items: int) -> DataFrame:
    """The rows, those of a block that equal rows made too large on blocks of their own number."""
    large = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * block_items).collect()  # fewer than blocks / 2
    if not large:
        return rows
    more = -(-sum(r["n"] for r in large) // block_items)
    further = F.lit(blocks) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(more))
    return rows.withColumn("block", F.when(F.col("block").isin([r["block"] for r in large]), further).otherwise(F.col("block")))


#: Blocks whose sums one task adds up.
_SPAN = 1024


def _sums_before(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the blocks before, within ``by``: over spans of blocks, then over the spans' totals."""
    placed = rows.withColumn("_span", F.floor(F.col("block") / _SPAN))
    inner = Window.partitionBy(*by, "_span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.groupBy(*by, "_span").agg(F.sum(value).alias("_all"))
    spans = spans.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_span").alias("_s"), F.coalesce(F.sum("_all").over(outer), F.lit(0)).alias("_before"))
    same = F.col("_span") == F.col("_s")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    joined = placed.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(spans, same)
    return joined.withColumn(name, F.col("_in") + F.col("_before")).select(*rows.columns, name)


def mixture(packed: DataFrame, target: DataFrame) -> DataFrame:
    """(block, win, source, got, wanted): tokens of each source up to and with each window, and what the target asks of the block so far.

    ``target``: (source, weight). A source is owed its share of every window of its block until it has run out.
    """
    per = packed.groupBy(F.shiftright("container", 32).alias("block"), "win", "source").agg(F.sum("n_tokens").alias("tokens"))
    last = per.groupBy("block", "source").agg(F.max("win").alias("last"))
    windows = per.groupBy("block", "win").agg(F.sum("tokens").alias("all"))
    t = target.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
    owed = windows.join(last, "block").where("win <= last").join(t, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop("_s")
    among = Window.partitionBy("block", "win")
    share = F.try_divide(F.col("weight"), F.sum("weight").over(among))
    owed = owed.withColumn("share", F.coalesce(share, 1 / F.count(F.lit(1)).over(among)) * F.col("all"))
    p = per.select(F.col("block").alias("_b"), F.col("win").alias("_w"), F.col("source").alias("_s"), "tokens")
    rows = owed.join(p, (F.col("block") == F.col("_b")) & (F.col("win") == F.col("_w")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    upto = Window.partitionBy("block", "source").orderBy("win")
    return rows.select("block", "win", "source", F.sum(F.coalesce("tokens", F.lit(0))).over(upto).alias("got"), F.sum("share").over(upto).alias("wanted"))


def pack(
    items: DataFrame,
    capacity: int = 2048,
    id_col: str = "doc_id",
    size_col: str = "n_tokens",
    source_col: str = "source",
    target: DataFrame | None = None,
    window: int = WINDOW,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """(id, source, piece, start, n_tokens, container, at, win) of every piece; ``at`` is its place in the container.

    ``target``: (source, weight) proportions; by default those of all items.
    """
    kind = dict(items.dtypes)[id_col]
    rows = cut(items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size"), F.col(source_col).cast("string").alias("source")))
    blocks = max(1, -(-rows.count() // block_items))
    # The size takes part in the hash so that rows that share an id spread, too.
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "size", "source"), F.lit(blocks)).cast("long"))
    rows = _spread(rows, blocks, block_items)
    per = rows.groupBy("block", "source").agg(F.sum("size").alias("tokens"))
    totals = per.groupBy("source").agg(F.sum("tokens").alias("weight"))
    if target is not None:
        wanted = target.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("_w"))
        totals = totals.join(wanted, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", F.coalesce("_w", F.lit(0.0)).alias("weight"))
    whole = totals.agg(F.sum("weight").alias("all"))
    totals = totals.crossJoin(F.broadcast(whole)).select(F.col("source").alias("s2"), F.coalesce(F.try_divide(F.col("weight"), F.col("all")), F.lit(0.0)).alias("weight"))
    # What the blocks before left a source short of (or gave it too much), by running sums over the blocks.
    in_block = per.groupBy("block").agg(F.sum("tokens").alias("block_tokens"))
    in_block = _sums_before(in_block, [], "block_tokens", "all_before").select("block", "all_before")
    start = (
        _sums_before(per, ["source"], "tokens", "own_before")
        .join(in_block, "block")
        .join(totals, F.col("source").eqNullSafe(F.col("s2")))
        .select(F.col("block").alias("b2"), F.col("source").alias("s3"), "weight", (F.col("weight") * F.col("all_before") - F.col("own_before")).alias("deficit"))
    )
    ready = rows.join(start, (F.col("block") == F.col("b2")) & F.col("source").eqNullSafe(F.col("s3"))).select("id", "size", "source", "block", "weight", "deficit")
    schema = f"id {kind}, source string, piece int, start long, n_tokens long, container long, at int, win int"
    return ready.groupBy("block").applyInPandas(lambda block: _pack(block, capacity, window), schema).withColumnRenamed("id", id_col)

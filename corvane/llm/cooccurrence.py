"""Items that appear together.

Method: blocked Gram matrix. Items that can reach the support get a block and a place in it; each
basket becomes one sparse binary row per item block. A task takes a block of such rows and sums the
transpose-products of the row block for every pair of item blocks; the partial sums add up by
pair, and counts are then set against the product of the marginals.

No pair list of a basket ever exists as rows: a task emits one row per distinct pair it has seen.
A basket that is wide is cut along the item blocks and into slices of ``WIDE`` items, and the
products of its slices are spread over tasks.

Defined results
    null or blank baskets and items: neither. Repeated items of a basket: one. Baskets without
    items count in ``n_baskets``. Pairs are (a, b) with a < b in code point order.
    empty tables: no pairs. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import norm_path
from ..session import cut

#: Items per item block; bounds the sparse row of a basket that one group gathers.
BLOCK_ITEMS = 65_536
#: Slices of at most so many items of one basket are multiplied with each other in one task.
WIDE = 256
#: Up to so many items, and bytes of their names, the item table is broadcast; beyond, it is joined by shuffle.
BROADCAST_ITEMS, BROADCAST_BYTES = 200_000, 16_000_000
#: Pairs a task holds before it sums them up.
_HELD = 2_000_000


def _products(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of products of (lb, li, rb, ri) rows; ri is null on the diagonal, where each pair counts once."""
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    n_held = 0

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        u, inv = np.unique(codes, return_inverse=True)
        return u, np.bincount(inv, weights=counts, minlength=len(u)).astype(np.int64)

    def out(key: tuple[int, int], codes: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": (codes >> 31) + (key[0] << 33), "b": (codes & 0x7FFFFFFF) + (key[1] << 33), "n": counts})

    def hold(key: tuple[int, int], codes: np.ndarray) -> int:
        u, c = np.unique(codes, return_counts=True)
        held.setdefault(key, []).append((u, c))
        return len(u)

    for batch in rows:
        groups: dict[tuple[int, int, int, int], list] = {}
        for lb, li, rb, ri in zip(batch["lb"], batch["li"], batch["rb"], batch["ri"]):
            groups.setdefault((lb, rb, len(li), -1 if ri is None else len(ri)), []).append((li, ri))
        for (lb, rb, nl, nr), members in groups.items():
            per = nl * (nl - 1) // 2 if nr < 0 else nl * nr
            if not per:
                continue
            step = max(1, _HELD // per)
            up = np.triu_indices(nl, 1)
            for i in range(0, len(members), step):
                left = np.sort(np.stack([m[0] for m in members[i : i + step]]).astype(np.int64), axis=1)
                if nr < 0:
                    codes = (left[:, up[0]] << 31) | left[:, up[1]]
                else:
                    right = np.stack([m[1] for m in members[i : i + step]]).astype(np.int64)
                    a, b = np.broadcast_arrays(left[:, :, None], right[:, None, :])
                    if lb == rb:
                        a, b = np.minimum(a, b), np.maximum(a, b)
                    codes = (a << 31) | b
                n_held += hold((lb, rb), codes.ravel())
                if n_held >= _HELD:
                    n_held = 0
                    for key, parts in held.items():
                        held[key] = [summed(parts)]
                        n_held += len(held[key][0][0])
                    if n_held >= _HELD // 2:
                        for key, parts in held.items():
                            yield out(key, *parts[0])
                        held, n_held = {}, 0
    for key, parts in held.items():
        yield out(key, *summed(parts))


def pair_counts(pairs: DataFrame, min_together: int = 1) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b) of all items with at least ``min_together`` common baskets.

    ``pairs``: (basket, item), repeats allowed. An item in fewer baskets than that can't be in a
    result, so it is left out before any product.
    """
    spark = pairs.sparkSession
    # Summed by (basket, item) first: a repeated row or a hot basket is small before it is shuffled.
    seen = cut(pairs.where("basket is not null and item is not null").select("basket", "item").distinct())
    counts = cut(seen.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_together))
    n_items, n_bytes = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()
    small = n_items <= BROADCAST_ITEMS and n_bytes <= BROADCAST_BYTES
    if not n_items:
        return spark.createDataFrame([], "item_a string, item_b string, n_ab long, n_a long, n_b long")
    blocks = -(-n_items // BLOCK_ITEMS)
    # Frequent items share blocks, so that most baskets lie in few of them.
    ranged = counts.repartitionByRange(blocks, F.desc("n"), "item") if blocks > 1 else counts.coalesce(1)
    items = cut(ranged.withColumn("id", F.monotonically_increasing_id()))
    lookup = items.select("item", "id")
    if small:
        lookup = F.broadcast(lookup)
    rows = cut(
        seen.join(lookup, "item")
        .groupBy("basket", F.shiftright("id", 33).cast("int").alias("block"))
        .agg(F.sort_array(F.collect_list(F.col("id").bitwiseAND((1 << 33) - 1).cast("int"))).alias("items"))
    )
    n_slices = F.ceil(F.size("items") / F.lit(WIDE)).cast("int")
    sliced = rows.select(
        "basket", "block", F.posexplode(F.transform(F.sequence(F.lit(0), n_slices - 1), lambda i: F.slice("items", i * WIDE + 1, F.lit(WIDE)))).alias("part", "items")
    )
    none = F.lit(None).cast("array<int>")
    diagonal = sliced.where(F.size("items") > 1).select(F.col("block").alias("lb"), F.col("items").alias("li"), F.col("block").alias("rb"), none.alias("ri"))
    products = diagonal.mapInPandas(_products, "a long, b long, n long")
    # Slices of the same basket: only baskets with several blocks or slices take part.
    is_wide = rows.groupBy("basket").agg(F.sum(n_slices).alias("k")).where("k > 1").select("basket")
    if blocks > 1 or rows.where(F.size("items") > WIDE).limit(1).count():
        wide = sliced.join(is_wide, "basket", "left_semi")
        left = wide.select("basket", F.col("block").alias("lb"), F.col("part").alias("lp"), F.col("items").alias("li"))
        right = wide.select("basket", F.col("block").alias("rb"), F.col("part").alias("rp"), F.col("items").alias("ri"))
        cross = left.join(right, "basket").where("lb < rb or (lb = rb and lp < rp)").select("lb", "li", "rb", "ri")
        spread = cross.repartition(spark.sparkContext.defaultParallelism * 4, F.xxhash64("li", "ri"))
        products = products.unionByName(spread.mapInPandas(_products, "a long, b long, n long"))
    together = products.groupBy("a", "b").agg(F.sum("n").alias("n_ab")).where(F.col("n_ab") >= min_together)
    a = items.select(F.col("id").alias("a"), F.col("item").alias("ia"), F.col("n").alias("na"))
    b = items.select(F.col("id").alias("b"), F.col("item").alias("ib"), F.col("n").alias("nb"))
    if small:
        a, b = F.broadcast(a), F.broadcast(b)
    named = together.join(a, "a").join(b, "b")
    swap = F.col("ia") > F.col("ib")
    return named.select(
        F.least("ia", "ib").alias("item_a"),
        F.greatest("ia", "ib").alias("item_b"),
        "n_ab",
        F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("n_a"),
        F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("n_b"),
    )


def commit_baskets(commits: DataFrame) -> tuple[DataFrame, int]:
    """((basket, item) of the files of each commit, number of commits). Hashes with more than one parent don't count."""
    merge = F.coalesce(F.size("parent_hashes") > 1, F.lit(False))
    hashes = commits.where("hash is not null").select("hash", merge.alias("m")).groupBy("hash").agg(F.bool_or("m").alias("some"), F.bool_and("m").alias("all"))
    n, mixed = hashes.agg(F.count_if(~F.col("some")), F.count_if(F.col("some") & ~F.col("all"))).first()
    rows = commits.where(F.col("hash").isNotNull() & ~merge)
    if mixed:
        # Hashes whose rows disagree on the parents count as merges in all their rows.
        rows = rows.join(hashes.where("some and not all").select("hash"), "hash", "left_anti")
    return rows.select(F.col("hash").alias("basket"), F.explode("files_changed.path").alias("path")).select("basket", norm_path(F.col("path")).alias("item")), n


def with_lift(pairs: DataFrame, n_baskets: int) -> DataFrame:
    """Adds how much more often than by chance the items are together."""
    return pairs.withColumn("lift", F.col("n_ab") * F.lit(float(n_baskets)) / (F.col("n_a").cast("double") * F.col("n_b")))

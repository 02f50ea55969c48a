import itertools
import random
from collections import Counter

import pytest

from corvane.llm import cooccurrence as C


def brute(rows, least):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n, ab = Counter(), Counter()
    for s in baskets.values():
        n.update(s)
        ab.update(itertools.combinations(sorted(s), 2))
    return {(a, b, k, n[a], n[b]) for (a, b), k in ab.items() if k >= least}


@pytest.mark.parametrize("least", [1, 3])
@pytest.mark.parametrize("block,wide", [(C.BLOCK_ITEMS, C.WIDE), (7, 3), (1000, 5)])
def test_pairs_equal_brute_force(spark, monkeypatch, least, block, wide):
    monkeypatch.setattr(C, "BLOCK_ITEMS", block)
    monkeypatch.setattr(C, "WIDE", wide)
    monkeypatch.setattr(C, "BROADCAST_ITEMS", 10 if block == 7 else 200_000)
    rng = random.Random(3)
    rows = [(f"b{rng.randrange(40)}", f"i{int(rng.random() ** 2 * 60)}") for _ in range(600)]
    rows += [("wide", f"i{k}") for k in range(50)] + rows[:50] + [(None, "i1"), ("b1", None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "basket string, item string, a int, n int")
    got = [tuple(r) for r in C.pair_counts(df, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, least)


def test_small_held_sums(spark, monkeypatch):
    monkeypatch.setattr(C, "_HELD", 40)
    import pandas as pd

    frames = [pd.DataFrame({"lb": [0] * 9, "li": [list(range(k, k + 6)) for k in range(9)], "rb": [0] * 9, "ri": [None] * 9}) for _ in range(3)]
    total = Counter()
    for part in C._products(iter(frames)):
        for r in part.itertuples():
            total[(r.a, r.b)] += r.n
    want = Counter(p for k in range(9) for p in itertools.combinations(range(k, k + 6), 2) for _ in range(3))
    assert total == want


def test_empty_and_singles(spark):
    none = spark.createDataFrame([], "basket string, item string")
    assert C.pair_counts(none).count() == 0
    assert C.pair_counts(spark.createDataFrame([("a", "x"), ("b", "y" * 90_000)], none.schema)).count() == 0


def test_commit_baskets(spark):
    f = "array<struct<path:string,old_path:string,status:string,additions:bigint,deletions:bigint,diff:string>>"
    files = lambda *ps: [(p, None, "m", 1, 1, None) for p in ps]
    data = [
        ("h1", ["p"], files("./a", "b\\c", "a", None, " ")), ("h1", ["p"], files("a", "d")), ("merge", ["p", "q"], files("a", "b/c")),
        ("mixed", ["p"], files("a", "b/c")), ("mixed", ["p", "q"], files("a", "b/c")), ("none", None, None), ("empty", [], []), (None, ["p"], files("a", "b/c")),
    ]
    df = spark.createDataFrame([(*d, 1) for d in data], f"hash string, parent_hashes array<string>, files_changed {f}, basket int")
    pairs, n = C.commit_baskets(df)
    assert n == 3
    assert {tuple(r) for r in C.pair_counts(pairs).collect()} == {("a", "b/c", 1, 1, 1), ("a", "d", 1, 1, 1), ("b/c", "d", 1, 1, 1)}
    lift = C.with_lift(C.pair_counts(pairs), n).head()["lift"]
    assert lift == 3.0

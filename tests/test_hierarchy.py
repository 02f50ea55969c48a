import random

import pytest

from corvane.operators import hierarchy as H

SCHEMA = "id string, parent_id string, child_ids array<string>, level int, parent string, top string, root_id string"


def nodes(spark, data):
    return spark.createDataFrame([(i, p, c, 0, "x", "x", "x") for i, p, c in data], SCHEMA)


def brute(data):
    """(root, depth, path) by walking, for ids given in their normal form."""
    own, listed, ids = {}, {}, {i for i, _, _ in data if i}
    for i, p, c in data:
        if i and p:
            own[i] = min(own.get(i, p), p)
        for x in c or []:
            if i and x:
                listed[x] = min(listed.get(x, i), i)
    parent = {i: (own.get(i) or listed.get(i)) for i in ids}
    parent = {i: p if p in ids else None for i, p in parent.items()}
    out = {}
    for i in ids:
        path, at = [i], i
        while parent[at] and parent[at] not in path:
            at = parent[at]
            path.append(at)
        if parent[at]:
            out[i] = (min(path[path.index(parent[at]) :]), -1, None)
        else:
            out[i] = (at, len(path) - 1, path[::-1])
    return out, parent


@pytest.mark.parametrize("block", [H.BLOCK_ROWS, 0, 7])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_cycles(spark, monkeypatch, block, seed):
    rng = random.Random(seed)
    data = []
    for k in range(120):
        p = f"n{rng.randrange(k)}" if k and rng.random() < 0.9 else None
        data.append((f"n{k}", p, [f"n{rng.randrange(140)}" for _ in range(rng.randrange(2))]))
    for a, b in (("n3", "n40"), ("n40", "n80"), ("n80", "n3"), ("n100", "n100"), ("n7", "n101"), ("n101", "n7")):
        data = [x for x in data if x[0] != a] + [(a, b, [])]
    data += [(f"c{k}", f"c{k + 1}", None) for k in range(90)]  # a long chain whose end has no row
    data += [(None, "n1", ["n2"]), ("n5", None, None)]
    want, parent = brute(data)
    got = {r.id: (r.root_id, r.depth, r.path) for r in H.hierarchy(nodes(spark, data).repartition(5), block).collect()}
    assert got == want
    links = H.parents(nodes(spark, data)).where("parent is not null")
    assert {r.id for r in links.collect()} == {i for i, p in parent.items() if p}


def test_spelling_conflicts_and_missing_parents(spark):
    data = [
        (" A", None, ["B ", None, ""]), ("b", None, None), ("B", " ", None), ("c", "a", ["d"]), ("d", "A", None),
        ("e", "nobody", None), ("a", None, ["e"]), ("f", None, ["c"]), ("self", "SELF ", None), ("under", "self", None), (" ", "a", None),
    ]
    got = {r.id: (r.root_id, r.depth, r.path) for r in H.hierarchy(nodes(spark, data)).collect()}
    assert got == {
        "a": ("a", 0, ["a"]), "b": ("a", 1, ["a", "b"]), "c": ("a", 1, ["a", "c"]), "d": ("a", 1, ["a", "d"]), "e": ("e", 0, ["e"]), "f": ("f", 0, ["f"]),
        "self": ("self", -1, None), "under": ("self", -1, None),
    }
    pairs = {(r.id, r.descendant_id, r.distance) for r in H.descendants(nodes(spark, data)).collect()}
    assert pairs == {("a", "b", 1), ("a", "c", 1), ("a", "d", 1)}


def test_empty_and_hot_parent(spark):
    assert H.hierarchy(nodes(spark, [])).count() == 0
    data = [("hub", None, None)] + [(f"x{k}", "hub", None) for k in range(400)] + [("y" * 50_000, "x1", None)]
    for block in (H.BLOCK_ROWS, 10):
        got = H.hierarchy(nodes(spark, data), block)
        assert got.where("root_id = 'hub'").count() == 402 and got.where("depth = 2").count() == 1


@pytest.mark.parametrize("block", [100, 40])
def test_the_last_block_is_one_whatever_its_size(spark, monkeypatch, block):
    monkeypatch.setattr(H, "BLOCK_ROWS", 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        data = [(f"n{k:02}", f"n{k + 1:02}", None) for k in range(60)] + [("n60", None, None)]
        data += [(f"r{k}", f"r{(k + 1) % 9}", None) for k in range(9)] + [("u", "r4", None)]
        random.Random(3).shuffle(data)
        want, _ = brute(data)
        got = {r.id: (r.root_id, r.depth, r.path) for r in H.hierarchy(nodes(spark, data).repartition(4), block).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want

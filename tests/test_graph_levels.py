import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import analytics as A
from corvane.operators import graph_algorithms as G
from corvane.operators import search as S
from corvane.operators.references import SALTS, Parent, ReferenceCheck, Referrer


def edges(spark, pairs):
    return spark.createDataFrame([(min(p), max(p), 1.0) for p in pairs], "a string, b string, weight double")


def ids(spark, n):
    return spark.createDataFrame([(f"n{k:02}",) for k in range(n)], "id string")


def clique(names):
    return [(a, b) for a in names for b in names if a < b]


def test_levels_are_linked_and_named_by_their_members(spark):
    left, right = [f"n{k:02}" for k in range(5)], [f"n{k:02}" for k in range(5, 10)]
    found = G.community_levels(ids(spark, 10), edges(spark, clique(left) + clique(right) + [("n04", "n05")])).collect()
    again = G.community_levels(ids(spark, 10).orderBy(F.desc("id")), edges(spark, clique(right) + [("n04", "n05")] + clique(left))).collect()
    assert {r.id for r in found} == {r.id for r in again} and len({r.id for r in found}) == len(found)
    assert {r.level for r in found} == {0, 1, 2} and {tuple(r.entity_ids) for r in found if r.level == 1} == {tuple(left), tuple(right)}
    by = {r.id: r for r in found}
    for r in found:
        if r.level < 2:
            assert by[r.parent_id].level == r.level + 1 and r.id in by[r.parent_id].child_ids
        else:
            assert r.parent_id is None
    assert {tuple(r.entity_ids): r.id for r in found if r.level == 1}[tuple(left)].startswith("comm:1:")


@pytest.mark.parametrize(("n", "pairs", "want"), [(0, [], []), (2, [], []), (4, [], [4]), (5, [("n00", "n01"), ("n01", "n02"), ("n00", "n02")], [3])])
def test_guards(spark, n, pairs, want):
    found = G.community_levels(ids(spark, n), edges(spark, pairs)).collect()
    assert [(r.level, len(r.entity_ids), r.parent_id, r.child_ids) for r in found] == [(0, w, None, []) for w in want]


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    got = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def blocks(spark, n, size=50):
    """A graph of ``n`` edges in rings of ``size`` nodes with chords, and its nodes."""
    k = F.col("id")
    node = lambda c: F.format_string("n%06d", c)
    base, at = F.floor(k / (2 * size)) * size, k % size
    other = (at + F.when(k % (2 * size) < size, 1).otherwise(7)) % size
    e = spark.range(n).select(node(base + F.least(at, other)).alias("a"), node(base + F.greatest(at, other)).alias("b"), F.lit(1.0).alias("weight"))
    return spark.range(n // 2).select(node(k).alias("id")), e


def test_a_graph_of_many_edges_is_moved_and_joined_in_few_jobs(spark):
    nodes, e = blocks(spark, 120_000)
    e = e.localCheckpoint()
    found, n = jobs_of(spark, "moved", lambda: {r.id: r.community for r in G.communities(nodes, e, min_size=1).collect()})
    parts, m = jobs_of(spark, "parts", lambda: {r.id: r.component for r in G.components(nodes, e).collect()})
    assert len(found) == len(parts) == 60_000 and n < 20 and m < 10
    # No community leaves its ring, and no ring is torn or joined.
    assert all(int(k[1:]) // 50 == int(c[1:]) // 50 for k, c in found.items())
    assert all(int(c[1:]) == int(k[1:]) // 50 * 50 for k, c in parts.items())


def test_levels_of_many_edges_take_few_jobs(spark):
    nodes, e = blocks(spark, 120_000)
    e = e.localCheckpoint()
    found, n = jobs_of(spark, "levels", lambda: G.community_levels(nodes, e).select("level", F.size("entity_ids").alias("n")).collect())
    assert n < 40 and {r.level for r in found} == {0, 1, 2} and all(3 <= r.n <= 50 for r in found)


def test_a_graph_too_large_for_one_task_is_moved_in_blocks(spark, monkeypatch):
    nodes, e = blocks(spark, 3_000)
    # A hub, and ends of uneven weight.
    hub = spark.range(0, 1_500, 3).select(F.lit("hub").alias("a"), F.format_string("n%06d", "id").alias("b"), (F.col("id") % 7 / 5).alias("weight"))
    nodes, e = nodes.unionByName(spark.createDataFrame([("hub",), ("alone",)], "id string")), e.unionByName(hub).localCheckpoint()
    found = lambda: sorted(map(tuple, G.communities_at(nodes, e, [0.5, 1.0, 2.0], 1).select("level", "id", "community").collect()))
    one = found()
    assert len(one) == 3 * 1_502
    monkeypatch.setattr(G, "SMALL_GRAPH", 0)
    monkeypatch.setattr(G, "BLOCK_ENDS", 900)
    joins, _ = G._by_joins, monkeypatch.setattr(G, "_by_joins", None)
    assert found() == one
    # Too many nodes for the driver: rounds of joins.
    monkeypatch.setattr(G, "_by_joins", joins)
    monkeypatch.setattr(G, "ARRAY_NODES", 5)
    small = edges(spark, clique(["n00", "n01", "n02"]) + clique(["n03", "n04", "n05"]) + [("n02", "n03")])
    assert {r.id: r.community for r in G.communities(ids(spark, 6), small, rounds=4, levels=2).collect()} == {f"n{k:02}": "n00" if k < 3 else "n03" for k in range(6)}


def test_moves_don_t_depend_on_slices(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 60, (2, 400))
    ends = G._summed(np.append(a, b), np.append(b, a), np.ones(800), 60)
    crc = np.array([zlib.crc32(b"n%d" % k) for k in range(60)], np.uint32)
    assert [zlib.crc32(b"n%d:103" % k) for k in range(60)] == list(G._crc32_on(crc, ":103"))
    whole = G._moved(G._Ends(*ends, 60), crc, 1.0, 4, 8)
    monkeypatch.setattr(G, "SLICE_ENDS", 7)
    assert (G._moved(G._Ends(*ends, 60), crc, 1.0, 4, 8) == whole).all() and 1 < len(set(whole)) < 60


def test_components_on_arrays_are_those_of_joins(spark, monkeypatch):
    e = edges(spark, [("n00", "n03"), ("n03", "n05"), ("n01", "gone"), ("gone", "n02"), ("n04", "n04"), ("n06", "n07"), ("n07", "n08"), ("n06", "n08")])
    one = {r.id: r.component for r in G.components(ids(spark, 10), e).collect()}
    monkeypatch.setattr(G, "SMALL_GRAPH", 0)
    assert {r.id: r.component for r in G.components(ids(spark, 10), e).collect()} == one
    assert one["n05"] == "n00" and one["n02"] == "n02" and one["n08"] == "n06"


def test_link_report_and_reuse(spark):
    rows = [("a", 0, ["x", "y", "z"], "A", "said a"), ("b", 0, ["p", "q", "r", "s"], "B", " "), ("c", 0, ["u"], "C", "said c"), ("top", 1, ["x", "y", "p", "q"], "T", "said t")]
    c = spark.createDataFrame(rows, "id string, level int, entity_ids array<string>, title string, summary string")
    got = {(r.id, r.state, r.share) for r in G.link_report(c).collect()}
    assert got == {("a", "split", round(2 / 3, 6)), ("b", "split", 0.5), ("c", "orphan", None)}
    new = spark.createDataFrame([("a", 0, ["other"]), ("n", 0, ["p", "q", "r", "s", "t"]), ("m", 0, ["u", "v"]), ("k", 1, ["x", "y", "p", "q", "w"])], "id string, level int, entity_ids array<string>")
    # The same id first; a near set without a summary gives none; half the members aren't near.
    assert {tuple(r) for r in G.reused_summaries(new, c).collect()} == {("a", "a", "A", "said a"), ("k", "top", "T", "said t")}


def test_path_steps_hubs_and_lookups(spark):
    rel = spark.createDataFrame([("r1", "USES", "a", "b", 1.0), ("r2", "OWNS", "b", "a", 3.0), ("r3", "USES", "c", "b", 1.0), ("r4", "SELF", "b", "b", 9.0)], "id string, type string, source_id string, target_id string, weight double")
    got = [tuple(r) for r in G.path_edges(rel, ["a", "b", "c", "z"]).orderBy("step").collect()]
    assert got == [(0, "a", "b", "r2", "OWNS"), (1, "b", "c", "r3", "USES"), (2, "c", "z", None, None)]
    assert G.path_edges(rel, ["a"]).count() == 0
    assert [(r.id, r.degree) for r in G.hubs(rel).orderBy("place").collect()] == [("b", 2), ("a", 1), ("c", 1)]
    assert sorted(r.id for r in A.by_ids(rel, ["r1", "r1", None, "r9", "r3"]).collect()) == ["r1", "r3"]
    assert A.by_ids(rel, []).count() == 0
    usage = spark.createDataFrame([("p", "m", 1_000_000, 0), ("p", "other", 0, 1_000_000), ("q", None, 5, 5)], "provider string, model string, input_tokens long, output_tokens long")
    rates = spark.createDataFrame([("m", 2.0, 0.0), ("p", 0.0, 7.0)], "name string, input double, output double")
    assert sorted(r.cost for r in A.actual_cost(usage, rates).collect()) == [0.0, 2.0, 7.0]


def test_components_of_a_long_chain(spark):
    n = 300
    e = spark.createDataFrame([(f"n{k:04}", f"n{k + 1:04}") for k in range(n)], "a string, b string")
    nodes = spark.createDataFrame([(f"n{k:04}",) for k in range(n + 1)] + [("alone",)], "id string")
    got = {r.id: r.component for r in G.components(nodes, e).collect()}
    assert got.pop("alone") == "alone" and set(got.values()) == {"n0000"} and len(got) == n + 1


def test_stored_postings_rank_as_a_scan(spark):
    docs = spark.createDataFrame([("d1", "red fox", "the fox runs"), ("d2", None, "a red dog"), ("d3", "", None), ("d4", "foxes", "fox")], "id string, t string, s string")
    weights = {"t": 3.0, "s": 1.0}
    p = S.postings(docs, "id", weights)
    for query in ("red fox", "fox*", "nothing here", ""):
        want = {r.id: round(r.score, 9) for r in S.bm25(docs, "id", weights, query).collect()}
        assert {r.id: round(r.score, 9) for r in S.bm25_of_postings(p, S.document_lengths(docs, "id", p), query).collect()} == want


def test_nearest_is_the_same_by_broadcast_and_by_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)], "i long, v array<float>")
    one = sorted(map(tuple, S.nearest(v, v.where("i % 20 = 0"), "i", "v", 3, 8).collect()))
    monkeypatch.setattr(S, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, S.nearest(v, v.where("i % 20 = 0"), "i", "v", 3, 8).collect())) == one


def test_a_hot_open_key_is_found_whole(spark):
    n = 40 * SALTS
    refs = spark.createDataFrame([(f"r{k}", "gone" if k % 3 == 0 else "there", None) for k in range(n)] + [(None, "gone", None)] * 2, "id string, k string, loaded_at timestamp")
    parents = spark.createDataFrame([("there", None)], "id string, loaded_at timestamp")
    got = ReferenceCheck([Referrer("t", refs, {"k": "p"})], [Parent("p", parents)]).orphans().collect()
    assert len(got) == len([k for k in range(n) if k % 3 == 0]) + 1 and {r.ref_key for r in got} == {"gone"}


@pytest.mark.parametrize("paired", [100, 5])
def test_summary_inputs_move_no_row_for_each_relation_of_each_community(spark, monkeypatch, paired):
    monkeypatch.setattr(A, "PAIRED", paired)
    # One hub with 300 relations in 400 communities; large communities with few relations; loops, parallel and foreign ones.
    rel = [(f"h{k}", "hub", f"n{k % 90}") for k in range(300)] + [("l1", "hub", "hub"), ("l2", "n1", "n1"), ("p1", "n1", "n2"), ("p2", "n2", "n1"), ("p3", "x", "y"), ("p4", "n2", "x")]
    com = [(f"c{k:03}", ["hub", f"n{k % 90}", f"n{(k + 1) % 90}", None]) for k in range(400)] + [("all", [f"n{k}" for k in range(90)] * 2), ("lone", ["z1"]), ("none", []), ("idle", [f"z{k}" for k in range(50)] + ["x", "y"])]
    r, c = spark.createDataFrame(rel, "id string, source_id string, target_id string"), spark.createDataFrame(com, "id string, entity_ids array<string>")
    df = A.summary_inputs(c, r)
    want = {(i, len(s), sum(a in s or b in s for _, a, b in rel)) for i, e in com if (s := set(e))}
    assert {tuple(x) for x in df.collect()} == want
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("inputs", "inputs")
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in before.getJobIdsForGroup("inputs") for s in before.getJobInfo(j).stageIds}
    written = [store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if before.getStageInfo(s)]
    assert max(written) < 10_000


def test_decisions_of_many_makers_meet_by_slices(spark):
    rel = [("DECIDED", f"p{k}", d) for k in range(30) for d in ("d1", "d2", "m1")] + [(t, f"p{k}", f"m{j}") for t in ("AUTHORED", "MODIFIED") for k in range(30) for j in range(200)] + [("SUPERSEDES", "d2", "d1")] * 2
    e = spark.createDataFrame([("d1", "DECISION", "2024"), ("d2", "DECISION", None), ("m1", "MODULE", "2023")], "id string, type string, first_seen string")
    df = A.decisions(e, spark.createDataFrame(rel, "type string, source_id string, target_id string"), e.select("id"))
    want = {(d, s, role, f"{k}{j}") for d, s in (("d1", "2024"), ("d2", None)) for role, k, n in (("maker", "p", 30), ("module", "m", 200)) for j in range(n)} | {("d2", None, "supersedes", "d1")}
    got = [tuple(r) for r in df.collect()]
    assert set(got) == want and len(got) == len(want)
    spark.sparkContext.setJobGroup("makers", "makers")
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    stages = {s for j in tracker.getJobIdsForGroup("makers") for s in tracker.getJobInfo(j).stageIds}
    # 24,000 pairs of a decision and a maker's module, of which none is moved alone.
    assert sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages if tracker.getStageInfo(s)) < 20_000

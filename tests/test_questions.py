import pytest
from graph_fixture import graph

from corvane.functions import query_text
from corvane.operators import analytics as A
from corvane.operators import graph_algorithms as G
from corvane.operators import search as S

NOW = "2024-06-11T00:00:00Z"


@pytest.fixture(scope="module")
def g(spark):
    return [x.cache() for x in graph(spark)]


def test_experts(g):
    got = [(r.person_id, r.score, r.weight, r.share, r.n_modules) for r in A.experts(g[0], g[1], "src/pay", NOW).collect()]
    assert got == [("p:ann", 7.79, 8.0, 0.5714, 1), ("p:bob", 4.87, 5.0, 0.3571, 2)]
    assert A.experts(g[0], g[1], "src/p", NOW).count() == 0
    bars = [(r.percent, len(r.bar)) for r in A.with_bars(A.experts(g[0], g[1], "src/pay", NOW)).orderBy("percent", ascending=False).collect()]
    assert bars == [(100, 20), (63, 13)]


def test_coupling_and_silos(g):
    got = [(r.module_id, r.weight, r.co_change_ratio, r.shared_authors) for r in A.coupling(g[0], g[1], "src/pay").collect()]
    assert got == [("m:ui", 5.0, round(5 / 14, 6), 1)]
    assert A.coupling(g[0], g[1], "src/pay", 6).count() == 0
    silos = {r.module_id: (r.active_experts, r.solo_expert) for r in A.silos(g[0], g[1], NOW).collect()}
    assert silos == {"m:pay": (1, "p:ann"), "m:pay/api": (1, "p:bob"), "m:ui": (0, None)}
    assert {r.module_id for r in A.silos(g[0], g[1], NOW, 3, 100_000).collect()} == {"m:pay/api", "m:ui"}


def test_paths(g):
    edges = g[1].selectExpr("source_id a", "target_id b")
    assert G.shortest_path(edges, "p:cy", "p:ann") is None
    assert G.shortest_path(edges, "p:ann", "p:ann") == ["p:ann"]
    assert G.shortest_path(edges, "p:ann", "t:sql") == ["p:ann", "m:pay", "t:sql"]
    assert G.shortest_path(edges, "t:sql", "d:move", 2) is None


def test_cards_export_and_lookup(g):
    cards = A.cards(g[0], g[1], g[0].where("id = 'm:pay'").select("id"), 2).orderBy("place").collect()
    assert [(r.relation_id, r.direction, r.other_name, r.hidden) for r in cards] == [("r9", "out", "src/pay/api", 3), ("r1", "in", "Ann", 3)]
    nodes = A.export_nodes(g[0], g[3], 3)
    assert {r.id for r in nodes.collect()} == {"m:pay", "m:ui", "p:ann"}
    assert {(r.relation_id, r.cross_community) for r in A.export_edges(nodes, g[1]).collect()} == {("r1", False), ("r4", True), ("r5", True)}
    want = g[0].sparkSession.createDataFrame([("p:ann",), ("SRC/UI",), ("nobody",)], "query string")
    assert {tuple(r) for r in S.lookup(g[0], want).collect()} == {("p:ann", "p:ann"), ("SRC/UI", "m:ui")}


def test_terms_and_kinds():
    assert query_text.terms("Who owns the PaymentGateway, gRPC or auth?") == [("owns", True), ("paymentgateway", False), ("payment", False), ("gateway", False), ("grpc", True), ("rpc", True), ("auth", True)]
    assert query_text.terms("the of I") == []
    assert [query_text.classify(q) for q in ("Who owns auth?", "Give an overview of it", "hello", "why did we move?")] == ["local", "global", "local", "global"]


def test_bm25_prefers_names_and_prefixes(g):
    got = {r.id: r.score for r in S.bm25(S.entity_texts(g[0]), "id", S.ENTITY_WEIGHTS, "payments postgresql").collect()}
    assert set(got) == {"p:ann", "t:sql", "d:move"} and got["t:sql"] > got["p:ann"]
    assert "m:pay" in {r.id for r in S.bm25(S.entity_texts(g[0]), "id", S.ENTITY_WEIGHTS, "pay").collect()}
    assert S.bm25(S.entity_texts(g[0]), "id", S.ENTITY_WEIGHTS, "the").count() == 0


def test_vectors(g):
    ranked = [r.id for r in S.rank_by_vector(g[0], "id", "embedding", [1.0, 0, 0, 0], 2).collect()]
    assert ranked == ["p:ann", "m:pay"]
    assert {r.similarity for r in S.rank_by_vector(g[0], "id", "embedding", [1.0]).collect()} == {0.0}
    spark = g[0].sparkSession
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0])], "id long, v array<float>")
    small = S.nearest(rows, rows.where("id % 20 = 0"), "id", "v", 3, block=7).drop("n")
    assert sorted(map(repr, small.collect())) == sorted(map(repr, S.nearest(rows, rows.where("id % 20 = 0"), "id", "v", 3).collect()))


def test_local_search(g):
    e, r, u, c = g
    found = S.local_search(e, r, u, c, "payments gateway", NOW, max_entities=10, vector=[1.0, 0.0, 0.0, 0.0])
    assert found["entities"][0]["hop"] == 0 and len(found["entities"]) <= 10
    assert found["total_relations"] >= len(found["relations"]) and found["communities"] and "u1" in found["units"]
    few = S.local_search(e, r, u, c, "payments gateway", NOW, max_relations=1)
    assert len(few["relations"]) == 1 and few["total_relations"] == S.local_search(e, r, u, c, "payments gateway", NOW)["total_relations"]
    assert S.local_search(e, r, u, c, "payments gateway", NOW, vector=[1.0])["entities"] == S.local_search(e, r, u, c, "payments gateway", NOW)["entities"]
    assert S.local_search(e, r, u, c, "zzz", NOW)["entities"] == []
    # Of the units only the short one fits two tokens.
    assert S.local_search(e, r, u, c, "payments gateway", NOW, max_tokens=2)["units"] == ["u3"]


def test_global_search(g):
    c = g[3]
    assert [r.id for r in S.global_search(c, "screens").orderBy("place").collect()][0] == "c1"
    hybrid = [r.id for r in S.global_search(c, "screens", vector=[1.0, 0.0, 0.0, 0.0]).orderBy("place").collect()]
    assert set(hybrid) == {"c0", "c1", "c2"} and hybrid[0] == "c0"
    assert [r.id for r in S.global_search(c, "screens", level=1).collect()] == ["c2"]
    assert [r.id for r in S.global_search(c, "screens", level=0, vector=[0.0, 0.0, 0.0, 1.0]).orderBy("place").collect()] == ["c1", "c0"]


def test_communities(spark):
    cliques = [(f"{k}{i}", f"{k}{j}", 10.0) for k in "ab" for i in range(5) for j in range(i)]
    edges = spark.createDataFrame(cliques + [("a0", "b0", 1.0)], "a string, b string, weight double")
    nodes = spark.createDataFrame([(f"{k}{i}",) for k in "ab" for i in range(5)] + [("alone",)], "id string")
    got = {r.id: r.community for r in G.communities(nodes, edges).collect()}
    assert got == {f"{k}{i}": f"{k}0" for k in "ab" for i in range(5)}
    assert {r.id: r.community for r in G.communities(nodes.repartition(3), edges.repartition(4)).collect()} == got


def test_the_rounds_over_joins_agree_with_one_task(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", 5.0), ("b", "c", 5.0), ("a", "c", 5.0), ("c", "d", 1.0), ("d", "e", 5.0), ("e", "f", 5.0), ("d", "f", 5.0)], "a string, b string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    one = {r.id: r.community for r in G.communities(nodes, edges, rounds=4, levels=2).collect()}
    monkeypatch.setattr(G, "SMALL_GRAPH", 0)
    assert {r.id: r.community for r in G.communities(nodes, edges, rounds=4, levels=2).collect()} == one
    assert one == {x: "a" if x in "abc" else "d" for x in "abcdef"}


def test_components_and_jaccard(spark):
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(12)], "id string")
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(8)] + [("n10", "n11")], "a string, b string")
    got = {r.id: r.component for r in G.components(nodes, edges).collect()}
    assert got == {**{f"n{i:02}": "n00" for i in range(9)}, "n09": "n09", "n10": "n10", "n11": "n10"}
    s = "id string, level int, entity_ids array<string>"
    new, old = spark.createDataFrame([("x", 0, ["a", "b", "c"]), ("y", 1, ["a"]), ("z", 0, [])], s), spark.createDataFrame([("o", 0, ["a", "b", "c", "d"]), ("p", 0, ["a"]), ("q", 0, [])], s)
    assert [tuple(r) for r in G.jaccard_matches(new, old).collect()] == [("x", "o", 0.75)]

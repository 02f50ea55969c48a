import pytest
from pyspark.sql import functions as F

from corvane.functions.paths import entity_id, is_noise, module_path, relation_id, renamed_to
from corvane.operators import graph_build as G
from corvane.sources.store import GraphStore
from corvane.streaming.ingest import ingest

FILES = "array<struct<path:string,old_path:string,status:string,additions:bigint,deletions:bigint,diff:string>>"
COMMITS = f"hash string, author_name string, author_email string, date string, message string, parent_hashes array<string>, indexed_at string, files_changed {FILES}"


def commit(h, name, mail, day, files, parents=("p",), at="2024-01-01"):
    return (h, name, mail, f"2024-01-{day:02}T00:00:00+00:00", "m", list(parents), at, [(p, None, s, a, d, None) for p, s, a, d in files])


def one(spark, expr_of, values):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(expr_of(F.col("c"))).collect()]


def test_path_expressions(spark):
    assert one(spark, module_path, ["src/auth/index.ts", "src/auth/login.ts", "src/auth.ts", "README.md", "src/auth", "a/b/c/d.py"]) == ["src/auth", "src/auth", "src/auth.ts", "README.md", "src/auth", "a/b/c"]
    assert one(spark, lambda c: module_path(c, 2), ["a/b/c/d.py"]) == ["a/b"]
    assert one(spark, is_noise, ["yarn.lock", "a/dist/x.js", "dist/x", "src/a.ts", "mydist/a.ts", "x.min.js", "Makefile"]) == [True, True, True, False, False, False, False]
    assert one(spark, renamed_to, ["src/{old => new}/f.ts", "a.ts => b.ts", "src/{ => x}/f", "src/{x => }/f", "plain"]) == ["src/new/f.ts", "b.ts", "src/x/f", "src/f", "plain"]
    assert one(spark, lambda c: entity_id(F.lit("PERSON"), c), ["Ann  Lee", "-x-", "É"]) == ["person:ann-lee", "person:x", "person:"]
    a = spark.range(1).select(relation_id(F.lit("T"), F.lit("a"), F.lit("b")).alias("x"), relation_id(F.lit("T"), F.lit("b"), F.lit("a")).alias("y")).head()
    assert a.x == a.y and a.x.startswith("rel:")


def test_co_change_and_ownership(spark):
    rows = [
        commit("h1", "Ann", "Ann@x", 1, [("src/a/1.ts", "added", 10, 5), ("src/b/1.ts", "modified", 3, 1)]),
        commit("h2", "Ann L", "ann@x", 2, [("src/a/1.ts", "modified", 1, 0)]),
        commit("h3", "Bob", "bob@x", 3, [("src/a/2.ts", "modified", 1, 0)]),
        commit("m", "Cy", "cy@x", 4, [("src/a/2.ts", "added", 1, 0), ("src/b/1.ts", "added", 9, 9)], ("p", "q")),
        commit("h3", "Bobby", "bob@x", 3, [("src/a/2.ts", "modified", 1, 0)], at="2024-02-01"),
        commit("n", "None", None, 3, [("src/c/2.ts", "added", 1, 0)]), commit(None, "N", "n@x", 3, []),
    ]
    clean = G.clean_commits(spark.createDataFrame(rows, COMMITS))
    changes = G.file_changes(clean)
    assert [tuple(r) for r in G.co_changes(changes).collect()] == [("src/a", "src/b", 4, 1)]
    own = {(r.author_email, r.module): (r.type, r.weight) for r in G.ownership(changes).collect()}
    assert own == {("ann@x", "src/a"): ("AUTHORED", 2), ("ann@x", "src/b"): ("MODIFIED", 1), ("bob@x", "src/a"): ("MODIFIED", 1)}
    assert {(r.author_email, r.name, r.frequency) for r in G.people(clean).collect()} == {("ann@x", "Ann L", 2), ("bob@x", "Bobby", 1)}


@pytest.mark.parametrize("wide", [G.WIDE, 4])
def test_co_changes_of_wide_commits_equal_brute_force(spark, monkeypatch, wide):
    import itertools
    import random
    from collections import defaultdict

    monkeypatch.setattr(G, "WIDE", wide)
    rng = random.Random(4)
    rows = [(f"h{k % 12}", f"m{rng.randrange(30)}", rng.randrange(9)) for k in range(200)]
    df = spark.createDataFrame(rows, "hash string, module string, lines long")
    lines, want = defaultdict(lambda: defaultdict(int)), defaultdict(lambda: [0, 0])
    for h, m, n in rows:
        lines[h][m] += n
    for x in lines.values():
        for a, b in itertools.combinations(sorted(x), 2):
            want[a, b][0] += min(x[a], x[b])
            want[a, b][1] += 1
    got = [tuple(r) for r in G.co_changes(df).collect()]
    assert sorted(got) == sorted((a, b, w, n) for (a, b), (w, n) in want.items())
    assert G.co_changes(df.limit(0)).count() == 0


def test_density(spark):
    e, r = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("r",)], "id string")
    assert G.edge_density(e, r).head()["density"] == 0.5
    assert G.edge_density(e.limit(0), r.limit(0)).head()["density"] == 0.0


E_COLS = "id string, type string, name string, aliases array<string>, description string, first_seen string, last_seen string, frequency long"
R_COLS = "id string, type string, source_id string, target_id string, weight double, description string, evidence array<string>, first_seen string, last_seen string"


def test_store_merges_versions_and_batches(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    ent = lambda d, first, last, n, name="A": spark.createDataFrame([("a", "PERSON", name, [], d, first, last, n)], E_COLS)
    rel = lambda w, first, last, d, s="a": spark.createDataFrame([("r", "T", s, "b", w, d, ["u"], first, last)], R_COLS)
    assert store.apply(ent("first", "2024-02-01", "2024-02-01", 5), rel(2.0, "2024-02-01", "", "x"), batch=("s", 0))
    assert store.apply(ent(" ", "2024-01-01", "2024-03-01", 3, "A2"), rel(3.0, "", "2024-05-01", "y", "z"), batch=("s", 1))
    assert not store.apply(ent("again", "2024-01-01", "2024-03-01", 3), batch=("s", 1))
    assert tuple(store.table("entities").head()) == ("a", "PERSON", "A2", [], "first", "2024-01-01", "2024-03-01", 8)
    assert tuple(store.table("relations").select("source_id", "weight", "description", "first_seen", "last_seen").head()) == ("a", 5.0, "y", "2024-02-01", "2024-05-01")
    units = spark.createDataFrame([("u", "text", ["a", "ghost"])], "id string, content string, entity_ids array<string>")
    store.apply(text_units=units)
    store.apply(text_units=units.withColumn("content", F.lit("other")))
    assert [tuple(r) for r in store.table("text_unit_entities").collect()] == [("u", "a")] and store.table("text_units").head()["content"] == "text"
    with pytest.raises(Exception):
        store.apply(ent("x", "", "", 1).withColumn("name", F.expr("raise_error('down')")))
    assert store.stats()["entities"] == 1 and store.table("entities").head()["frequency"] == 8
    store.vacuum()
    assert store.stats() == {"entities": 1, "relations": 1, "text_units": 1, "communities": 0, "commits": 0}
    store.clear()
    assert sum(store.stats().values()) == 0


def test_streaming_ingestion_is_incremental_and_idempotent(spark, tmp_path):
    src, store = str(tmp_path / "in"), GraphStore(spark, str(tmp_path / "g"))
    put = lambda rows: spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("append").parquet(src)
    run = lambda: ingest(spark, src, spark.createDataFrame([], COMMITS).schema, store, str(tmp_path / "cp"))
    put([commit("h1", "Ann", "ann@x", 1, [("src/a/1.ts", "added", 10, 5), ("src/b/1.ts", "modified", 3, 1)])])
    run()
    version = store.manifest()["version"]
    run()
    assert store.manifest()["version"] == version  # nothing new, no batch
    put([commit("h2", "Ann", "ann@x", 2, [("src/a/1.ts", "modified", 1, 1)]), commit("h1", "Ann", "ann@x", 1, [("src/a/1.ts", "added", 10, 5), ("src/b/1.ts", "modified", 3, 1)])])
    run()
    freq = {r.id: r.frequency for r in store.table("entities").collect()}
    assert freq == {"person:ann-x": 2, "module:src/a": 2, "module:src/b": 1}
    weights = {(r.type, r.target_id): r.weight for r in store.table("relations").collect()}
    # The second batch only modifies the module, which is an edge of its own type.
    assert weights == {("AUTHORED", "module:src/a"): 1.0, ("MODIFIED", "module:src/a"): 1.0, ("MODIFIED", "module:src/b"): 1.0, ("CO_CHANGED", "module:src/b"): 4.0}

import json
import subprocess

import pytest
from pyspark.sql import functions as F
from test_build_store import COMMITS, commit

import corvane
from corvane import agent, api, config, pipeline
from corvane.functions import render
from corvane.functions.clients import HashingEmbedder
from corvane.operators import extraction
from corvane.sources.store import OPTIONAL, TABLES, GraphStore


def log(spark, days):
    files = lambda k: [(f"src/a/{k}.py", "added", 5, 0), (f"src/b/{k}.py", "modified", 3, 1), ("README.md", "modified", 1, 0)]
    rows = [(*commit(f"{k:07x}" + "0" * 33, "Ann Lee" if k % 3 else "Bob Ray", "ann@x" if k % 3 else "bob@x", k, files(k % 4)),) for k in days]
    return spark.createDataFrame(rows, COMMITS).withColumn("message", F.lit("use kafka and redis"))


def test_the_index_in_one_call_and_again(spark, tmp_path):
    store, said = GraphStore(spark, str(tmp_path / "g"), buckets=4), []
    embedder = HashingEmbedder(8)
    embed = F.pandas_udf(lambda s: s.map(lambda t: embedder.embed([t])[0]), "array<float>")
    first = pipeline.build(store, log(spark, range(1, 13)), embed=embed, progress=lambda *a: said.append(a[0]))
    assert [s for s in pipeline.STAGES if s in said] == pipeline.STAGES
    assert first["commits"] == 12 and first["units"] >= 1 and first["communities"] >= 1 and first["summarized"] == first["communities"]
    e = {r.id: r for r in store.table("entities").collect()}
    assert {"person:ann-x", "module:src/a", "module:src/b", "technology:kafka", "technology:redis"} <= set(e)
    # The commits' rows and those of the texts add up.
    assert e["module:src/a"].frequency == 12 + sum("module:src/a" in r.entity_ids for r in store.table("text_units").collect())
    assert store.table("text_unit_entities").count() == store.table("text_units").selectExpr("explode(entity_ids)").count()
    assert store.table("commits").where("size(files_changed) = 3 and indexed_at is not null").count() == 12
    assert store.table("embeddings").count() == first["embedded"] == len(e) + first["communities"]
    # Nothing new: nothing changes.
    version = store.manifest()["version"]
    assert pipeline.build(store, log(spark, range(1, 13)))["commits"] == 0 and store.manifest()["version"] == version
    second = pipeline.build(store, log(spark, range(1, 15)), embed=embed)
    assert second["commits"] == 2 and store.stats()["commits"] == 14
    # Sets that didn't change keep their summary and needn't be embedded again.
    assert second["summarized"] < second["communities"] or second["communities"] != first["communities"]
    assert second["embedded"] < store.table("entities").count() + second["communities"]
    graph = corvane.Graph.of(store, "2024-02-01T00:00:00Z")
    assert [r.person_id for r in graph.experts("src").collect()][0] == "person:ann-x"
    assert graph.detail("module:src/a")["communities"] and graph.resource("stats").startswith("## Stats")
    out = graph.export(max_nodes=3)
    assert len(out["nodes"]) == 3 and out["truncated"]["total_nodes"] == store.stats()["entities"] and {"id", "title", "colour"} <= set(out["communities"][0])


def test_two_passes_merge(spark):
    x = lambda body: f"<extraction>{body}</extraction>"
    ent = lambda n, t, d="": f"<entity><name>{n}</name><type>{t}</type><description>{d}</description></entity>"
    rel = lambda a, b, t, w, d="": f"<relation><source>{a}</source><target>{b}</target><type>{t}</type><weight>{w}</weight><description>{d}</description></relation>"
    frame = lambda s: spark.createDataFrame([("u", s)], "text_unit_id string, answer string")
    one, two = frame(x(ent("Ann", "PERSON") + rel("Ann", "src", "AUTHORED", 20, "first"))), frame(x(ent("ann", "PERSON", "writes") + ent("src", "MODULE") + rel("Ann", "src", "AUTHORED", 3, "later") + rel("src", "Ann", "AUTHORED", 3)))
    entities, relations = extraction.merged_passes(one, two)
    assert {tuple(r) for r in entities.collect()} == {("u", "Ann", "PERSON", "writes"), ("u", "src", "MODULE", "")}
    # Weights are clamped to ten, the first description stays, and a relation whose ends have other types is left out.
    assert [(r.source, r.target, r.weight, r.description) for r in relations.collect()] == [("Ann", "src", 10.0, "first")]
    assert extraction.merged_passes(frame(""), frame(None))[0].count() == 0


def test_units_of_a_failing_model_are_kept(spark):
    units = spark.createDataFrame([("u1", "text", ["h"] * 9), ("u2", "down", ["h"])], "id string, content string, commit_hashes array<string>")

    def client(text):
        if text == "down":
            raise OSError("down")
        return "<extraction><entity><name>Kafka</name><type>TECHNOLOGY</type></entity></extraction>"

    entities, relations = pipeline.extract(units, client, config.Config())
    assert [(r.text_unit_id, r.name) for r in entities.collect()] == [("u1", "Kafka")] and relations.count() == 0


def test_store_keeps_whole_rows_in_buckets(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"), buckets=8)
    cols = TABLES["entities"] + ", " + OPTIONAL["entities"]
    row = lambda i, meta, vec: (i, "PERSON", i, [], "", "2024", "2024", 1, meta, vec)
    store.apply(spark.createDataFrame([row(f"e{k}", {"k": "v"}, [1.0, 2.0]) for k in range(40)], cols))
    before = store.manifest()["tables"]["entities"]
    store.apply(spark.createDataFrame([row("e7", {"k": "w"}, None)], cols))
    after = store.manifest()["tables"]["entities"]
    # Only the bucket of e7 was written anew, and a null vector doesn't replace one.
    assert sum(before[b] != after[b] for b in before) == 1
    r = store.table("entities").where("id = 'e7'").head()
    assert r.metadata == {"k": "w"} and r.embedding == [1.0, 2.0] and r.frequency == 2 and store.stats()["entities"] == 40
    store.put_embeddings(spark.createDataFrame([("e7", "h", [0.5])], TABLES["embeddings"]), "m1")
    assert store.table("embeddings").count() == 1
    store.put_embeddings(spark.createDataFrame([("e8", "h", [0.5])], TABLES["embeddings"]), "m2")
    assert [r.id for r in store.table("embeddings").collect()] == ["e8"]
    stale = store.manifest()
    store.apply(spark.createDataFrame([row("new", None, None)], cols))
    with pytest.raises(RuntimeError):  # what was made from an older version is refused
        store.publish({}, base=stale)
    assert store.stats()["entities"] == 41


def test_an_old_store_migrates(spark, tmp_path):
    folder = str(tmp_path / "old")
    units = spark.createDataFrame([("u", "t", ["h"], "", "", ["a", "ghost", None], [])], TABLES["text_units"])
    people = spark.createDataFrame([("a", "PERSON", "A", [], "", "", "", 1)], TABLES["entities"])
    paths = {}
    for name, df in (("text_units", units), ("entities", people)):
        paths[name] = f"{folder}/data/x/{name}"
        df.write.parquet(paths[name])
    store = GraphStore(spark, folder, buckets=2)
    assert store._manifests.publish(1, {"version": 1, "schema": 1, "tables": paths, "meta": {"k": "v"}, "batches": {"s": 4}})
    assert store.migrate() == 1
    m = store.manifest()
    assert m["schema"] == 6 and m["meta"] == {"k": "v"} and all(isinstance(t, dict) for t in m["tables"].values())
    assert [tuple(r) for r in store.table("text_unit_entities").collect()] == [("u", "a")] and store.table("entities").head()["name"] == "A"
    assert store.migrate() == 6 and not store.apply(people, batch=("s", 4))
    store._manifests.publish(99, m | {"version": 99, "schema": 7})
    with pytest.raises(ValueError):
        store.manifest()


def test_settings(tmp_path):
    (tmp_path / ".corvane").mkdir()
    file = tmp_path / ".corvane" / "config.json"
    file.write_text(json.dumps({"commits_per_unit": 9, "branch": "file", "unknown": 1, "resolutions": [1, 3]}))
    c = config.load({"CORVANE_BRANCH": "env", "CORVANE_MAX_COMMITS": "5", "CORVANE_PARENT_LINK": "0.4"}, repo=str(tmp_path), min_community=2, max_files=None)
    assert (c.branch, c.max_commits, c.commits_per_unit, c.min_community, c.parent_link, c.resolutions, c.max_files) == ("file", 5, 9, 2, 0.4, (1, 3), 50)
    assert c.storage == str((tmp_path / ".corvane").resolve())
    file.write_text("{broken")
    assert config.load({}, repo=str(tmp_path)).commits_per_unit == 7
    for bad in ({"max_unit_tokens": 99}, {"concurrency": 0}, {"parent_link": 1.1}, {"resolutions": ()}, {"retries": -1}, {"summary_reuse": -0.1}):
        with pytest.raises(ValueError, match=next(iter(bad)) if bad != {"resolutions": ()} else "resolution"):
            config.load({}, repo=str(tmp_path), **bad)
    with pytest.raises(ValueError, match="max_files.*parent_link"):
        config.Config(max_files=0, parent_link=2).checked()
    assert config.parsed_json("{x", [1]) == [1] and config.parsed_json(None, 0) == 0 and config.parsed_json("[2]", 0) == [2]


def test_rendering():
    assert render.thousands(1234567) == "1,234,567" and render.thousands(0.5) == "0.50"
    assert [render.ago(d) for d in (None, -3, 0.5, 1, 45, 800)] == ["unknown", "today", "today", "1 day ago", "1 month ago", "2 years ago"]
    assert render.elapsed(3.21) == "3.2s" and render.elapsed(125) == "2m 05s"
    assert render.with_alpha("#ff8000", 0.5) == "rgba(255, 128, 0, 0.5)" and render.with_alpha("#000000", 7) == "rgba(0, 0, 0, 1)"
    state = {"entity": "module:src/a b", "path": None, "type": "PERSON"}
    assert render.from_fragment(render.to_fragment(state)) == {"entity": "module:src/a b", "type": "PERSON"}
    assert render.markdown([{"a": "x|y", "n": 1200, "l": ["p", None], "b": True}], "T").splitlines() == ["## T", "", "| a | n | l | b |", "|---|---|---|---|", "| x\\|y | 1,200 | p,  | yes |"]
    assert render.markdown([]) == "Nothing found."


def test_agent_session(spark, monkeypatch):
    units = spark.createDataFrame([("u2", "two"), ("u1", "one")], "id string, content string")
    now = [0.0]
    s = agent.AgentSession(units, lambda answers: {"answers": answers.count()}, clock=lambda: now[0])
    assert (s.next()["text_unit_id"], s.next()["content"]) == ("u1", "one")
    with pytest.raises(agent.SessionError):
        s.finalize()
    assert not s.submit("nothing")["accepted"] and s.next()["index"] == 0
    assert s.submit("nothing")["accepted"]  # the second time it is taken as empty
    found = s.submit("<extraction><entity><name>Ann</name><type>PERSON</type></entity></extraction>")
    assert found == {"accepted": True, "entities": 1, "relations": 0, "progress": "2/2"}
    assert s.next() == {"done": True, "extracted": 2, "total": 2} and not s.submit("x")["accepted"]
    assert s.finalize() == {"answers": 2}
    now[0] = agent.TIMEOUT + 1
    with pytest.raises(agent.SessionError):
        s.next()
    monkeypatch.setattr(agent, "MAX_UNITS", 1)
    with pytest.raises(agent.SessionError):
        agent.AgentSession(units, dict)


def test_scan_of_a_repository_by_command_line(spark, tmp_path, capsys):
    repo, folder = str(tmp_path / "r"), str(tmp_path / "g")
    env = {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "ann@x", "GIT_COMMITTER_NAME": "Ann", "GIT_COMMITTER_EMAIL": "ann@x", "PATH": "/usr/bin:/bin"}
    run = lambda *a: subprocess.run(["git", "-C", repo, *a], check=True, capture_output=True, env=env)
    subprocess.run(["git", "init", "-q", repo], check=True, capture_output=True)
    for k in range(3):
        (tmp_path / "r" / f"f{k}.py").write_text("x\n")
        run("add", ".")
        run("commit", "-q", "-m", f"add {k}")
    for want in (3, 0):
        api.main(["scan", folder, repo])
        assert json.loads(capsys.readouterr().out)["commits"] == want
    api.main(["stats", folder])
    assert json.loads(capsys.readouterr().out)["entities"] == 5  # three modules, a person by address and one by name
    api.main(["--format", "markdown", "resource", folder, "types"])
    assert capsys.readouterr().out.startswith("## Types")
    api.main(["reset", folder])
    assert GraphStore(spark, folder).stats()["commits"] == 0

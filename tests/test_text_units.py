import os
import subprocess

import pytest
from pyspark.sql import functions as F

from corvane.functions.clients import HashingEmbedder, TokenBucket, embed_column, with_retries
from corvane.functions.similarity import jaro_winkler
from corvane.operators import chunking as C
from corvane.operators import extraction as X
from corvane.operators import resolution as R
from corvane.sources import git

FILES = "array<struct<path:string,old_path:string,status:string,additions:bigint,deletions:bigint,diff:string>>"
LOG = f"hash string, author_name string, date string, message string, parent_hashes array<string>, files_changed {FILES}"


def walk(rows, target):
    """Starts of units, by the rule as it is stated."""
    starts, pos = [0] if rows else [], 0
    while pos + target < len(rows):
        best = (0, 0, 0, pos + target)
        for i in range(max(pos + 1, pos + target - 2), min(len(rows), pos + target + 3)):
            score = (rows[i][0] != rows[i - 1][0]) + (rows[i][1] != rows[i - 1][1])
            if score:
                best = max(best, (score, -abs(i - pos - target), -i, i))
        pos = best[3]
        starts.append(pos)
    return starts


@pytest.mark.parametrize("block", [C.BLOCK, 16])
@pytest.mark.parametrize("target", [4, 7])
def test_unit_starts_equal_the_walk(spark, monkeypatch, block, target):
    import random

    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(target)
    rows = [(f"a{rng.random() < 0.3}", f"2024-01-{1 + i // 9:02}") for i in range(150)]
    df = spark.createDataFrame([(i, a, d + "T00:00") for i, (a, d) in enumerate(rows)], "pos long, author_name string, date string")
    assert sorted(r.pos for r in C.unit_starts(df, target).collect()) == walk(rows, target)
    assert C.unit_starts(df.limit(0), target).count() == 0


def test_chunk_renders_and_halves(spark):
    f = lambda p, d=None: (p, None, "m", 1, 2, d)
    rows = [
        ("a" * 40, "Ann", "2024-01-01T10:00:00+02:00", "first", ["p"], [f("x.ts"), f("y.ts", "@@\n+1\n+2\n+3"), f("z.bin", "Binary files differ")]),
        ("b" * 40, "Ann", "2024-01-02T10:00:00+02:00", "merge", ["p", "q"], [f("x.ts")]), ("c" * 40, "Ann", "2024-01-03", "m" * 50, [], []), ("d" * 40, "Bob", "2024-01-04", "last", ["p"], [f(f"{k}.ts") for k in range(4)]),
    ]
    df = spark.createDataFrame(rows, LOG)
    (u,) = C.chunk(df, max_files=3, max_diff_lines=2, max_message=40).collect()
    assert u.content.split("\n") == [
        "[aaaaaaa] 2024-01-01 Ann", "first", "  x.ts +1-2", "  z.bin +1-2", "--- y.ts +1-2", "@@", "+1", "... 2 more lines", "", "[bbbbbbb] 2024-01-02 Ann", "merge", "",
        "[ccccccc] 2024-01-03 Ann", "m" * 40 + "...", "", "[ddddddd] 2024-01-04 Bob", "last", "  0.ts +1-2", "  1.ts +1-2", "  2.ts +1-2", "  ... and 1 more files",
    ]
    assert u.commit_hashes == [r[0] for r in rows] and u.id.startswith("tu:") and len(u.id) == 15
    halves = C.chunk(df, max_tokens=20).collect()
    assert sorted(len(r.commit_hashes) for r in halves) == [1, 1, 1, 1]
    assert C.chunk(df.limit(0)).count() == 0


def test_answers(spark):
    text = """Sure:
```xml
<extraction><entities>
<entity><name>Ann &amp; Co</name><type>PERSON</type><description>a < b</description></entity>
<entity><name> </name><type>PERSON</type></entity><entity><name>x</name><type>ALIEN</type></entity>
<entity><name>src/a</name><type>MODULE</type></entity></entities>
<relations><relation><source>Ann & Co</source><target>src/a</target><type>AUTHORED</type><description>d1</description><weight>15</weight></relation>
<relation><source>Ann & Co</source><target>src/a</target><type>AUTHORED</type><description>d2</description><weight>-3</weight></relation>
<relation><source>src/a</source><target>Ann & Co</target><type>AUTHORED</type></relation>
<relation><source>elsewhere</source><target>src/a</target><type>MODIFIED</type><weight>x</weight></relation>
<relation><source>a</source><type>USES</type></relation></relations></extraction>
```"""
    df = spark.createDataFrame([("u", text), ("v", "garbage"), ("w", None)], "text_unit_id string, answer string")
    ents, rels = X.extracted_entities(df), X.extracted_relations(df)
    assert {(r.name, r.type, r.description) for r in ents.collect()} == {("Ann & Co", "PERSON", "a < b"), ("src/a", "MODULE", "")}
    assert sorted((r.seq, r.weight) for r in rels.collect()) == [(0, 10.0), (1, 1.0), (2, 5.0), (3, 5.0)]
    typed = X.typed_relations(rels, ents)
    assert sorted(r.seq for r in typed.collect()) == [0, 1, 3]
    assert {(r.source, r.weight, r.description) for r in X.deduped_relations(typed).collect()} == {("Ann & Co", 10.0, "d1"), ("elsewhere", 5.0, "")}
    s = spark.createDataFrame([("<community_summary><title>T & U</title><summary> s </summary></community_summary>",), (" plain ",)], "a string")
    assert [tuple(r[0]) for r in s.select(X.parsed_summary(F.col("a"))).collect()] == [("T & U", "s"), ("", "plain")]
    asked = {r.text_unit_id: (r.answer, r.failed) for r in X.ask(spark.createDataFrame([("a", "1"), ("b", "x")], "id string, content string"), lambda t: str(int(t) + 1)).collect()}
    assert asked == {"a": ("2", False), "b": ("", True)}


def test_resolution(spark):
    rows = [("React", "TECHNOLOGY", "ui"), ("react.js", "TECHNOLOGY", "a longer text"), ("React", "TECHNOLOGY", ""), ("k8s", "TECHNOLOGY", ""), ("Kubernetes", "TECHNOLOGY", "x"), ("src/auth/a.ts", "MODULE", ""), ("src/auth", "MODULE", "m"), ("src/auths", "MODULE", ""), (None, "PERSON", "")]
    got = {r.name: (r.id, r.aliases, r.description) for r in R.resolve(spark.createDataFrame(rows, "name string, type string, description string")).collect()}
    assert got == {
        "React": ("technology:react", ["react.js"], "a longer text"), "Kubernetes": ("technology:kubernetes", ["k8s"], "x"), "src/auth": ("module:src/auth", [], "m"), "src/auths": ("module:src/auths", [], ""),
    }
    ents = spark.createDataFrame([("p:a", "PERSON", "Ann", ["annie"]), ("m:x", "MODULE", "src/x", None)], "id string, type string, name string, aliases array<string>")
    rel = spark.createDataFrame([("ANNIE", "src/x/y.ts", "AUTHORED", "", 1.0, "u"), ("Ann", "annie", "AUTHORED", "", 1.0, "u"), ("src/x", "Ann", "AUTHORED", "", 1.0, "u"), ("Ann", "who", "AUTHORED", "", 1.0, "u")], "source string, target string, type string, description string, weight double, text_unit_id string")
    units = spark.createDataFrame([("u", "2024-01-01", "2024-02-01")], "id string, date_start string, date_end string")
    assert [(r.source_id, r.target_id, r.first_seen, r.last_seen) for r in R.resolve_relations(rel, ents, units).collect()] == [("p:a", "m:x", "2024-01-01", "2024-02-01")]


def test_jaro_winkler():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert jaro_winkler("a", "") == 0 and jaro_winkler("", "") == 1 and jaro_winkler("abc", "xyz") == 0


def test_clients(spark):
    e = HashingEmbedder(16)
    assert e.embed(["a b", ""])[0] == e.embed(["b a"])[0] and e.embed([""]) == [[0.0] * 16]
    df = spark.createDataFrame([("x y",), (None,)], "t string").select(embed_column(F.col("t"), e).alias("v"))
    assert [len(r.v) for r in df.collect()] == [16, 16]
    now, slept = [0.0], []
    b = TokenBucket(2, 2, lambda: now[0], slept.append)
    for _ in range(4):
        b.take()
    assert slept == [0.5, 1.0]
    tries = []
    with pytest.raises(ZeroDivisionError):
        with_retries(lambda: 1 / 0, 3, sleep=tries.append, retry_after=lambda e: 2.0)
    assert tries == [2.0, 2.0]


def test_git_log(spark, tmp_path):
    repo = str(tmp_path / "r")
    os.makedirs(repo)
    env = os.environ | {"GIT_AUTHOR_NAME": "Ann", "GIT_AUTHOR_EMAIL": "Ann@X", "GIT_COMMITTER_NAME": "c", "GIT_COMMITTER_EMAIL": "c@x"}
    run = lambda *a: subprocess.run(["git", "-C", repo, *a], check=True, capture_output=True, env=env)
    run("init", "-q")
    spark.dataSource.register(git.GitLog)
    read = lambda **o: spark.read.format("gitlog").options(path=repo, **o).load()
    assert read().count() == 0 and git.head(repo) is None

    def put(path, text):
        full = os.path.join(repo, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        open(full, "w").write(text)

    put("src/a.ts", "1\n2\n3\n" * 20)
    put("yarn.lock", "x\n")
    run("add", "-A")
    run("commit", "-qm", "first\n\nbody")
    os.makedirs(os.path.join(repo, "lib"))
    run("mv", "src/a.ts", "lib/a.ts")
    put("lib/a.ts", "1\n2\n3\n" * 20 + "4\n")
    run("add", "-A")
    run("commit", "-qm", "second")
    rows = git.commits(read()).orderBy("seq").collect()
    assert [(r.message, r.author_name, r.author_email, len(r.parent_hashes)) for r in rows] == [("first", "Ann", "ann@x", 0), ("second", "Ann", "ann@x", 1)]
    first = {f.path: (f.status, f.additions, f.diff is None) for f in rows[0].files_changed}
    assert first == {"src/a.ts": ("added", 60, False), "yarn.lock": ("added", 1, True)}
    (moved,) = rows[1].files_changed
    assert (moved.path, moved.old_path, moved.status, moved.additions, moved.deletions) == ("lib/a.ts", "src/a.ts", "renamed", 1, 0) and "+4" in moved.diff
    assert [r.message for r in git.commits(read(), 1).collect()] == ["first"]
    assert [r.message for r in git.commits(read(since_commit=rows[0].hash)).collect()] == ["second"]
    assert git.file_tree(repo) == ["lib/a.ts", "yarn.lock"] and git.head(repo) == rows[1].hash


def test_leaders_compare_few_pairs_and_are_those_of_all_pairs(monkeypatch):
    import random

    r, calls, true = random.Random(7), [0], R.jaro_winkler

    def counted(a, b):
        calls[0] += 1
        return true(a, b)

    def brute(names, threshold):
        heads, out = [], []
        for n in names:
            form = R.ABBREVIATIONS.get(n, n)
            fits = (h for h in heads if R.ABBREVIATIONS.get(h, h) == form or n and h and 2 * min(len(n), len(h)) >= max(len(n), len(h)) and true(n, h) >= threshold)
            out.append(next(fits, n))
            if out[-1] == n:
                heads.append(n)
        return out

    monkeypatch.setattr(R, "jaro_winkler", counted)
    people = sorted({" ".join("".join(r.choice(a) for a in ("bdfgklmnprstvz", "aeiou") * r.randint(2, 4)) for _ in range(2)) for _ in range(700)})
    got = [people[k] for k in R.leaders(people, True, 0.85)]
    assert got == brute(people, 0.85) and 1 < len(people) - len(set(got)) and calls[0] < len(people) ** 2 / 20
    for threshold in (0.0, 0.6, 0.85):
        odd = sorted({"".join(r.choice("aab é7ß") for _ in range(r.randint(0, 13))) for _ in range(150)} | {"ts", "typescript", "js", "k8s", "a" * 40, "a" * 25})
        assert [odd[k] for k in R.leaders(odd, True, threshold)] == brute(odd, threshold)

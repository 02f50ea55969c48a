import random

import pytest

from corvane.llm import names as N

PERSON = "id string, name string, aliases array<string>, metadata map<string,string>, frequency long, tokens string, kind string"
AUTHOR = "author_name string, author_email string, id string"


def clusters(spark, people, authors=()):
    df = spark.createDataFrame([(i, n, a, m, f, "t", "k") for i, n, a, m, f in people], PERSON)
    who = spark.createDataFrame([(*a, "x") for a in authors], AUTHOR)
    return {(r.id_a, r.id_b) for r in N.variant_pairs(N.variants(df, who)).collect()}


def simple(*names):
    return [(f"p{k:02}", n, None, None, 1) for k, n in enumerate(names)]


def groups(pairs, people):
    name = {p[0]: p[1] for p in people}
    out = {}
    for a, b in pairs:
        out.setdefault(a, {a}).add(b)
    best = {}
    for g in sorted(out.values(), key=len, reverse=True):
        for x in g:
            best.setdefault(x, frozenset(name[y] for y in g))
    return set(best.values())


def test_spellings_of_one_person(spark):
    one = ["Elizabeth Amigitukith", "Elizaneth Amigitukith", "Beth Amigitukih", "AMIGITUKITH Elizabeth B", "Amigitukith, Elizabeth", "E. Amigitukith", "EB Amigitukith", "amigitukith.elizabeth", "eamigitukith", "amigitukithe", "Elizabeth Amigitukith-Quill", "Elizabeth Amigitukith (Harrow)", "Élizabeth Amigitükith [contractor]"]
    two = ["Robert Amigitukith", "Bob Amigitukith", "ramigitukith"]
    team = ["Abasakat Security Team", "Security Team, Abasakat", "abasakat-security", "The Abasakat Security Group"]
    other = ["Abasakat Release Team", "Maria Ordonelle", "Foundry Autobot"]
    people = simple(*one, *two, *team, *other)
    assert groups(clusters(spark, people), people) == {frozenset(one), frozenset(two), frozenset(team)}


def test_addresses_and_aliases_decide_what_names_leave_open(spark):
    people = [
        ("a", "Jonathan Cruhadukas", None, None, 9), ("b", "Joshua Cruhadukas", None, None, 50), ("c", "JL Cruhadukas", None, {"email": "jonathan.cruhadukas@x.example"}, 1),
        ("d", "J. Cruhadukas", ["Joshua Cruhadukas"], None, 1), ("e", "jcruhadukas", None, None, 1), ("f", "Ann Other", None, {"email": "jonathan.cruhadukas@x.example"}, 1),
    ]
    pairs = clusters(spark, people, [("jcruhadukas ", "Jonathan.Cruhadukas@X.example"), ("Ann Other", "dev@shared.example"), (None, None), ("jcruhadukas", "")])
    assert pairs == {("a", "c"), ("a", "e"), ("c", "e"), ("b", "d")}


def test_nulls_repeats_empty_and_long(spark):
    people = [(None, "Ann Telforia", None, None, 1), ("x", None, None, None, None), ("y", " ", [None], {}, 1), ("z", "Ann Telforia", None, None, 1), ("z", "Ann Telforia", None, None, 2), ("w", "Telforia " + "Anna" * 20_000, None, None, 1)]
    assert clusters(spark, people) == set()
    assert clusters(spark, []) == set()


def test_names_of_common_tokens_only(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 5)
    people = simple(*[f"{g} Smithson" for g in ("Alexander", "Benjamin", "Christopher", "Dorothea", "Emmanuel", "Ferdinand", "Gabriel")], "Smithson, Alexander", "Smithson Alexnader")
    people += [(f"q{k}", f"{g} {s}", None, None, 1) for k, (g, s) in enumerate((g, s) for g in ("Alexander", "Benjamin") for s in ("Quorfeldt", "Brantwick", "Czernoval"))]
    assert clusters(spark, people) == {("p00", "p07"), ("p00", "p08"), ("p07", "p08")}


def test_a_name_that_many_share_keeps_its_typos(spark, monkeypatch):
    monkeypatch.setattr(N, "HOT", 3)
    people = [(f"a{k:02}", "Alexander Smithson" if k % 2 else "Smithson, Alexander", None, None, 1) for k in range(30)]
    people += [("b0", "Alexnader Smithson", None, None, 1), ("b1", "Alexander Smihtson", None, None, 1)]
    people += [(f"c{k}", f"{g} Smithson", None, None, 1) for k, g in enumerate(("Benjamin", "Benjamin", "Benjamin", "Benjamin"))]
    got = groups(clusters(spark, people), [(p[0], p[0]) for p in people])
    assert got == {frozenset([p[0] for p in people if p[0][0] in "ab"]), frozenset(f"c{k}" for k in range(4))}


def test_big_buckets_are_compared_whole(spark, monkeypatch):
    words = [f"commonprefixword{a}{b}" for a in "abcdefgh" for b in "abcd"]
    df = spark.createDataFrame([(w,) for w in words], "token string")
    want = {(r.a, r.b) for r in N.similar_tokens(df).collect()}
    monkeypatch.setattr(N, "BUCKET", 5)
    assert {(r.a, r.b) for r in N.similar_tokens(df).collect()} == want
    brute = {(a, b) for a in words for b in words if a < b and N.one_edit(a, b)}
    assert len(want & brute) / len(brute) > 0.99 and want <= brute


@pytest.mark.parametrize("length", [8, 11])
def test_recall_follows_the_collision_curve(spark, length):
    rng = random.Random(length)
    letters = "abcdefghijklmnoprstuvwy"
    pairs = []
    for _ in range(400):
        w = "".join(rng.choice(letters) for _ in range(length))
        k = rng.randrange(length - 1)
        v = rng.choice([w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :]])
        if v != w:
            pairs.append(tuple(sorted((w, v))))
    df = spark.createDataFrame([(x,) for x in {x for p in pairs for x in p}], "token string")
    got = {(r.a, r.b) for r in N.similar_tokens(df).collect()}
    assert sum(p in got for p in pairs) / len(pairs) >= 0.97
    r, b = N.tune(0.43, 0.99, 160)
    assert 1 - (1 - 0.43**r) ** b >= 0.99 and b <= 160


def test_one_edit():
    assert all(N.one_edit(*p) for p in (("abc", "abc"), ("abc", "abd"), ("abc", "acb"), ("abc", "ab"), ("abc", "abbc"), ("", "a")))
    assert not any(N.one_edit(*p) for p in (("abc", "cba"), ("abcd", "badc"), ("ab", "abcd"), ("abc", "xyc")))


def test_star_centres_outrank_their_neighbours(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.9), ("c", "d", 1.0)], "x string, y string, score double")
    rank = spark.createDataFrame([("a", 1, 5), ("b", 0, 9), ("c", 0, 1), ("d", 1, 2)], "id string, full int, weight long")
    assert {(r.id, r.centre) for r in N.stars(edges, rank).collect()} == {("a", "a"), ("b", "a"), ("d", "d"), ("c", "d")}


def test_match_keys_leave_out_no_match():
    rng = random.Random(5)
    words = [*N._ROOTS, *"abcdefghjkr", *("al", "jo", "ro", "li"), *("lexander", "jamin", "smithson", "smith", "benj", "eliza")]
    typo = lambda w, k: rng.choice([w[:k] + rng.choice("abcxyz") + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k] + w[k + 2 :]])
    words += [x for w in list(words) for k in range(len(w)) if (x := typo(w, k))]
    keys = {w: dict(N.match_keys(w)) for w in set(words)}
    for a in keys:
        for b in keys:
            if N.token_similarity(a, b) > 0:
                assert any(k in keys[b] and (k[0] not in "12" or keys[a][k] or keys[b][k]) for k in keys[a]), (a, b)


@pytest.mark.parametrize("bucket", [400, 3])
def test_views_of_common_tokens_stay_candidates(spark, monkeypatch, bucket):
    people = [
        *simple("Robert Smithson", "Bob Smithson", "R. Smithson", "Smithson-Quill Robert", "rsmithson", "Benjamin Smithson", "Ben Smithson", "Robert Smihtson"),
        ("m0", "Dorothea Smithson", None, None, 5), ("m1", "D Smithson-Vale", None, {"email": "dorothea.smithson@x.example"}, 1),
        *((f"x{k}", f"{g} Smithson", None, None, 1) for k, g in enumerate(("Yvonne", "Ursula", "Xaver"))),
    ]
    want = clusters(spark, people)
    monkeypatch.setattr(N, "HOT", 3)
    monkeypatch.setattr(N, "BUCKET", bucket)
    got = clusters(spark, people)
    assert groups(got, people) == groups(want, people)
    assert {("p00", "p01"), ("p00", "p02"), ("p00", "p03"), ("p00", "p04"), ("p00", "p07"), ("p05", "p06"), ("m0", "m1")} <= got


def test_short_tokens_meet_whatever_the_edit(spark):
    rng = random.Random(11)
    letters = "abcdefghijklmnoprstuvwy"
    pairs = {("smith", "smtih")}
    for length in (5, 6, 7, 8) * 100:
        w = "".join(rng.choice(letters) for _ in range(length))
        k = rng.randrange(length - 1)
        v = rng.choice([w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :]])
        if v != w:
            pairs.add(tuple(sorted((w, v))))
    df = spark.createDataFrame([(x,) for x in {x for p in pairs for x in p}], "token string")
    assert pairs <= {(r.a, r.b) for r in N.similar_tokens(df).collect()}


def test_names_of_short_tokens_only(spark):
    one, two, three, four = ["Wei Chen", "W. Chen", "Chen, Wei"], ["Jon Khan", "J. Khan"], ["Robert Hunt", "Bob Hunt"], ["Li Xu", "L. Xu"]
    people = simple(*one, *two, *three, *four, "Mei Chen", "Dan Chen", "Jon Park", "Ann Hunt")
    assert groups(clusters(spark, people), people) == {frozenset(one), frozenset(two), frozenset(three), frozenset(four)}


def test_stars_of_a_long_chain_keep_every_id(spark):
    n = 40
    edges = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}", 1.0) for k in range(n - 1)], "x string, y string, score double")
    rank = spark.createDataFrame([(f"n{k:03}", 0, k) for k in range(n)], "id string, full int, weight long")
    got = {r.id: r.centre for r in N.stars(edges, rank).collect()}
    assert set(got) == {f"n{k:03}" for k in range(n)}
    assert all(abs(int(a[1:]) - int(b[1:])) <= 1 for a, b in got.items())


def test_a_surname_of_many_times_hot(spark):
    """Recall where one surname has more than ten times ``HOT`` rows."""
    rng = random.Random(17)
    letters = "abcdefghijklmnoprstuvwy"
    people, true = [], set()
    for k in range(10 * N.HOT // 4 + 1):
        given = "".join(rng.choice(letters) for _ in range(9))
        at = rng.randrange(1, 7)
        spelled = [f"{given} Smithson", f"SMITHSON, {given.upper()}", f"{given[:at]}{given[at + 1]}{given[at]}{given[at + 2 :]} Smithson", f"{given[:4]} Smithson"]
        ids = [f"p{k:04}{j}" for j in range(len(spelled))]
        people += [(i, n, None, None, 1) for i, n in zip(ids, spelled)]
        true |= {(a, b) for a in ids for b in ids if a < b}
    got = clusters(spark, people)
    assert len(got & true) / len(true) >= 0.9 and len(got & true) / len(got) >= 0.9


def test_tokens_are_sketched_by_many_tasks(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(N, "cut", lambda df, f=N.cut: kept.append(df) or f(df))
    words = spark.range(4000).selectExpr("concat('token', cast(xxhash64(id) as string)) token").distinct().repartition(spark.sparkContext.defaultParallelism * 2, "token")
    N.similar_tokens(words.groupBy("token").count().select("token")).count()
    assert "xxhash64(token" in kept[0]._jdf.queryExecution().executedPlan().toString()


def test_rules_of_short_forms():
    assert all(N.token_similarity(*p) > 0.9 for p in (("danny", "daniel"), ("debbie", "deborah"), ("jenni", "jennifer"), ("jim", "james"), ("bill", "william")))
    assert not any(N.token_similarity(*p) for p in (("mary", "martin"), ("lucy", "lucas"), ("jimmy", "jason")))

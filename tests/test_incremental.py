import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corvane.operators import incremental, intervals

ROW = "hash string, indexed_at string, message string, tags array<string>, lane int, key string, done boolean"


def rows(spark, data):
    return spark.createDataFrame([(*d, ["t"], 1, "k", True) for d in data], ROW)


def handled(spark, data):
    return spark.createDataFrame(data, "hash string, indexed_at string")


def pending(spark, data, done):
    return sorted({r.key for r in incremental.pending(rows(spark, data), handled(spark, done), lanes=3).collect()})


def test_new_changed_late_and_handled(spark):
    data = [
        ("new", "2024-01-02T00:00:00Z", "a"),
        ("done", "2024-01-01 00:00:00", "a"),
        ("changed", "2024-01-01T00:00:00Z", "a"),
        ("changed", "2024-03-01T00:00:00Z", "b"),
        ("again", "2024-01-01T00:00:00Z", "a"),
        ("again", "2024-03-01T02:00:00+02:00", "a"),
        ("late", "2020-01-01T00:00:00Z", "a"),
        ("nulls", None, "a"),
        ("blank", "  ", "a"),
        ("null and newer", None, "a"),
        ("null and newer", "2024-01-01T00:00:00Z", "b"),
        (None, "2024-01-01T00:00:00Z", "a"),
    ]
    done = [
        ("done", "2024-01-01T01:00:00+01:00"), ("changed", "2024-01-01T00:00:00Z"), ("again", "2024-01-01T00:00:00.000Z"), ("nulls", ""), ("blank", None),
        ("null and newer", None), ("unknown", "2024-01-01T00:00:00Z"), (None, None), ("new", "2024-01-03T00:00:00Z"),
    ]
    assert pending(spark, data, done) == ["changed", "late", "new", "null and newer"]


def test_going_back_to_handled_content_needs_no_run(spark):
    data = [("h", "2024-01-01", "a"), ("h", "2024-01-02", "b"), ("h", "2024-01-03", "a")]
    assert pending(spark, data, [("h", "2024-01-01")]) == []
    assert pending(spark, data, [("h", "2024-01-02")]) == ["h"]


def test_ties_repeats_nulls_and_empty(spark):
    tie = [("h", "2024-01-01", "a"), ("h", "2024-01-01T00:00:00Z", "b"), ("h", "2024-01-01", "a")]
    assert pending(spark, tie, []) == ["h"]
    assert pending(spark, tie, [("h", "2024-01-01")]) == []
    assert pending(spark, [("h", None, None), ("h", "nonsense", None)], []) == ["h"]
    assert pending(spark, [], [("h", None)]) == []


def test_null_and_empty_content_differ(spark):
    data = [("h", "2024-01-01", None), ("h", "2024-01-02", "")]
    assert pending(spark, data, [("h", "2024-01-01")]) == ["h"]


def test_hot_hash_and_long_content(spark):
    data = [("hot", f"2024-01-01T00:{i // 60:02}:{i % 60:02}Z", str(i)) for i in range(500)] + [("long", "2024-01-01", "x" * 300_000)]
    assert pending(spark, data, [("hot", "2024-01-01T00:08:19Z")]) == ["long"]
    assert pending(spark, data, [("hot", "2024-01-01T00:08:18Z"), ("long", "2024-01-01")]) == ["hot"]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12), st.integers(-1, 4)), max_size=8), st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12), st.integers(-1, 4)), max_size=8))
def test_interval_algebra_equals_sets(spark, a, b):
    frame = lambda x: spark.createDataFrame([(lane, lo, lo + n) for lane, lo, n in x], "lane int, lo long, hi long")
    points = lambda x: {(lane, p) for lane, lo, n in x for p in range(lo, lo + n + 1)}
    spread = lambda df: [(r.lane, p) for r in df.collect() for p in range(r.lo, r.hi + 1)]
    merged, rest = intervals.merge(frame(a)), intervals.subtract(frame(a), frame(b))
    for df, want in ((merged, points(a)), (rest, points(a) - points(b))):
        got = spread(df)
        assert len(got) == len(set(got)) and set(got) == want
        ends = {(r.lane, r.hi + 1) for r in df.collect()}
        assert not ends & {(r.lane, r.lo) for r in df.collect()}  # neighbours are merged
    items = spark.createDataFrame([(lane, s, "x") for lane in (0, 1) for s in range(20)], "lane int, seq long, other string")
    assert {(r.lane, r.seq) for r in intervals.inside(items, rest).collect()} == {p for p in points(a) - points(b) if p[1] < 20}


def test_ledger_survives_failures_without_skipping_or_repeating(spark, tmp_path):
    ledger = incremental.Ledger(spark, str(tmp_path / "ledger"))
    available = spark.createDataFrame([(0, 1, 10)], "lane int, lo long, hi long")
    assert [(r.lo, r.hi) for r in ledger.gaps(available).collect()] == [(1, 10)]
    first = spark.createDataFrame([(0, 1, 4), (0, 7, 8)], "lane int, lo long, hi long")
    out = lambda xs: spark.createDataFrame([(x,) for x in xs], "seq long")

    class Boom(Exception):
        pass

    with pytest.raises(Exception):  # a run that dies while writing leaves nothing
        ledger.commit(out([1]).selectExpr("raise_error('down') seq"), first)
    assert ledger.state() is None and ledger.output() is None
    assert ledger.commit(out([1, 2, 3, 4, 7, 8]), first)
    late = spark.createDataFrame([(0, 1, 12)], "lane int, lo long, hi long")
    gaps = ledger.gaps(late)
    assert sorted((r.lo, r.hi) for r in gaps.collect()) == [(5, 6), (9, 12)]
    assert ledger.commit(out([5, 6, 9, 10, 11, 12]), gaps)
    assert ledger.gaps(late).count() == 0
    assert sorted(r.seq for r in ledger.output().collect()) == list(range(1, 13))
    assert [(r.lo, r.hi) for r in ledger.processed().collect()] == [(1, 12)]


RECORD = "hash string, indexed_at string, message string"


def records(spark, data):
    return spark.createDataFrame(data, RECORD)


def test_the_intervals_decide_what_is_pending(spark, monkeypatch):
    data, done = [("a", "2024-01-01", "x"), ("b", "2024-01-02", "y"), ("b", "2024-01-03", "z")], [("a", "2024-01-01")]
    assert pending(spark, data, done) == ["b"]
    monkeypatch.setattr(intervals, "inside", lambda items, gaps: items)
    assert pending(spark, data, done) == ["a", "b"]


def test_late_versions_keep_the_numbers_of_those_that_runs_took(spark):
    taken = [(f"h{i}", f"2024-01-{i + 1:02}", "x", i % 3) for i in range(12)]
    done = spark.createDataFrame([(h, at, run, run != 1) for h, at, _, run in taken], "hash string, indexed_at string, run long, ok boolean")

    def numbers(rows):
        items = incremental.taken_versions(records(spark, rows), done, run="run", ok="ok")
        order = [incremental.F.col("run").asc_nulls_last(), *map(incremental.F.col, ("at", "key", "digest"))]
        return {r.k: (r.lane, r.seq) for r in incremental.numbered(items, order, 2).select(incremental._unpacked(incremental.F.col("key")).alias("k"), "lane", "seq").collect()}

    before = numbers([r[:3] for r in taken])
    after = numbers([r[:3] for r in taken] + [(f"late{i}", "2019-05-05", "x") for i in range(9)])
    assert before == {k: v for k, v in after.items() if not k.startswith("late")}
    assert len(set(after.values())) == len(after)


def test_ledger_numbers_once_and_takes_what_is_open(spark, tmp_path):
    ledger = incremental.Ledger(spark, str(tmp_path / "l"), lanes=2)
    first = [(f"h{i}", "2024-01-02", "x") for i in range(6)]
    run = ledger.take(records(spark, first))
    assert sorted(r.key for r in run.rows.collect()) == [f"h{i}" for i in range(6)]
    numbers = {(bytes(r.key), bytes(r.digest)): (r.lane, r.seq) for r in ledger.journal().collect()}
    assert ledger.commit(run.rows.select("key"), run)
    # The same gaps again are refused, and nothing is repeated.
    assert not ledger.commit(run.rows.select("key"), run)
    assert ledger.output().count() == 6
    # Late, changed and replaced records; an old number never moves.
    second = [*first, ("late", "2019-01-01", "x"), ("h1", "2024-02-01", "new"), ("h2", "2024-02-01", "once"), ("h2", "2024-03-01", "x")]
    failed = ledger.take(records(spark, second))
    assert sorted(r.key for r in failed.rows.collect()) == ["h1", "late"]
    after = {(bytes(r.key), bytes(r.digest)): (r.lane, r.seq) for r in ledger.journal().collect()}
    assert numbers.items() <= after.items() and len(set(after.values())) == len(after) == 9
    again = ledger.take(records(spark, second))  # the run before died: the same rows are open under the same numbers
    assert sorted(map(tuple, again.rows.select("key", "lane", "seq").collect())) == sorted(map(tuple, failed.rows.select("key", "lane", "seq").collect()))
    assert ledger.commit(again.rows.select("key"), again)
    assert ledger.take(records(spark, second)).rows.count() == 0
    assert sorted(r.key for r in ledger.output().collect()) == sorted([f"h{i}" for i in range(6)] + ["h1", "late"])
    # A replaced version wasn't stored as processed: a record that goes back to it is open again.
    back = [*second, ("h2", "2024-04-01", "once")]
    assert [r.key for r in ledger.take(records(spark, back)).rows.collect()] == ["h2"]


def test_only_one_of_two_writers_publishes(spark, tmp_path):
    one, two = (incremental.Ledger(spark, str(tmp_path / "l"), lanes=2) for _ in range(2))
    data = records(spark, [("a", "2024-01-01", "x"), ("b", "2024-01-01", "x")])
    a, b = one.take(data), two.take(data)
    state = two.state()
    assert one.commit(a.rows.select("key"), a)
    assert not two.commit(b.rows.select("key"), b)
    assert not two._publish(state, {"outputs": ["lost"]})  # its number is taken
    assert sorted(r.key for r in one.output().collect()) == ["a", "b"]


def test_ledger_of_empty_and_keyless_records(spark, tmp_path):
    ledger = incremental.Ledger(spark, str(tmp_path / "l"))
    run = ledger.take(records(spark, []))
    assert run.rows.count() == 0 and ledger.commit(run.rows, run)
    assert ledger.take(records(spark, [(None, "2024-01-01", "x")])).rows.count() == 0
    assert [r.key for r in ledger.take(records(spark, [("k", None, None), ("k", None, None)])).rows.collect()] == ["k"]

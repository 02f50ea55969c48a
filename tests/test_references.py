import datetime as dt

import pytest

from corvane.operators.references import Parent, ReferenceCheck, Referrer

T = lambda day, hour=0: dt.datetime(2024, 1, day, hour)
REL = "id string, source_id string, target_id string, evidence array<string>, loaded_at timestamp, target string, ref_key string, live int"
ENT = "id string, loaded_at timestamp, named int"
TOMB = "table_name string, record_key string, deleted_at timestamp"


def run(spark, relations, entities, tombs=(), units=()):
    rel = spark.createDataFrame([(*r, "x", "y", 1) for r in relations], REL)
    ent = spark.createDataFrame([(*e, 1) for e in entities], ENT)
    unit = spark.createDataFrame([(*u, 1) for u in units], ENT)
    check = ReferenceCheck(
        [Referrer("relations", rel, {"source_id": "entities", "target_id": "entities", "evidence": "text_units"})],
        [Parent("entities", ent), Parent("text_units", unit)],
        spark.createDataFrame(list(tombs), TOMB),
    )
    return sorted((r.field_name, r.record_id, r.ref_key, r.reason) for r in check.orphans().collect()), check


def test_missing_blank_repeated_and_spelled_keys(spark):
    found, check = run(
        spark,
        [("R1 ", " A", "b", ["u1", None, " ", "u1", "U2 "], T(2)), ("r1", "a", "B", None, T(3)), (None, None, "", None, None), (None, "zz", None, [], None)],
        [("a", T(1)), ("B ", T(1))],
        units=[("u1", T(2))],
    )
    assert found == [("evidence", "r1", "u2", "missing"), ("source_id", None, "zz", "missing")]
    assert {(r.field_name, r.period, r.n_references, r.n_missing, r.n_late) for r in check.report().collect()} == {("evidence", "2024-01", 1, 1, 0), ("source_id", None, 1, 1, 0)}


def test_late_means_more_than_a_day_after_the_records_first_row(spark):
    rows = [("r1", "edge", "late", None, T(1)), ("r2", "edge", "late", None, T(5)), ("r2", "edge", "late", None, T(1, 1)), ("r3", "late", "edge", None, T(3))]
    found, _ = run(spark, rows, [("edge", T(2)), ("late", T(2, 2)), ("late", T(9))])
    assert found == [("target_id", "r1", "late", "late"), ("target_id", "r2", "late", "late")]


def test_tombstones(spark):
    rows = [("r", "gone", "back", ["kept"], T(9)), ("q", "untimed", "back", None, T(9))]
    tombs = [("entities", " GONE", T(3)), ("entities", "back", T(3)), ("entities", "back", T(4)), ("text_units", "gone", T(4)), ("entities", "kept", T(4)), ("entities", "untimed", None), ("entities", None, T(1))]
    found, _ = run(spark, rows, [("gone", T(2)), ("back", T(2)), ("back", T(4, 1)), ("untimed", T(8))], tombs, [("kept", T(1))])
    assert found == [("source_id", "q", "untimed", "missing"), ("source_id", "r", "gone", "missing")]


def test_null_times_are_never_late_and_empty_tables_work(spark):
    assert run(spark, [("r", "a", "a", None, None)], [("a", None)])[0] == []
    assert run(spark, [("r", "a", "a", None, T(1))], [("a", None)])[0] == []
    assert run(spark, [], [])[0] == []
    assert run(spark, [("r", "a", None, None, T(1))], [])[0] == [("source_id", "r", "a", "missing")]


def test_hot_key_and_long_key(spark):
    long = "k" * 100_000
    rows = [(f"r{i}", "hot", long, None, T(1)) for i in range(300)]
    found, _ = run(spark, rows, [(long, T(1))])
    assert len(found) == 300 and {f[2] for f in found} == {"hot"}


@pytest.mark.parametrize("grace,late", [("1 day", True), ("10 days", False)])
def test_grace_is_a_parameter(spark, grace, late):
    rel = spark.createDataFrame([("r", "a", None, None, T(1), "", "", 1)], REL)
    check = ReferenceCheck([Referrer("x", rel, {"source_id": "e"})], [Parent("e", spark.createDataFrame([("a", T(5), 1)], ENT))], None, grace)
    assert bool(check.orphans().collect()) == late

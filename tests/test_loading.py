"""Releases, revisions of returns, validators, queues and the tracker on small tables of their own."""

from __future__ import annotations

import datetime as dt
import json
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidewatch.operators import cleaning, releases, signals, submissions, tracker, validation


def test_units_keep_their_identity_over_releases(spark):
    rows = [(1, "a", "Alpha", "D1", True), (1, "b", "Beta", "D1", True), (2, "a", "Alpha Town", "D1", True), (2, "c", "Gamma", "D2", False), (3, "a", "Alpha Town", "D2", True), (3, "b", "Beta", "D1", True), (3, "c", "Delta", "D1", True)]
    df = spark.createDataFrame(rows, "version int, code string, name string, parent string, geometry boolean")
    got = {(r.version, r.code): (r.change, r.active, r.name, r.parent) for r in releases.history(df, [1, 2, 3]).collect()}
    assert got == {
        (1, "a"): ("new", True, "Alpha", "D1"), (1, "b"): ("new", True, "Beta", "D1"),
        (2, "a"): ("renamed", True, "Alpha Town", "D1"), (2, "b"): ("deactivated", False, "Beta", "D1"), (2, "c"): ("new", True, "Gamma", "D2"),
        (3, "a"): ("moved", True, "Alpha Town", "D2"), (3, "b"): ("reactivated", True, "Beta", "D1"), (3, "c"): ("renamed_and_moved", True, "Delta", "D1"),
    }
    again = releases.history(df, [1, 1])
    assert {r.change for r in again.where("code = 'a'").collect()} == {"new", "unchanged"}


def test_revisions_of_returns(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, 7, "weekly", d, 1, "x", 1), (2, 7, "weekly", d, 1, "x", 2), (3, 7, "weekly", d, 1, "y", 3), (4, 7, "weekly", d, 3, "z", 4), (5, 7, "weekly", d, 2, "w", 5), (6, 8, "weekly", d, 1, "x", 6), (7, 7, "monthly", d, 1, "x", 7), (8, 7, "weekly", d, 0, "x", 8)]
    df = spark.createDataFrame(rows, "id long, facility_id long, form string, starts date, revision int, checksum string, arrival long")
    got = {r.id: (r.outcome, r.supersedes, r.status) for r in submissions.loaded(df, spark.createDataFrame([(7,)], "facility_id long")).collect()}
    assert got == {1: ("loaded", None, "superseded"), 2: ("unchanged", None, None), 3: ("revision_payload_conflict", None, None), 4: ("loaded", 2, "accepted"), 5: ("loaded", 1, "superseded"), 6: ("facility_unresolved", None, None), 7: ("loaded", None, "accepted"), 8: ("revision_not_positive", None, None)}


GOOD = {"encounter_date": "2024-05-01", "sex": "F", "age": {"value": 3, "unit": "Years"}, "tests": [{"method": "RDT", "result": "positive"}], "prescriptions": ["a text", {"text": "x", "days": 3, "doses_per_day": "2"}], "diagnoses": ["fever"], "referrals": [{"number": "r1", "direction": "inbound"}]}


def issues_of(spark, *rows):
    lines = spark.createDataFrame([(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "id int, line string")
    found = validation.visit_issues(lines, F.to_date(F.lit("2024-12-31"))).orderBy("id").collect()
    return [[(i.code, i.path, i.severity) for i in r.issues] for r in found]


def test_visits_are_judged_by_every_rule(spark):
    change = lambda **k: GOOD | k
    got = issues_of(
        spark, GOOD, {"encounter_date": "2024-05-01"}, change(encounter_date="", sex="?"), change(encounter_date="2025-01-01"), change(encounter_date="2024-5-1"), "{", change(age={"value": 3}), change(age={"value": "three", "unit": "days"}), change(age={"value": 1, "unit": "weeks"}), change(age={"value": -1, "unit": "days"}),
        change(age={"value": 12, "unit": "months"}), change(tests=[{"method": "not_done", "result": "negative"}, 3, {"method": "x", "result": "y"}]), change(prescriptions=[{"text": "x", "days": 0, "units_per_dose": "?"}, {"text": ""}, 5], diagnoses=[None, "ok"], referrals=[{"direction": "x"}, {"number": "n", "direction": "x"}]), change(tests=None, diagnoses="", prescriptions={}, referrals=0),
    )
    e = lambda *x: (*x, "error")
    assert got == [
        [], [], [e("encounter_date_missing", "encounter_date"), e("unrecognised_code", "sex")], [e("encounter_date_in_future", "encounter_date")], [e("encounter_date_unparsable", "encounter_date")], [e("malformed_json", "$")], [e("age_pair_incomplete", "age")], [e("age_value_unparsable", "age.value")], [e("unrecognised_code", "age.unit")], [e("age_negative", "age.value")], [e("age_outside_unit_bounds", "age.value")],
        [e("result_without_a_test", "tests[0]"), e("test_not_an_object", "tests[1]"), e("unrecognised_code", "tests[2].method"), e("unrecognised_code", "tests[2].result")],
        [("diagnosis_blank", "diagnoses[0]", "warning"), e("prescription_factor_unparsable", "prescriptions[0].units_per_dose"), e("prescription_factor_not_positive", "prescriptions[0].days"), ("prescription_blank", "prescriptions[1]", "warning"), e("prescription_not_an_object", "prescriptions[2]"), ("referral_number_missing", "referrals[0]", "warning"), e("unrecognised_code", "referrals[1].direction")],
        [e("prescriptions_not_a_list", "prescriptions"), e("referrals_not_a_list", "referrals")],
    ]


def test_every_code_of_visits_and_returns_occurs(spark):
    seen = {r.code for r in validation.visit_issue_rows(spark, SMALL).select("code").distinct().collect()}
    assert {c for _, _, c, _ in validation.SEEDED.values() if c} <= seen
    returns = {r.code for r in validation.return_issue_rows(spark, "/root/testdata/sf0.01").select("code").distinct().collect()}
    assert len(returns) >= 25, returns


def test_an_empty_return_says_nothing(spark):
    lines = spark.createDataFrame([('{"id":1,"form":"monthly","starts":"2024-02-01","ends":"2024-02-29","revision":1,"observations":[]}',), ('{"id":2,"form":"weekly","starts":"2024-02-05","ends":"2024-02-11","revision":1,"stock":[{"element":"kits","metric":"days_out","value":"8"},{"element":"kits","metric":"on_hand","value":""},{"element":"kits","metric":"on_hand","value":"1"}]}',)], "line string")
    got = sorted((r.id, r.code, r.path) for r in validation.return_issues(lines).collect())
    assert got == [(1, "submission_is_empty", "$"), (2, "days_out_of_stock_exceeds_period", "stock[0].value"), (2, "duplicate_stock_row", "stock[2].commodity")]


RETURNS = ['{"id":1,"form":"yearly","starts":"2024-02-01","ends":"2024-02-29","revision":1}', '{"id":1,"form":"yearly","starts":"2024-02-01","ends":"2024-02-29","revision":1}', '{"id":2,"form":"weekly","starts":"2024-02-05","ends":"2024-02-11","revision":0,"observations":[{"age_band":"under_5","sex":"male","value":"x"},{"element":"deaths","age_band":"unspecified","sex":"male","value":"x"},{"element":"deaths","age_band":"unspecified","sex":"male","value":"2"},null],"laboratory":[{"element":"smear","value":"1"}]}']


@pytest.mark.parametrize("keyed", [False, True])
def test_returns_of_one_id_have_their_issues_each(spark, keyed):
    lines = spark.createDataFrame([(json.loads(x)["id"], x) for x in RETURNS], "id long, line string")
    got = sorted((r.id, r.code, r.path, r.severity) for r in validation.return_issues(lines if keyed else lines.select("line")).collect())
    assert got == [
        (1, "unknown_form", "form", "error"), (1, "unknown_form", "form", "error"), (2, "duplicate_cell", "observations[2].element", "error"), (2, "laboratory_block_on_the_wrong_form", "laboratory[0]", "error"), (2, "revision_not_positive", "revision", "error"),
        (2, "value_not_numeric", "observations[0].value", "warning"), (2, "value_not_numeric", "observations[1].value", "warning"),
    ]


def test_returns_are_shuffled_once_and_their_rules_compiled(spark):
    """Lines that are parted by id are judged where they are; no generated method is above 8,000 bytes, where the JVM stops to compile."""
    lines = spark.createDataFrame([(json.loads(x)["id"], x) for x in RETURNS], "id long, line string").repartition(4, "id")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = validation.return_issues(lines)._jdf.queryExecution()
        code = run.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
        assert run.executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", code)]
    assert sizes and max(sizes) < 8000, sizes


def test_a_payload_of_many_keys_becomes_one_map(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [(0, at, 3, "error", 1.0, '{"k": 60, "z": 1}'), (1, at + dt.timedelta(hours=1), 3, "error", 1.0, '{"k": 70, "m": "x"}'), (2, at, 3, "purchase", 1.0, '{"k": 2}'), (4, at, 50, "error", 1.0, '{"k": 1}'), (6, at, 4, "click", 1.0, '{"k": 1}'), (8, at, 4, "error", 1.0, '{"q": 1}'), (10, at, 4, "view", 1.0, '{"k": "hot"}'), (12, at, 5, "purchase", 1.0, '{"k": 3}'), (14, at, 4, "error", 1.0, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    mapping = (*tracker.MAPPING, ("error", "m", "method"))
    got = {r.external_id: (r.event_id, r.concepts, r.reason) for r in tracker.translated(spark, str(tmp_path), mapping).collect()}
    assert got[0] == (1, {"parasite_count": "70", "method": "x"}, "not_a_number") or got[0][1] == {"method": "x", "parasite_count": "70"}
    assert {k: v[2] for k, v in got.items() if k} == {2: None, 4: "no_person", 6: "type_not_mapped", 8: "no_mapped_concept", 10: "not_a_number", 12: None, 14: "no_mapped_concept"}
    assert [tuple(r) for r in tracker.tracker_encounters(spark, str(tmp_path)).collect()] == [(3, at.date(), "tested", 1, 1, 0, 2)]
    assert [r.external_id for r in tracker.tracker_unlinked(spark, str(tmp_path)).collect()] == [12]


def test_queues_hold_the_newest_of_their_cases(spark):
    cases = spark.createDataFrame([(i, s, p, o, dt.date(2024, 1, i)) for i, s, p, o in [(1, "new", "high", 1), (2, "closed", "urgent", 1), (3, "under_investigation", "routine", 2), (4, "new", "routine", 2)]], "id long, status string, priority string, owner long, opened date")
    got = {}
    for r in submissions.queues(cases, spark.createDataFrame([(2,), (2,), (9,)], "id long"), F.lit(2), limit=1).collect():
        got[r.queue] = (r.place, r.id)
    assert got == {"new": (1, 4), "high_priority": (1, 1), "assigned_to_me": (1, 4), "under_investigation": (1, 3), "awaiting_external_result": (1, 2), "resolved": (1, 2)}


def test_ids_of_sets_do_not_hang_on_order(spark):
    d = spark.range(5000).select((F.col("id") % 2).alias("id"), F.col("id").cast("string").alias("member"))
    one, two = ({r.id: r.group_id for r in cleaning.set_ids(x, "k").collect()} for x in (d, d.orderBy(F.desc("member")).repartition(7)))
    assert one == two and len(set(one.values())) == 2
    assert cleaning.set_ids(d, "other").first().group_id not in one.values()


@pytest.mark.parametrize("view", [signals.signal_scores, signals.signal_explanations, signals.signals_newest])
def test_views_of_signals_read_one_evaluation(spark, view):
    signals.found_signals(spark, SMALL)
    plan = view(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "evaluations/signals" in plan

"""Overlap joins, periods in force, and evidence with its coverage, against plain Python."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidewatch.operators import evidence, intervals, sequences

DAY = dt.date(2020, 1, 1)


def at(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def periods(spark, rows, name):
    return spark.createDataFrame([(i, k, at(s), at(e)) for i, (k, s, e) in enumerate(rows)], f"{name} int, k string, starts date, ends date")


def test_overlaps_are_found_once_each(spark):
    rng = random.Random(2)
    make = lambda n: [(rng.choice("xyz"), s := rng.randrange(-40000, 500), s + rng.choice([0, 0, 1, 6, 30, 365, 9000, -1])) for _ in range(n)] + [("x", None, 3), ("x", 3, None), ("x", 0, 0), ("x", -50000, 50000)]
    a, b = make(150), make(150)
    ok = lambda p: None not in p and p[1] <= p[2]
    want = Counter((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if ok(p) and ok(q) and p[0] == q[0] and p[1] <= q[2] and q[1] <= p[2])
    m = intervals.overlapping(periods(spark, a, "i"), periods(spark, b, "j"), ["k"])
    assert Counter((r.i, r.j) for r in m.collect()) == want and len(want) > 300
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    none = periods(spark, a, "i").where("1 = 0")
    assert intervals.overlapping(none, periods(spark, b, "j"), ["k"]).count() == intervals.overlapping(periods(spark, a, "i"), none.withColumnRenamed("i", "j"), ["k"]).count() == 0


def test_the_period_in_force_is_the_last_that_started(spark):
    p = spark.createDataFrame([("a", at(0), 1), ("a", at(5), 2), ("a", at(5), 3), ("b", at(9), 4)], "k string, starts date, v int")
    rows = spark.createDataFrame([(i, k, at(n)) for i, (k, n) in enumerate([("a", -1), ("a", 0), ("a", 4), ("a", 5), ("a", 99), ("b", 8), ("b", 9), ("c", 9)])], "i int, k string, d date")
    got = {r.i: r.v for r in intervals.in_force(rows, p, "k", "d", "v").collect()}
    assert got == {0: None, 1: 1, 2: 1, 3: 3, 4: 3, 5: None, 6: 4, 7: None}


def test_evidence_is_of_patients_with_a_positive_in_the_year(spark):
    e = evidence.encounters(spark, SMALL).collect()
    asked = {(r.encounter_date.year, r.patient_id) for r in e if r.any_positive and r.patient_id is not None}
    want = Counter()
    for r in e:
        for y in {r.encounter_date.year, (r.encounter_date + dt.timedelta(days=evidence.RULE.window)).year}:
            if (y, r.patient_id) in asked:
                want[y, r.encounter_id] += 1
    assert Counter((r.year, r.encounter_id) for r in evidence.stored_evidence(spark, SMALL).collect()) == want
    some = evidence.stored_evidence(spark, SMALL, (1996, 1997))
    assert Counter((r.year, r.encounter_id) for r in some.collect()) == Counter({k: n for k, n in want.items() if k[0] in (1996, 1997)})
    assert "GreaterThanOrEqual(o_orderdate,1995-09-03T00:00)" in some._jdf.queryExecution().executedPlan().toString()


def test_every_outcome_and_reason_occurs_and_follows_from_the_evidence(spark):
    rows = evidence.determined(spark, SMALL).withColumn("how", evidence.determination()).collect()
    days = {}
    for r in evidence.decided(spark, SMALL).where("counted").collect():
        days.setdefault((r.year, r.patient_id), set()).add(r.day)
    for r in rows:
        start = dt.date(r.year, 1, 1)
        own = sorted(d for d in days.get((r.year, r.patient_id), ()) if start - dt.timedelta(days=evidence.RULE.window) <= d <= dt.date(r.year, 12, 31))
        n = [(d - dt.date(1970, 1, 1)).days for d in own]
        assert r.chain == sequences.best_chain(n, evidence.RULE, (start - dt.date(1970, 1, 1)).days)
        assert r.in_period == sum(d >= start for d in own)
        want = "not_in_period" if not r.in_period else "qualifies" if r.chain else "indeterminate" if r.unreliable else "does_not_qualify"
        assert r.how == want
    assert {r.how for r in rows} >= {"not_in_period", "qualifies", "indeterminate"}
    assert {"early_end", "unresolved_tests", "incomplete_coverage", "window_unobserved"} <= {c for r in rows for c in r.unreliable.split(",")}


@pytest.mark.parametrize("gap,window,least", [(-1, 5, 2), (6, 5, 2), (1, 5, 1)])
def test_rules_that_make_no_sense_are_refused(gap, window, least):
    with pytest.raises(ValueError):
        sequences.ChainRule(gap, window, least)


def test_decisions_sort_their_rows_once(spark):
    """Twins of a day, disputed and undated rows; an encounter's key that comes twice counts once."""
    rows = [(1, "2020-01-05", True, False), (2, "2020-01-05", True, False), (2, "2020-01-05", True, False), (3, "2020-01-05", True, True), (4, None, True, False), (5, None, True, False), (6, "2020-01-05", False, False), (7, "2020-02-01", True, True), (8, "2020-03-01", True, False)]
    e = spark.createDataFrame([(2020, 9, *r) for r in rows], "year int, patient_id long, encounter_id long, day string, positive boolean, disputed boolean").withColumn("day", F.to_date("day")).withColumn("any_positive", F.lit(True))
    d = evidence.judged(e)
    got = Counter((r.encounter_id, r.is_possible_duplicate, r.reason) for r in d.collect())
    again = "same_day_not_representative"
    assert got == Counter({(1, True, "eligible_positive"): 1, (2, True, again): 2, (3, True, "excluded_by_quality_rule"): 1, (4, False, "excluded_unusable_date"): 1, (5, False, "excluded_unusable_date"): 1, (6, False, "positive_method_not_permitted"): 1, (7, False, "excluded_by_quality_rule"): 1, (8, False, "eligible_positive"): 1})
    assert {r.encounter_id: r.ref for r in d.where("encounter_id IN (4, 5, 7, 8)").collect()} == {7: "E6", 8: "E7", 4: "E8", 5: "E9"}
    plan = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1

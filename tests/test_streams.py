"""Streams give the same figures for one file, many files and any order of them."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tidewatch.streaming import arrivals, persistence

DAY = dt.datetime(2024, 3, 1)


def daily(df):
    return {(r.day, r.event_type): (r.n, r.total) for r in df.collect()}


def test_many_shuffled_files_give_the_figures_of_one(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    want = daily(arrivals.by_day(events))
    events.repartition(130, F.col("ts").cast("date"), F.xxhash64("event_id") % 5).write.parquet(str(tmp_path / "in"))
    got = arrivals.run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), files=25)
    assert daily(got) == want
    late = got.agg(F.sum("late")).first()[0]
    assert late == arrivals.late_rows(spark, str(tmp_path / "out")).count() > 0


def write(spark, folder, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(str(folder))


def test_repeats_late_rows_and_a_restart(spark, tmp_path):
    at = lambda d, h=0: DAY + dt.timedelta(days=d, hours=h)
    first = [(1, at(0), "a", 1.5), (1, at(0), "a", 1.5), (2, at(9), "a", 2.0), (3, at(8, 1), "b", None)]
    second = [(2, at(9), "a", 2.0), (1, at(0), "a", 1.5), (4, at(1), "a", 7.0), (4, at(1), "a", 7.0), (5, at(9), "b", 3.0), (None, at(2), "a", 1.0), (6, None, "a", 1.0)]
    third = [(4, at(1), "a", 7.0), (7, at(20), "a", 1.0), (3, at(8, 1), "b", None)]
    for rows in (first, second, third):
        write(spark, tmp_path / "in", rows)
        got = arrivals.run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), slots=1)
    rows = {(r.day, r.event_type): (r.n, r.total, r.late) for r in got.collect()}
    d = lambda n: at(n).date()
    assert rows == {(d(0), "a"): (1, 1, 0), (d(9), "a"): (1, 2, 0), (d(8), "b"): (1, None, 0), (d(1), "a"): (1, 7, 1), (d(9), "b"): (1, 3, 0), (d(20), "a"): (1, 1, 0)}


def islands(months):
    out = Counter()
    for key, m in months:
        own = sorted(m)
        start = None
        for i, x in enumerate(own):
            start = x if start is None or own[i - 1] != x - 1 else start
            if i + 1 == len(own) or own[i + 1] != x + 1:
                out[key, start, x] += 1
    return out


@pytest.mark.parametrize("keep", [3, 24, 400])
def test_runs_of_months_in_any_order(spark, tmp_path, keep):
    rng = random.Random(keep)
    months = {k: set(rng.sample(range(24000, 24090), 45)) for k in range(6)}
    rows = [(k, dt.date(m // 12, m % 12 + 1, 1), True) for k, ms in months.items() for m in ms]
    rows += rng.choices(rows, k=40) + [(k, dt.date(2000, 1 + k, 1), False) for k in range(6)] + [(9, dt.date(2001, 1, 1), False)]
    rng.shuffle(rows)
    for i in range(5):
        spark.createDataFrame(rows[i::5], "district_id long, month date, flagged boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = persistence.run_available(spark, str(tmp_path / "in"), str(tmp_path / "out"), keep=keep)
    number = lambda d: d.year * 12 + d.month - 1
    found = Counter((r.district_id, number(r.first_month), number(r.last_month)) for r in got.collect())
    assert found == islands(months.items())
    assert all(r.periods == number(r.last_month) - number(r.first_month) + 1 and r.sustained == (r.periods >= 2) for r in got.collect())

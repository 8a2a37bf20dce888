"""Operators on small tables of their own: artefacts, merges, pages, comparisons, supersession, components."""

from __future__ import annotations

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import graph, ingestion, runs, signals
from tidewatch.plans.registry import SQL
from tidewatch.sources import jsonl


def test_lines_are_read_and_judged(spark, tmp_path):
    escaped = '{"record_type":"encounter","source_row_id":"5","a":[{"b":{"patient\\u004eame":1}}]}'
    lines = [escaped, '{"record_type":"encounter","source_row_id":"1"}', "  ", "{broken", '{"record_type":"other","source_row_id":"2"}', '{"record_type":"encounter","source_row_id":" "}', '{"record_type":"encounter","source_row_id":"3","x":[{"National-ID":"z"}]}', '{"record_type":"encounter","source_row_id":"4","note":"a \\"full_name\\" in a text"}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    got = {r.line: r.fault for r in jsonl.judged(jsonl.read(spark, str(tmp_path))).collect()}
    assert [got.get(x, "skipped") for x in lines] == ["forbidden_field", None, "skipped", "malformed_json", "wrong_record_type", "missing_source_row_id", "forbidden_field", None]


def test_forbidden_keys_are_found_at_any_depth(spark):
    deep = '{"surname":1}'
    for _ in range(12):
        deep = '{"x":[' + deep + ']}'
    texts = ['{"a":{"b":[1,[2,{"National-ID":null}],{"n":{"FULL NAME":{}}}]}}', r'{"say":"\"surname\": no key","k":"full_name"}', r'{"\u0073urname":"x"}', deep, "[]", "3", "{bad", r'[{"phone\/number":1},{"phoneNumber":2}]']
    d = spark.createDataFrame([(t,) for t in texts] + [(texts[0],)], "line string")
    got = {r.line: r.paths for r in d.withColumn("line_id", jsonl.line_id()).join(jsonl.forbidden_paths(d), "line_id").distinct().collect()}
    assert got == {texts[0]: ["$.a.b[1][1].National-ID", "$.a.b[2].n.FULL NAME"], texts[2]: ["$.surname"], deep: ["$" + ".x[0]" * 12 + ".surname"], texts[7]: ["$[0].phone/number", "$[1].phoneNumber"]}


def test_lines_of_both_forbidden_kinds_are_of_the_first(spark, same_rows, tmp_path):
    """Keys that 1013 and 1021 divide come in larger tables only."""
    small = "/root/testdata/sf0.001"
    keys = [1013 * 1021 * i for i in range(1, 4)] + [1013, 1021, 1013 * 1019]
    o = spark.read.parquet(f"{small}/orders.parquet").limit(len(keys)).toPandas().assign(o_orderkey=keys)
    o.to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    for t in ("nation", "region", "customer", "supplier", "part", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    got = ingestion.forbidden_fields(spark, str(tmp_path))
    assert got.where("id = 1034273").first().paths == "$.extra.contact.Patient_Name"
    same_rows(got, SQL["forbidden_fields"], str(tmp_path))


def test_a_load_that_comes_again_changes_nothing(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, None, 3)], "k int, v string, revision int")
    load = spark.createDataFrame([(1, "b"), (2, None), (3, "c")], "k int, v string")
    once = ingestion.merged(stored, load, "k", ["v"])
    assert sorted(map(tuple, once.collect())) == [(1, "b", 2), (2, None, 3), (3, "c", 1)]
    assert sorted(map(tuple, ingestion.merged(once, load, "k", ["v"]).collect())) == sorted(map(tuple, once.collect()))


def test_keyed_hashes_are_those_of_the_standard(spark):
    for key in (b"short", b"long" * 40):
        got = spark.range(1).select(ingestion.hmac_sha256(key, F.lit("2567é")).alias("x")).first().x
        assert got == hmac.new(key, "2567é".encode(), hashlib.sha256).hexdigest()


def test_pages_follow_and_refuse_foreign_cursors(spark):
    rows = spark.range(7).withColumnRenamed("id", "k")
    got, at = [], None
    for _ in range(3):
        some, at = runs.page(rows, [F.desc("k")], 3, at, "set")
        got.append([r.k for r in some.collect()])
    assert got == [[6, 5, 4], [3, 2, 1], [0]]
    with pytest.raises(ValueError):
        runs.page(rows, [F.desc("k")], 3, at, "other set")


def test_deltas_hold_keys_of_either_side(spark):
    a, b = (spark.createDataFrame(x, "k string, n long") for x in ([("x", 2), ("y", 1)], [("y", 4), ("z", 3)]))
    assert sorted(map(tuple, runs.deltas(a, b, "k").collect())) == [("x", 2, 0, -2), ("y", 1, 4, 3), ("z", 0, 3, 3)]


def test_one_signal_of_a_group_is_active(spark):
    runs_ = spark.createDataFrame([("g", "a", 1), ("g", "a", 2), ("g", "b", 3), ("h", "c", 2)], "group_key string, input_fingerprint string, run int")
    got = {(r.group_key, r.input_fingerprint): (r.run, r.superseded_by, r.status) for r in signals.superseded(runs_).collect()}
    assert got == {("g", "a"): (1, "b", "superseded"), ("g", "b"): (3, None, "active"), ("h", "c"): (2, None, "active")}


def test_repeated_and_context_evidence_never_votes(spark):
    e = lambda kind, role, print_, source="s": (kind, 1, None, "2024-01-01", role, source, print_, "2024-01-31")
    rows = [e("temporal_anomaly", "supporting", "p", "r1"), e("temporal_anomaly", "supporting", "p", "r2"), e("hotspot", "supporting", "q"), e("recurrence", "counter", "c"), e("commodity_alert", "context", "x")]
    df = spark.createDataFrame(rows, "kind string, district_id long, facility_id long, month string, role string, source_id string, fingerprint string, cutoff string")
    (s,) = signals.signals(df, signals.rule_table(spark)).where("rule = 'district_rise'").collect()
    assert (s.score, s.evidence, s.counter, s.priority) == (3, 2, 1, "routine")
    assert not signals.signals(df.where("kind <> 'hotspot'"), signals.rule_table(spark)).where("rule = 'district_rise'").collect()
    assert signals.not_configured(spark, ["method"]).first().active is None


def test_signals_take_counts_of_stock_outs_as_all_their_findings(spark, tmp_path):
    """A supplier's key comes twice, once without a nation. Evidence reads what was written of visits and stock, never lines; the
    hash of a finding is made after the one exchange of rules."""
    small = "/root/testdata/sf0.001"
    for t in ("nation", "region", "customer", "part", "orders", "lineitem"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{small}/{t}.parquet")
    s = spark.read.parquet(f"{small}/supplier.parquet")
    other = s.where("s_suppkey < 4").withColumn("s_nationkey", F.when(F.col("s_suppkey") > 1, (F.col("s_nationkey") + 1) % 25).cast(s.schema["s_nationkey"].dataType))
    s.union(other).write.parquet(str(tmp_path / "supplier.parquet"))
    every = signals.signal_evidence(spark, str(tmp_path))
    plan = every._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "orders.parquet" not in plan
    rows = signals.alert_evidence(spark, str(tmp_path))
    want = rows.groupBy("district_id", "facility_id", "month").agg(F.count_distinct("facts").alias("n"))
    got = signals.alert_counts(spark, str(tmp_path)).select(want.columns)
    assert rows.where("votes > 1").count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    columns = ["group_key", "input_fingerprint", "score", "evidence", "counter", "context", "cutoff"]
    found = signals.signals(every, signals.rule_table(spark)).select(columns).collect()
    assert found and sorted(map(str, found)) == sorted(map(str, signals.found_signals(spark, str(tmp_path)).select(columns).collect()))
    plan = signals.scoped(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "sha2" in plan.split("Exchange")[0] and "sha2" not in "".join(plan.split("Exchange")[1:])


def test_components_of_long_paths(spark):
    nodes = spark.range(40).select(F.col("id").alias("node"))
    e = spark.createDataFrame([(i, i + 1) for i in range(30)], "src long, dst long")
    both = e.union(e.select("dst", "src"))
    got = {r.node: r.label for r in graph.connected(nodes, both).collect()}
    assert got == {i: 0 if i <= 30 else i for i in range(40)}


def test_features_beyond_the_limit_are_refused(spark):
    with pytest.raises(ValueError):
        ingestion.geojson_features(spark, "/root/testdata/sf0.001", most=3)

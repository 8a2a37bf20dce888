"""Signals: evidence of six kinds under one schema, scored by rules, with their order, supersession and explanation.

Evidence is what upstream operators have judged already. A rule takes kinds with weights; evidence for a scope (district
or facility) and month that reaches the rule's least evidence and least score makes one signal. Everything is grouped by
(rule, scope, month), which no single scope dominates, and rules are a table of a few rows.

Until a finding's fingerprint is asked for, its facts stand for it: they are short, a hash is long and does not compress.
Most kinds come from a grouping by what identifies a finding, so they hold no finding twice and need no second grouping.
Stock-outs are the bulk of evidence and context only; rules take their counts.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import flags, sequences, statistics, stored, surveillance
from tidewatch.plans.registry import query
from tidewatch.sources import bind

#: (code, type, least evidence, least score, {kind: weight}): the approved rules; commodity alerts are context and weigh nothing.
RULES = (
    ("district_rise", "transmission_increase", 2, 3, {"temporal_anomaly": 2, "hotspot": 2, "spatial_cluster": 1, "recurrence": 1, "commodity_alert": 0}),
    ("district_repeat", "recurrence_pattern", 1, 2, {"recurrence": 2, "temporal_anomaly": 1}),
    ("facility_conflict", "data_conflict", 2, 2, {"reconciliation": 1, "recurrence": 1, "commodity_alert": 0}),
)
#: Priorities from the lowest on, with the least score of each.
BANDS = (("routine", 2), ("elevated", 4), ("high", 5), ("urgent", 6))
KEYS = ["rule", "district_id", "facility_id", "month"]
SCOPE = ["district_id", "facility_id", "month"]
EVIDENCE = ["kind", "district_id", "facility_id", "month", "role", "source_id", "fingerprint", "cutoff"]


def _shaped(rows: DataFrame, kind: str | Column, facts: list[str], supports: Column | None) -> DataFrame:
    """rows (district_id, facility_id, month, cutoff, source_id, facts, and votes where a row stands for several) under the schema of
    evidence, with facts as one text in the place of the fingerprint."""
    role = F.lit("context") if supports is None else F.when(supports, "supporting").otherwise("counter")
    votes = F.col("votes") if "votes" in rows.columns else F.lit(1).cast("long")
    return rows.select(F.lit(kind).alias("kind"), *SCOPE, role.alias("role"), "source_id", F.concat_ws("|", *_texts(facts)).alias("facts"), "cutoff", votes.alias("votes"))


def _texts(columns: list[str]) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]


def printed(rows: DataFrame) -> DataFrame:
    """rows of _shaped() with their fingerprints."""
    return rows.withColumn("fingerprint", F.sha2(F.concat_ws("|", "kind", *_texts(SCOPE), "facts"), 256))


def _sql_shaped(rows: str, kind: str, facts: list[str], supports: str | None) -> str:
    role = "'context'" if supports is None else f"CASE WHEN {supports} THEN 'supporting' ELSE 'counter' END"
    parts = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in ["district_id", "facility_id", "month", *facts])
    return f"SELECT '{kind}' AS kind, district_id, facility_id, month, {role} AS role, source_id, sha256('{kind}|' || {parts}) AS fingerprint, cutoff FROM ({rows})"


def anomaly_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged anomalies; the engine that makes them has run twice, so each comes under two source ids."""
    j = statistics.judged(statistics.baselines(statistics.series(spark, sf_dir, visits(spark, sf_dir)), ["district_id"])).where("outcome IN ('flagged', 'not_flagged')")
    j = j.select("district_id", F.lit(None).cast("long").alias("facility_id"), "month", F.last_day("month").alias("cutoff"), "outcome", F.explode(F.array(F.lit("run1"), F.lit("run2"))).alias("source_id"))
    return _shaped(j, "temporal_anomaly", ["outcome"], F.col("outcome") == "flagged")


def hotspot_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged hotspots, and whether a hotspot touches another one.

    Each judged district tells its neighbours whether it is a hotspot, so one grouping by (district, month) takes the
    place of a join of the hotspots with themselves.
    """
    hot = statistics.hotspots(spark, sf_dir, visits(spark, sf_dir)).where("outcome IN ('hotspot', 'not_hotspot')").select("district_id", "month", "outcome")
    near = statistics.adjacency(spark, sf_dir).groupBy(F.col("src").alias("district_id")).agg(F.collect_list("dst").alias("near"))
    own = F.array(F.struct("district_id", "outcome", F.lit(0).alias("vote")))
    told = F.transform(F.when(F.col("outcome") == "hotspot", F.col("near")), lambda d: F.struct(d.alias("district_id"), F.lit(None).cast("string").alias("outcome"), F.lit(1).alias("vote")))
    x = hot.join(near, "district_id", "left").select("month", F.explode(F.concat(own, F.coalesce(told, F.array().cast("array<struct<district_id:bigint,outcome:string,vote:int>>")))).alias("s"))
    h = x.groupBy("s.district_id", "month").agg(F.max("s.outcome").alias("outcome"), F.sum("s.vote").alias("votes")).where("outcome IS NOT NULL")
    h = h.withColumn("clustered", (F.col("outcome") == "hotspot") & (F.col("votes") > 0))
    fact = lambda kind, value, supports: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("fact"), supports.alias("supports"))
    facts = F.explode(F.array(fact("hotspot", F.col("outcome"), F.col("outcome") == "hotspot"), fact("spatial_cluster", F.col("clustered"), F.col("clustered"))))
    h = h.select("district_id", F.lit(None).cast("long").alias("facility_id"), "month", F.last_day("month").alias("cutoff"), F.lit("run1").alias("source_id"), facts.alias("f")).select("*", "f.*")
    return _shaped(h, F.col("kind"), ["fact"], F.col("supports"))


def recurrence_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeat-positive episodes by the month in which they began, for the index facility and the residence."""
    # Treatment is not asked for here and would take the medicines of all lines.
    e = sequences.episodes(spark, sf_dir, visits(spark, sf_dir).withColumn("treated", F.lit(None).cast("boolean"))).where("positives >= 1")
    scope = lambda d, f: F.struct(d.cast("long").alias("district_id"), f.cast("long").alias("facility_id"))
    x = e.select(F.trunc("first_day", "month").alias("month"), (F.col("positives") >= 2).alias("repeat"), F.explode(F.array(scope(F.col("index_residence"), F.lit(None)), scope(F.lit(None), F.col("index_facility")))).alias("s"))
    r = x.groupBy("s.district_id", "s.facility_id", "month").agg(F.count_if("repeat").alias("repeats"), F.count("*").alias("eligible"))
    r = r.select("district_id", "facility_id", "month", F.last_day("month").alias("cutoff"), F.lit("run1").alias("source_id"), "repeats", "eligible")
    return _shaped(r, "recurrence", ["repeats", "eligible"], F.col("repeats") > 0)


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions of facilities: when the return of a month came in."""
    return visits(spark, sf_dir).groupBy("facility_id", "month").agg(F.date_add(F.max("encounter_date"), 5).alias("received"))


def reconciliation_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparable findings with their submission's facility, month and the later of both dates."""
    f = surveillance.reconciliation(spark, sf_dir, visits(spark, sf_dir)).where("status IN ('matched', 'differs', 'derived_only')")
    r = f.join(returns(spark, sf_dir), ["facility_id", "month"])
    r = r.select(F.lit(None).cast("long").alias("district_id"), "facility_id", "month", F.greatest("received", F.last_day("month")).alias("cutoff"), F.col("element").alias("source_id"), "element", "status", "difference")
    return _shaped(r, "reconciliation", ["element", "status", "difference"], F.col("status") != "matched")


def alert_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock-outs as context, once for the facility and once for its district."""
    a = stock_outs(spark, sf_dir)
    scope = lambda d, p, n: F.struct(d.cast("long").alias("district_id"), p.cast("long").alias("facility_id"), n.cast("long").alias("votes"))
    scopes = F.concat(F.array(scope(F.lit(None), F.col("facility_id"), F.size("districts"))), F.transform("districts", lambda d: scope(d.district_id, F.lit(None), F.lit(1))))
    x = a.select("month", F.last_day("month").alias("cutoff"), "fact", F.concat_ws(":", "facility_id", "commodity").alias("source_id"), F.explode(scopes).alias("s"))
    return _shaped(x.select("s.*", "month", "cutoff", "source_id", "fact"), "commodity_alert", ["source_id", "fact"], None)


def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many findings alert_evidence() has of each scope and month."""
    a, none = stock_outs(spark, sf_dir), F.lit(None).cast("long")
    own = a.groupBy(none.alias("district_id"), "facility_id", "month").agg(F.count("*").alias("n"))
    above = a.groupBy("facility_id", "month", "districts").agg(F.count("*").alias("n"))
    above = above.select(F.explode("districts").alias("d"), "month", "n").groupBy("d.district_id", none.alias("facility_id"), "month").agg(F.sum("n").alias("n"))
    return own.unionByName(above).withColumns({"kind": F.lit("commodity_alert"), "role": F.lit("context"), "cutoff": F.last_day("month")})


VERSION = "3"
TABLES = ("nation", "region", "supplier", "customer", "part", "orders", "lineitem")


def evaluated(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], **parameters: object) -> DataFrame:
    """What build() gives, written once for the tables of sf_dir: every view of signals reads the same evaluation."""
    return stored.evaluation(spark, name, VERSION, [f"{sf_dir}/{t}.parquet" for t in TABLES], build, **parameters)


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What evidence asks of visits, from one pass over their lines; medicines are not among it."""
    return evaluated(spark, sf_dir, "visits", lambda: flags.visits(spark, sf_dir).drop(*flags.MEDICINE, "first_method"))


def stock_outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facility_id, month, commodity, fact, districts (of the facility: one, unless its key comes twice): each finding once."""

    def build() -> DataFrame:
        f = surveillance.commodity_facts(spark, sf_dir).where("fact IN ('days_out_of_stock', 'zero_on_hand')")
        return f.repartition("facility_id", "month").groupBy("facility_id", "month", "commodity", "fact").agg(F.array_sort(F.collect_list(F.struct("district_id"))).alias("districts"))

    return evaluated(spark, sf_dir, "stock_outs", build)


#: All but stock-outs.
JUDGED = (anomaly_evidence, hotspot_evidence, recurrence_evidence, reconciliation_evidence)


def every(spark: SparkSession, sf_dir: str, sources: tuple = (*JUDGED, alert_evidence), once: bool = False) -> DataFrame:
    """Rows of several kinds; with `once`, those of anomalies, the only ones that come twice, are put together."""
    rows = [f(spark, sf_dir) for f in sources]
    rows = [unique(r, "facts") if once and f is anomaly_evidence else r for f, r in zip(sources, rows, strict=True)]
    return functools.reduce(DataFrame.unionByName, rows)


def unique(found: DataFrame, by: str = "fingerprint", runs: tuple[str, ...] = ()) -> DataFrame:
    """Each finding once: its least source, its newest cutoff, and how often it was there."""
    votes = F.sum("votes") if "votes" in found.columns else F.count("*")
    return found.groupBy(*runs, *SCOPE, "kind", by, "role").agg(F.min("source_id").alias("source_id"), F.max("cutoff").alias("cutoff"), votes.alias("votes"))


_EVIDENCE = f"""{flags.CTES}, {surveillance._STOCK},
jx AS (WITH {statistics._SERIES}, {statistics._JUDGED} SELECT district_id, month, outcome FROM j),
hx AS (WITH {statistics._SPACE} SELECT h.district_id, h.month, h.outcome, bool_and(h.outcome = 'hotspot') AND count(o.district_id) > 0 AS clustered FROM hot h LEFT JOIN adj ON src = h.district_id LEFT JOIN hot o ON o.district_id = dst AND o.month = h.month AND o.outcome = 'hotspot' GROUP BY ALL),
{sequences._EP}, {sequences._SUM},
rcn AS (SELECT * FROM ({surveillance.SQL_RECONCILIATION})),
ret AS (SELECT facility_id, month, CAST(max(encounter_date) + INTERVAL 5 DAY AS DATE) AS received FROM encounter GROUP BY 1, 2),
evidence AS (
{_sql_shaped("SELECT district_id, CAST(NULL AS BIGINT) AS facility_id, month, last_day(month) AS cutoff, outcome, source_id FROM jx, (VALUES ('run1'), ('run2')) r(source_id) WHERE outcome IN ('flagged', 'not_flagged')", "temporal_anomaly", ["outcome"], "outcome = 'flagged'")}
UNION ALL {_sql_shaped("SELECT district_id, CAST(NULL AS BIGINT) AS facility_id, month, last_day(month) AS cutoff, outcome, 'run1' AS source_id FROM hx WHERE outcome IN ('hotspot', 'not_hotspot')", "hotspot", ["outcome"], "outcome = 'hotspot'")}
UNION ALL {_sql_shaped("SELECT district_id, CAST(NULL AS BIGINT) AS facility_id, month, last_day(month) AS cutoff, clustered, 'run1' AS source_id FROM hx WHERE outcome IN ('hotspot', 'not_hotspot')", "spatial_cluster", ["clustered"], "clustered")}
UNION ALL {_sql_shaped("SELECT district_id, facility_id, month, last_day(month) AS cutoff, 'run1' AS source_id, count(*) FILTER (positives >= 2) AS repeats, count(*) AS eligible FROM (SELECT index_residence AS district_id, CAST(NULL AS BIGINT) AS facility_id, CAST(date_trunc('month', first_day) AS DATE) AS month, positives FROM es WHERE positives >= 1 UNION ALL SELECT NULL, index_facility, CAST(date_trunc('month', first_day) AS DATE), positives FROM es WHERE positives >= 1) GROUP BY ALL", "recurrence", ["repeats", "eligible"], "repeats > 0")}
UNION ALL {_sql_shaped("SELECT CAST(NULL AS BIGINT) AS district_id, facility_id, month, greatest(received, last_day(month)) AS cutoff, element AS source_id, element, status, difference FROM rcn JOIN ret USING (facility_id, month) WHERE status IN ('matched', 'differs', 'derived_only')", "reconciliation", ["element", "status", "difference"], "status <> 'matched'")}
UNION ALL {_sql_shaped("SELECT CASE WHEN d THEN district_id END AS district_id, CASE WHEN NOT d THEN facility_id END AS facility_id, month, last_day(month) AS cutoff, facility_id || ':' || commodity AS source_id, fact FROM facts, (VALUES (true), (false)) x(d) WHERE fact IN ('days_out_of_stock', 'zero_on_hand')", "commodity_alert", ["source_id", "fact"], None)})"""


@query("signal_evidence", f"WITH {_EVIDENCE} SELECT * FROM evidence")
def signal_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six kinds of evidence under one schema, each supporting, counter or context."""
    rows = every(spark, sf_dir)
    return printed(rows.withColumn("vote", F.explode(F.sequence(F.lit(1), "votes")))).select(*EVIDENCE)


@query("signal_evidence_unique", f"WITH {_EVIDENCE} SELECT kind, fingerprint, role, min(source_id) AS source_id, count(*) AS votes FROM evidence GROUP BY 1, 2, 3")
def signal_evidence_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same finding from two runs is one piece of evidence, that of the smallest source id."""
    return printed(every(spark, sf_dir, once=True)).select("kind", "fingerprint", "role", "source_id", "votes")


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    rows = [(code, kind, weight, type_, least, score) for code, type_, least, score, kinds in rules for kind, weight in kinds.items()]
    return spark.createDataFrame(rows, "rule string, kind string, weight int, signal_type string, least_evidence int, least_score int")


_RULE = "rule(rule, kind, weight, signal_type, least_evidence, least_score) AS (VALUES " + ", ".join(f"('{c}', '{k}', {w}, '{t}', {n}, {s})" for c, t, n, s, kinds in RULES for k, w in kinds.items()) + ")"
_PRIORITY = "CASE " + " ".join(f"WHEN score >= {s} THEN '{p}'" for p, s in reversed(BANDS)) + " ELSE 'unclassified' END"


def signals(found: DataFrame, rules: DataFrame, runs: tuple[str, ...] = ()) -> DataFrame:
    """One row a signal (of a run, where `runs` names the column of runs): KEYS, type, score, counts of evidence, priority, group
    key, fingerprint, cutoff, the kinds that it has and its evidence in order. Context decides nothing and, as it may be
    much, is counted only; what supports a signal or speaks against it is a few findings of each kind."""
    return scored(unique(found, runs=runs).withColumn("n", F.lit(1).cast("long")), rules, runs)


def scored(found: DataFrame, rules: DataFrame, runs: tuple[str, ...] = ()) -> DataFrame:
    """signals() of evidence that holds each finding once; a row of context may stand for n findings."""
    unique = found.join(F.broadcast(rules), "kind")
    role = F.col("role")
    sign = F.when(role == "supporting", 1).when(role == "counter", -1).otherwise(0)
    item = F.when(role != "context", F.struct("kind", "fingerprint", "role", "source_id"))
    s = unique.groupBy(*runs, *KEYS, "signal_type", "least_evidence", "least_score").agg(F.sum(F.col("weight") * sign).alias("score"), F.count_if(role == "supporting").alias("evidence"), F.count_if(role == "counter").alias("counter"), F.sum(F.when(role == "context", F.col("n")).otherwise(0)).alias("context"), F.max("cutoff").alias("cutoff"), F.collect_set("kind").alias("kinds"), F.array_sort(F.collect_list(item)).alias("items"))
    s = s.where("evidence >= least_evidence AND score >= least_score")
    key = F.sha2(F.concat_ws("|", "rule", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in KEYS[1:])), 256)
    own = F.sha2(F.concat(F.col("rule"), F.lit("|"), F.array_join(F.transform("items", lambda x: F.concat_ws(":", x.kind, x.fingerprint, x.role)), ",")), 256)
    return s.withColumns({"priority": F.expr(_PRIORITY), "group_key": key, "input_fingerprint": own})


_SIGNALS = f"""{_EVIDENCE}, {_RULE}, un AS (SELECT rule, district_id, facility_id, month, kind, fingerprint, role, weight, signal_type, least_evidence, least_score, min(source_id) AS source_id, max(cutoff) AS cutoff FROM evidence JOIN rule USING (kind) GROUP BY ALL),
s0 AS (SELECT rule, district_id, facility_id, month, signal_type, least_evidence, least_score, CAST(sum(CASE role WHEN 'supporting' THEN weight WHEN 'counter' THEN -weight ELSE 0 END) AS BIGINT) AS score, count(*) FILTER (role = 'supporting') AS evidence, count(*) FILTER (role = 'counter') AS counter, max(cutoff) AS cutoff,
  string_agg(kind || ':' || fingerprint || ':' || role, ',' ORDER BY kind, fingerprint, role) FILTER (role <> 'context') AS items, string_agg(role || ':' || kind || ':' || source_id, ',' ORDER BY role, kind, source_id, fingerprint) FILTER (role <> 'context') AS told, count(*) FILTER (role = 'context') AS context, list(DISTINCT kind) AS kinds FROM un GROUP BY ALL HAVING evidence >= least_evidence AND score >= least_score),
sig AS (SELECT *, {_PRIORITY} AS priority, sha256(rule || '|' || coalesce(CAST(district_id AS VARCHAR), '-') || '|' || coalesce(CAST(facility_id AS VARCHAR), '-') || '|' || month) AS group_key, sha256(rule || '|' || items) AS input_fingerprint FROM s0)"""


def found_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir, "signals", lambda: scored(scoped(spark, sf_dir), rule_table(spark)), rules=RULES, bands=BANDS)


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that rules take, each finding once and stock-outs counted, dealt by scope and month: rules and their groups then need no
    further exchange, and hashes are made after it."""
    rows = every(spark, sf_dir, JUDGED, once=True).withColumn("n", F.lit(1).cast("long"))
    rows = rows.unionByName(alert_counts(spark, sf_dir), allowMissingColumns=True).repartition(*SCOPE)
    return printed(rows)


@query("signal_scores", f"WITH {_SIGNALS} SELECT rule, district_id, facility_id, month, signal_type, score, evidence, counter, priority, group_key, input_fingerprint FROM sig")
def signal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals that reach their rule's least evidence and score, with the highest priority band."""
    return found_signals(spark, sf_dir).select(*KEYS, "signal_type", "score", "evidence", "counter", "priority", "group_key", "input_fingerprint")


@query("active_signal_counts", f"WITH {_SIGNALS} SELECT district_id, month, count(*) AS active, max(cutoff) AS freshness, 'available' AS status FROM sig WHERE district_id IS NOT NULL GROUP BY ALL UNION ALL SELECT NULL, month, count(*), max(cutoff), 'available' FROM sig GROUP BY ALL")
def active_signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active signals of districts and the nation with the newest evidence of each month."""
    s = found_signals(spark, sf_dir).select("district_id", "month", "cutoff")
    scope = F.explode(F.array_distinct(F.array(F.struct("district_id", F.lit(False).alias("nation")), F.struct(F.lit(None).cast("long").alias("district_id"), F.lit(True).alias("nation")))))
    x = s.select("month", "cutoff", scope.alias("s")).where("s.nation OR s.district_id IS NOT NULL")
    return x.groupBy("s.district_id", "s.nation", "month").agg(F.count("*").alias("active"), F.max("cutoff").alias("freshness")).select("district_id", "month", "active", "freshness", F.lit("available").alias("status"))


def not_configured(spark: SparkSession, missing: list[str]) -> DataFrame:
    """The row that stands for figures where no approved rule exists: null, never zero."""
    return spark.range(1).select(F.lit(None).cast("long").alias("active"), F.lit("not_configured").alias("status"), F.array(*map(F.lit, missing)).alias("missing"))


@query("signal_supersession", f"""WITH {_SIGNALS.replace("FROM evidence JOIN rule USING (kind) GROUP BY ALL)", "FROM evidence JOIN rule USING (kind), (VALUES (1), (2)) t(run) WHERE run = 2 OR kind <> 'recurrence' GROUP BY ALL)").replace("un AS (SELECT rule,", "un AS (SELECT run, rule,").replace("s0 AS (SELECT rule,", "s0 AS (SELECT run, rule,")},
f AS (SELECT group_key, input_fingerprint, min(run) AS run FROM sig GROUP BY 1, 2) SELECT group_key, input_fingerprint, run, lead(input_fingerprint) OVER w AS superseded_by, lag(input_fingerprint) OVER w AS supersedes, CASE WHEN lead(run) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status FROM f WINDOW w AS (PARTITION BY group_key ORDER BY run)""")
def signal_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generation runs, the second with recurrence as well: an equal fingerprint changes nothing, a new one supersedes."""
    runs = F.explode(F.when(F.col("kind") == "recurrence", F.array(F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2))))
    return superseded(scored(scoped(spark, sf_dir).withColumn("run", runs), rule_table(spark), ("run",)))


def superseded(runs: DataFrame) -> DataFrame:
    """group_key, input_fingerprint, run and the links between the signals of a group; one of a group is active."""
    first = runs.groupBy("group_key", "input_fingerprint").agg(F.min("run").alias("run"))
    order = Window.partitionBy("group_key").orderBy("run")
    after = F.lead("input_fingerprint").over(order)
    return first.select("group_key", "input_fingerprint", "run", after.alias("superseded_by"), F.lag("input_fingerprint").over(order).alias("supersedes"), F.when(after.isNull(), "active").otherwise("superseded").alias("status"))


@query("priority_districts", f"""WITH {_SIGNALS}, n AS (SELECT district_id, count(*) AS active_signals FROM sig WHERE district_id IS NOT NULL GROUP BY 1), al AS (SELECT district_id, count(*) AS alerts FROM (SELECT DISTINCT district_id, facility_id, month FROM facts WHERE fact IN ('days_out_of_stock', 'zero_on_hand')) GROUP BY 1)
SELECT district_id, district_name, active_signals, coalesce(alerts, 0) AS commodity_alerts FROM n JOIN district USING (district_id) LEFT JOIN al USING (district_id) ORDER BY active_signals DESC, district_name LIMIT 10""")
def priority_districts(spark: SparkSession, sf_dir: str, limit: int = 10) -> DataFrame:
    """The districts with most active signals, by count, then name; alerts stand beside and decide nothing."""
    n = found_signals(spark, sf_dir).where("district_id IS NOT NULL").groupBy("district_id").agg(F.count("*").alias("active_signals"))
    top = n.join(bind.districts(spark, sf_dir).select("district_id", "district_name"), "district_id").orderBy(F.desc("active_signals"), "district_name").limit(limit)
    found = stock_outs(spark, sf_dir).select("facility_id", "month", "districts").distinct()
    alerts = found.select("facility_id", "month", F.explode("districts").alias("d")).select("facility_id", "month", "d.*").distinct().groupBy("district_id").agg(F.count("*").alias("n"))
    return top.join(alerts, "district_id", "left").select("district_id", "district_name", "active_signals", F.coalesce("n", F.lit(0)).alias("commodity_alerts"))


@query("signals_newest", f"WITH {_SIGNALS} SELECT group_key, rule, priority, score, cutoff FROM sig ORDER BY cutoff DESC, group_key LIMIT 100")
def signals_newest(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    """The newest signals, by the date of their newest evidence."""
    return found_signals(spark, sf_dir).select("group_key", "rule", "priority", "score", "cutoff").orderBy(F.desc("cutoff"), "group_key").limit(limit)


@query("signal_explanations", f"""WITH {_SIGNALS} SELECT group_key, rule || ' (' || replace(signal_type, '_', ' ') || '): ' || evidence || ' findings for, ' || counter || ' against, ' || context || ' as context; score ' || score || ' of the ' || least_score || ' asked for; ' || priority || ' priority' AS why_flagged,
told AS evidence, 'findings ' || evidence || '/' || least_evidence || ', score ' || score || '/' || least_score || ', band ' || priority AS steps, array_to_string(list_sort(list_filter((SELECT list(r.kind) FROM rule r WHERE r.rule = sig.rule), lambda k: NOT list_contains(kinds, k))), ',') AS missing FROM sig""")
def signal_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a signal was raised: a sentence, evidence in order of role, kind and source, what was compared, and kinds without evidence."""
    rules = rule_table(spark).groupBy(F.col("rule").alias("of")).agg(F.array_sort(F.collect_list("kind")).alias("asked"))
    s = found_signals(spark, sf_dir).join(F.broadcast(rules), F.col("rule") == F.col("of"))
    text = lambda *parts: F.concat(*(F.lit(p) if i % 2 else F.col(p) for i, p in enumerate(parts)))
    s = s.withColumn("kind_of", F.translate("signal_type", "_", " "))
    why = text("rule", " (", "kind_of", "): ", "evidence", " findings for, ", "counter", " against, ", "context", " as context; score ", "score", " of the ", "least_score", " asked for; ", "priority", " priority")
    steps = F.concat(F.lit("findings "), text("evidence", "/", "least_evidence", ", score ", "score", "/", "least_score", ", band ", "priority"))
    told = F.array_sort(F.transform("items", lambda x: F.struct(x.role, x.kind, x.source_id, x.fingerprint)))
    return s.select("group_key", why.alias("why_flagged"), F.array_join(F.transform(told, lambda x: F.concat_ws(":", x.role, x.kind, x.source_id)), ",").alias("evidence"), steps.alias("steps"), F.array_join(F.array_except("asked", "kinds"), ",").alias("missing"))


#: Categories of the overview, in their order.
PRIORITIES = ("unclassified", "routine", "elevated", "high", "urgent")
STATUSES = ("new", "triaged", "assigned", "under_investigation", "closed")


def counted(rows: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """place, code and count of ordered categories, zeros included; other values are left out."""
    every = rows.sparkSession.createDataFrame(list(enumerate(order)), "place int, code string")
    return every.join(rows.groupBy(F.col(column).alias("code")).agg(F.count("*").alias("n")), "code", "left").select("place", "code", F.coalesce("n", F.lit(0)).alias("count"))


def _sql_counted(rows: str, column: str, order: tuple[str, ...]) -> str:
    every = ", ".join(f"({i}, '{c}')" for i, c in enumerate(order))
    return f"SELECT place, code, count(x.{column}) AS count FROM (VALUES {every}) e(place, code) LEFT JOIN ({rows}) x ON x.{column} = code GROUP BY 1, 2"


@query("overview_buckets", f"WITH {_SIGNALS} {_sql_counted('SELECT priority FROM sig', 'priority', PRIORITIES)}")
def overview_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by priority, in order, with zeros."""
    return counted(found_signals(spark, sf_dir), "priority", PRIORITIES)


_CASES = """inv AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_orderpriority[1:1] = '1' THEN 'under_investigation' WHEN o_orderpriority[1:1] IN ('2', '3') THEN 'assigned' ELSE 'new' END AS status, o_custkey AS owner, o_orderdate AS opened FROM orders)"""


def investigations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases bound to orders: status from the order's, owner the customer."""
    p = F.substring("o_orderpriority", 1, 1)
    status = F.when(F.col("o_orderstatus") == "F", "closed").when(p == "1", "under_investigation").when(p.isin("2", "3"), "assigned").otherwise("new")
    return bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("opened"))


@query("investigation_status_counts", f"WITH {_CASES} {_sql_counted('SELECT status FROM inv', 'status', STATUSES)}")
def investigation_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Investigations by status, with zeros."""
    return counted(investigations(spark, sf_dir), "status", STATUSES)


@query("needs_attention", f"""WITH {_SIGNALS}, {_CASES} SELECT 'high_priority_signals' AS code, (SELECT count(*) FROM sig WHERE priority IN ('high', 'urgent')) AS count, 'available' AS status UNION ALL SELECT 'open_investigations', (SELECT count(*) FROM inv WHERE status <> 'closed'), 'available'
UNION ALL SELECT 'commodity_alerts', (SELECT count(*) FROM (SELECT DISTINCT facility_id, month FROM facts WHERE fact IN ('days_out_of_stock', 'zero_on_hand'))), 'available' UNION ALL SELECT 'investigations_overdue', NULL, 'not_configured'""")
def needs_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What asks for a decision; the overdue count has no value, as no deadline is approved."""
    row = lambda code, df: df.agg(F.count("*").alias("count")).select(F.lit(code).alias("code"), "count", F.lit("available").alias("status"))
    high = row("high_priority_signals", found_signals(spark, sf_dir).where("priority IN ('high', 'urgent')"))
    late = spark.range(1).select(F.lit("investigations_overdue").alias("code"), F.lit(None).cast("long").alias("count"), F.lit("not_configured").alias("status"))
    return high.union(row("open_investigations", investigations(spark, sf_dir).where("status <> 'closed'"))).union(row("commodity_alerts", stock_outs(spark, sf_dir).select("facility_id", "month").distinct())).union(late)

"""Loading revisions of returns into their series, what both forms derive from visits, investigation queues and brief reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import scalars as fn
from tidewatch.operators import flags, signals
from tidewatch.plans.registry import query
from tidewatch.sources import bind

SERIES = ["facility_id", "form", "starts"]


def loaded(inbound: DataFrame, facilities: DataFrame) -> DataFrame:
    """Inbound returns (id, SERIES, revision, checksum, arrival) with outcome, supersedes and status.

    Of a revision of a series the first arrival is history. The same content again is unchanged; other content under the
    same revision conflicts and is quarantined, as is a facility that is not known. A revision supersedes the highest one
    before it that is stored; however late it comes, the highest of a series is the one that counts.
    """
    r = inbound.join(facilities.select("facility_id", F.lit(True).alias("known")), "facility_id", "left")
    arrivals = Window.partitionBy(*SERIES, "revision").orderBy("arrival", "id")
    first, same = F.row_number().over(arrivals) == 1, F.col("checksum") == F.first("checksum").over(arrivals)
    outcome = F.when(F.col("known").isNull(), "facility_unresolved").when(F.col("revision") < 1, "revision_not_positive").when(first, "loaded").when(same, "unchanged").otherwise("revision_payload_conflict")
    r = r.withColumn("outcome", outcome)
    stored = F.when(F.col("outcome") == "loaded", F.col("revision"))
    whole = Window.partitionBy(*SERIES)
    before = F.max(stored).over(whole.orderBy("revision").rangeBetween(Window.unboundedPreceding, -1))
    mine = F.col("outcome") == "loaded"
    status = F.when(mine, F.when(F.col("revision") == F.max(stored).over(whole), "accepted").otherwise("superseded"))
    return r.select("id", *SERIES, "revision", "outcome", F.when(mine, before).alias("supersedes"), status.alias("status"))


def inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as returns: series by facility code and period, contents by the rounded total, arrival by key."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    weekly = F.col("o_custkey") % 2 == 0
    starts = F.when(weekly, F.date_trunc("week", day).cast("date")).otherwise(F.trunc(day, "month"))
    content = F.concat_ws("|", F.col("o_orderstatus"), F.floor(F.col("o_totalprice") / 250000).cast("string"))
    return bind.table(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") % 13).alias("facility_id"), F.when(weekly, "weekly").otherwise("monthly").alias("form"), starts.alias("starts"), (k % 4).cast("int").alias("revision"), F.sha2(content, 256).alias("checksum"), k.alias("arrival"))


_INBOUND = """ib AS (SELECT o_orderkey AS id, o_custkey % 13 AS facility_id, CASE WHEN o_custkey % 2 = 0 THEN 'weekly' ELSE 'monthly' END AS form, CASE WHEN o_custkey % 2 = 0 THEN CAST(date_trunc('week', o_orderdate) AS DATE) ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS starts, CAST(o_orderkey % 4 AS INTEGER) AS revision, o_orderstatus || '|' || CAST(floor(o_totalprice / 250000) AS BIGINT) AS content FROM orders),
oc AS (SELECT ib.*, CASE WHEN f.facility_id IS NULL THEN 'facility_unresolved' WHEN revision < 1 THEN 'revision_not_positive' WHEN row_number() OVER w = 1 THEN 'loaded' WHEN content = first_value(content) OVER w THEN 'unchanged' ELSE 'revision_payload_conflict' END AS outcome FROM ib LEFT JOIN facility f ON f.facility_id = ib.facility_id AND f.is_active WINDOW w AS (PARTITION BY ib.facility_id, form, starts, revision ORDER BY id)),
st AS (SELECT DISTINCT facility_id, form, starts, revision FROM oc WHERE outcome = 'loaded')"""


@query("submission_loads", f"WITH {bind.CTES}, {_INBOUND} SELECT id, facility_id, form, starts, revision, outcome, CASE WHEN outcome = 'loaded' THEN (SELECT max(s.revision) FROM st s WHERE s.facility_id = oc.facility_id AND s.form = oc.form AND s.starts = oc.starts AND s.revision < oc.revision) END AS supersedes, CASE WHEN outcome = 'loaded' THEN CASE WHEN EXISTS (SELECT 1 FROM st s WHERE s.facility_id = oc.facility_id AND s.form = oc.form AND s.starts = oc.starts AND s.revision > oc.revision) THEN 'superseded' ELSE 'accepted' END END AS status FROM oc")
def submission_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every inbound return."""
    return loaded(inbound(spark, sf_dir), bind.facilities(spark, sf_dir).where("is_active"))


#: Elements of both forms and the visits that each counts.
FORM_RULES = {
    "monthly": (("OA01", "attendance = 'new'"), ("OA02", "attendance = 're'"), ("EP01b", "tested"), ("EP01c", "confirmed")),
    "weekly": (("MA.", "confirmed"), ("M033B_MAT_TESTED_RDT", "rdt"), ("M033B_MAT_RDT_POSITIVE", "rdt_positive"), ("M033B_MAT_TESTED_MICROSCOPY", "microscopy"), ("M033B_MAT_MICROSCOPY_POSITIVE", "microscopy_positive"), ("M033B_APT_OPD_NEW", "attendance = 'new'")),
}
_FORMS = " UNION ALL ".join(f"SELECT '{f}' AS form, facility_id, CAST(date_trunc('{f.removesuffix('ly')}', encounter_date) AS DATE) AS starts, '{e}' AS element, count(*) FILTER ({w}) AS derived FROM visit GROUP BY ALL" for f, rules in FORM_RULES.items() for e, w in rules)


@query("derived_form_totals", f"WITH {flags.CTES} {_FORMS}")
def derived_form_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What visits say about each element of the monthly and the weekly form, all rules of both from one scan of visits."""
    v, day = flags.visits(spark, sf_dir), F.col("encounter_date")
    starts = {"monthly": F.trunc(day, "month"), "weekly": F.date_trunc("week", day).cast("date")}
    every = {e: (f, w) for f, rules in FORM_RULES.items() for e, w in rules}
    x = v.withColumn("f", F.explode(F.array(*(F.struct(F.lit(f).alias("form"), s.alias("starts")) for f, s in starts.items()))))
    c = x.groupBy("f.form", "facility_id", "f.starts").agg(*(F.count_if(F.expr(w)).alias(e.replace(".", "_")) for e, (_, w) in every.items()))
    cells = F.array(*(F.struct(F.lit(f).alias("of"), F.lit(e).alias("element"), F.col(e.replace(".", "_")).alias("derived")) for e, (f, _) in every.items()))
    return c.select("form", "facility_id", "starts", F.explode(cells).alias("c")).where("form = c.of").select("form", "facility_id", "starts", "c.element", "c.derived")


#: The queues in their order; without an approved deadline `overdue` has no members and says so.
QUEUES = ("new", "high_priority", "assigned_to_me", "under_investigation", "awaiting_external_result", "resolved")


def queues(cases: DataFrame, awaiting: DataFrame, me: Column, limit: int = 100) -> DataFrame:
    """queue, place, id, opened: the newest cases (id, status, priority, owner, opened) of each queue, `limit` each."""
    c = cases.join(awaiting.select("id", F.lit(True).alias("asked")).distinct(), "id", "left")
    live, status = F.col("status") != "closed", F.col("status")
    member = {"new": status == "new", "high_priority": live & F.col("priority").isin("high", "urgent"), "assigned_to_me": live & (F.col("owner") == me), "under_investigation": status == "under_investigation", "awaiting_external_result": F.col("asked").isNotNull(), "resolved": ~live}
    x = c.select("id", "opened", F.explode(F.array_compact(F.array(*(F.when(member[q], F.lit(q)) for q in QUEUES)))).alias("queue"))
    place = F.row_number().over(Window.partitionBy("queue").orderBy(F.desc("opened"), "id"))
    return x.withColumn("place", place).where(F.col("place") <= limit).select("queue", "place", "id", "opened")


@query("investigation_queues", f"""WITH {signals._CASES}, c AS (SELECT *, CASE o_orderpriority[1:1] WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' ELSE 'routine' END AS priority FROM inv JOIN orders ON o_orderkey = id), a AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_linenumber = 7 AND l_returnflag = 'N'),
m AS (SELECT 'new' AS queue, id, opened FROM c WHERE status = 'new' UNION ALL SELECT 'high_priority', id, opened FROM c WHERE status <> 'closed' AND priority IN ('high', 'urgent') UNION ALL SELECT 'assigned_to_me', id, opened FROM c WHERE status <> 'closed' AND owner = 7 UNION ALL SELECT 'under_investigation', id, opened FROM c WHERE status = 'under_investigation' UNION ALL SELECT 'awaiting_external_result', id, opened FROM c WHERE id IN (SELECT id FROM a) UNION ALL SELECT 'resolved', id, opened FROM c WHERE status = 'closed')
SELECT queue, CAST(row_number() OVER (PARTITION BY queue ORDER BY opened DESC, id) AS INTEGER) AS place, id, opened FROM m QUALIFY row_number() OVER (PARTITION BY queue ORDER BY opened DESC, id) <= 100""")
def investigation_queues(spark: SparkSession, sf_dir: str, me: int = 7) -> DataFrame:
    """The newest hundred of every queue of investigations."""
    p = F.substring("o_orderpriority", 1, 1)
    o = bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(p == "1", "urgent").when(p == "2", "high").otherwise("routine").alias("priority"))
    awaiting = bind.table(spark, sf_dir, "lineitem").where("l_linenumber = 7 AND l_returnflag = 'N'").select(F.col("l_orderkey").alias("id"))
    return queues(signals.investigations(spark, sf_dir).join(o, "id"), awaiting, F.lit(me))


#: Measures of a brief in their order: code, label, numerator, denominator (none: a count).
MEASURES = (("attendance", "Attendance", "TRUE", None), ("suspected", "Suspected", "suspected", None), ("tested", "Tested", "tested", None), ("confirmed", "Confirmed", "confirmed", None), ("positivity", "=Positivity", "confirmed", "tested"), ("treated", "Confirmed and treated", "confirmed AND antimalarial", "confirmed"))
_MEASURES = " UNION ALL ".join(f"SELECT unit, month, {i} AS place, '{c}' AS code, '{chr(39) * 2 if label.startswith('=') else ''}{label}' AS label, count(*) FILTER ({n}) AS numerator, {f'count(*) FILTER ({d})' if d else 'CAST(NULL AS BIGINT)'} AS denominator FROM rp GROUP BY 1, 2" for i, (c, label, n, d) in enumerate(MEASURES))


@query("brief_reports", f"""WITH {flags.CTES}, rp AS (SELECT visit.*, 'national' AS unit FROM visit UNION ALL SELECT visit.*, district_name FROM visit JOIN facility USING (facility_id) JOIN district USING (district_id)), m AS ({_MEASURES})
SELECT unit, month, place, code, label, numerator, denominator, CASE WHEN code NOT IN ('positivity', 'treated') THEN CAST(numerator AS DOUBLE) WHEN denominator > 0 THEN round_even(CAST(numerator AS DOUBLE) / denominator, 6) END AS value, CASE WHEN code IN ('positivity', 'treated') AND denominator = 0 THEN 'unavailable_no_denominator' ELSE 'available' END AS status FROM m""")
def brief_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National and district briefs of all months: measures in order, absent ones absent, labels safe for spreadsheets."""
    v = flags.visits(spark, sf_dir)
    f = bind.facilities(spark, sf_dir).join(bind.districts(spark, sf_dir), "district_id").select("facility_id", "district_name")
    counts = {x for _, _, n, d in MEASURES for x in (n, d) if x}
    name = {x: f"c{i}" for i, x in enumerate(sorted(counts))}
    # Counts of facilities first: briefs of districts and of the nation are sums of them.
    c = v.groupBy("facility_id", "month").agg(*(F.count_if(F.expr(x)).alias(a) for x, a in name.items()))
    u = c.join(f, "facility_id", "left").select("month", *name.values(), F.explode(F.array_compact(F.array(F.lit("national"), F.col("district_name")))).alias("unit"))
    g = u.groupBy("unit", "month").agg(*(F.sum(a).alias(a) for a in name.values()))
    cell = lambda i, code, label, n, d: F.struct(F.lit(i).alias("place"), F.lit(code).alias("code"), fn.csv_safe(F.lit(label)).alias("label"), F.col(name[n]).alias("numerator"), (F.col(name[d]) if d else F.lit(None).cast("long")).alias("denominator"), F.lit(d is not None).alias("ratio"))
    r = g.select("unit", "month", F.explode(F.array(*(cell(i, *m) for i, m in enumerate(MEASURES)))).alias("m")).select("unit", "month", "m.*")
    share = F.bround(F.col("numerator").cast("double") / F.nullif(F.col("denominator"), F.lit(0)), 6)
    return r.select("unit", "month", "place", "code", "label", "numerator", "denominator", F.when(~F.col("ratio"), F.col("numerator").cast("double")).otherwise(share).alias("value"), F.when(F.col("ratio") & (F.col("denominator") == 0), "unavailable_no_denominator").otherwise("available").alias("status"))

"""Stored evidence of reporting years, its coverage, and what follows for each encounter and patient.

Every year is a reporting period, with a lookback of the rule's window before it; all years are evaluated together, so an
encounter belongs to one year or two. Evidence of a year is what the patients with a positive in it have had since its
lookback began. Each facility's import windows are stitched; where they leave a gap, an absent chain proves nothing.

An encounter is dated by its positive tests, the earliest of them; if they disagree, or some lack a day, its date is
disputed. No patient makes a group of its own: patients' positive days are arrays, searched in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import intervals, sequences, stored
from tidewatch.plans.registry import query
from tidewatch.sources import bind

RULE = sequences.ChainRule(gap=14, window=120, least=2)
#: Methods whose positives count, and flags that keep an encounter from counting.
METHODS, EXCLUDED = ("rdt",), ("date_quality_issue",)


def tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encounter_id, method, outcome (positive, negative, unmapped: not resolved), shift: days after the visit, null if not dated."""
    l = bind.table(spark, sf_dir, "lineitem").where("NOT (l_returnflag = 'N' AND l_linestatus = 'O')")
    outcome = F.when(F.col("l_returnflag") == "R", "positive").when(F.col("l_returnflag") == "A", "negative").otherwise("unmapped")
    method = F.when(F.col("l_linestatus") == "F", "rdt").otherwise("microscopy")
    shift = F.when(F.col("l_tax") != 0, F.when(F.col("l_linenumber") == 3, 1).otherwise(0))
    return l.select(F.col("l_orderkey").alias("encounter_id"), method.alias("method"), outcome.alias("outcome"), shift.alias("shift"))


def encounters(spark: SparkSession, sf_dir: str, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """Encounters with the day of their evidence, whether it is disputed, and what their tests say."""
    t, one = tests(spark, sf_dir), F.col("outcome") == "positive"
    own = one & F.col("method").isin(*methods)
    shift = F.when(own, F.col("shift"))
    a = t.groupBy("encounter_id").agg(F.count_if(own).alias("positives"), F.count(shift).alias("dated"), F.min(shift).alias("first"), F.max(shift).alias("last"), F.bool_or(one).alias("any_positive"), F.bool_or(F.col("outcome") == "unmapped").alias("unresolved"))
    e = bind.encounters(spark, sf_dir).join(a, "encounter_id", "left")
    n = F.coalesce("positives", F.lit(0))
    day = F.when(n == 0, F.col("encounter_date")).when(F.col("dated") > 0, F.date_add("encounter_date", F.col("first")))
    disputed = (n > 0) & (F.col("dated") > 0) & ((F.col("last") > F.col("first")) | (F.col("dated") < n))
    return e.select("encounter_id", F.when(F.col("encounter_id") % 97 != 0, F.col("patient_id")).alias("patient_id"), "facility_id", "encounter_date", day.alias("day"), F.coalesce(disputed, F.lit(False)).alias("disputed"), (n > 0).alias("positive"), F.coalesce("any_positive", F.lit(False)).alias("any_positive"), F.coalesce("unresolved", F.lit(False)).alias("unresolved"))


_ENC = f"""et AS (SELECT l_orderkey AS encounter_id, count(*) FILTER (own) AS positives, count(sh) FILTER (own) AS dated, min(sh) FILTER (own) AS first, max(sh) FILTER (own) AS last, bool_or(l_returnflag = 'R') AS any_positive, bool_or(l_returnflag = 'N') AS unresolved
  FROM (SELECT *, l_returnflag = 'R' AND l_linestatus = 'F' AS own, CASE WHEN l_tax <> 0 THEN CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END END AS sh FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_linestatus = 'O')) GROUP BY 1),
en AS MATERIALIZED (SELECT encounter_id, CASE WHEN encounter_id % 97 <> 0 THEN patient_id END AS patient_id, facility_id, encounter_date, CASE WHEN coalesce(positives, 0) = 0 THEN encounter_date WHEN dated > 0 THEN encounter_date + CAST(first AS INTEGER) END AS day,
  coalesce(positives > 0 AND dated > 0 AND (last > first OR dated < positives), false) AS disputed, coalesce(positives, 0) > 0 AS positive, coalesce(any_positive, false) AS any_positive, coalesce(unresolved, false) AS unresolved FROM encounter LEFT JOIN et USING (encounter_id))"""


def _years(day: Column, window: int = RULE.window) -> Column:
    """The years whose span, lookback included, holds a day."""
    return F.explode(F.array_distinct(F.array(F.year(day), F.year(F.date_add(day, window)))))


def span(year: Column, window: int = RULE.window) -> tuple[Column, Column, Column]:
    start = F.make_date(year, F.lit(1), F.lit(1))
    return F.date_sub(start, window), start, F.make_date(year, F.lit(12), F.lit(31))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facility_id, starts, ends of completed imports: a facility's months, without those whose import failed."""
    e = bind.encounters(spark, sf_dir).select("facility_id", "month").distinct()
    failed = (F.col("facility_id") + F.year("month") * 12 + F.month("month")) % 211 == 0
    return e.where(~failed).select("facility_id", F.col("month").alias("starts"), F.last_day("month").alias("ends"))


_WIN = "wi AS (SELECT DISTINCT facility_id, month AS starts, last_day(month) AS ends FROM encounter WHERE (facility_id + extract(year FROM month) * 12 + extract(month FROM month)) % 211 <> 0)"


def stored_evidence(spark: SparkSession, sf_dir: str, years: tuple[int, ...] = ()) -> DataFrame:
    """year and encounters: of patients with a positive test in the year, by their visits' dates, all since its lookback began. For
    some years only, the scan of encounters is pruned to their spans."""
    e = encounters(spark, sf_dir)
    # Evidence and those whom it is about are two readings of encounters.
    e = e if years else stored.written(e, "encounters")
    if years:
        first, last = min(years), max(years)
        e = e.where(F.col("encounter_date").between(F.date_sub(F.lit(f"{first}-01-01").cast("date"), RULE.window), F.lit(f"{last}-12-31").cast("date")))
    e = e.where("patient_id IS NOT NULL")
    asked = e.where("any_positive").select(F.year("encounter_date").alias("year"), "patient_id").distinct()
    asked = asked.where(F.col("year").isin(*years)) if years else asked
    return e.select(_years(F.col("encounter_date")).alias("year"), "*").join(asked, ["year", "patient_id"], "left_semi")


_EVID = f"""yr AS (SELECT DISTINCT encounter_id, unnest([CAST(extract(year FROM encounter_date) AS INTEGER), CAST(extract(year FROM encounter_date + {RULE.window}) AS INTEGER)]) AS year FROM en),
evd AS MATERIALIZED (SELECT yr.year, en.* FROM en JOIN yr USING (encounter_id) WHERE (yr.year, patient_id) IN (SELECT CAST(extract(year FROM encounter_date) AS INTEGER), patient_id FROM en WHERE any_positive AND patient_id IS NOT NULL))"""


@query("stored_evidence", f"WITH {bind.CTES}, {_ENC}, {_EVID}, {_WIN} SELECT year, encounter_id, evd.patient_id, evd.facility_id, day, disputed, max(w.starts) AS import_window, coalesce(max(w.ends) >= evd.encounter_date, false) AS covered, CASE WHEN is_active THEN 'F' || evd.facility_id ELSE 'D' || district_id END AS area FROM evd JOIN facility f ON f.facility_id = evd.facility_id LEFT JOIN wi w ON w.facility_id = evd.facility_id AND w.starts <= evd.encounter_date GROUP BY year, encounter_id, evd.patient_id, evd.facility_id, day, disputed, evd.encounter_date, is_active, district_id")
def stored_evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every year with the import window in force at each visit, and the area of its facility: the subcounty that is
    its own, else the district."""
    w = windows(spark, sf_dir).withColumn("import_window", F.struct("starts", "ends")).select("facility_id", "starts", "import_window")
    e = intervals.in_force(stored_evidence(spark, sf_dir), w, "facility_id", "encounter_date", "import_window")
    f = bind.facilities(spark, sf_dir).select("facility_id", F.when(F.col("is_active"), F.concat(F.lit("F"), "facility_id")).otherwise(F.concat(F.lit("D"), "district_id")).alias("area"))
    covered = F.coalesce(F.col("import_window.ends") >= F.col("encounter_date"), F.lit(False))
    return e.join(f, "facility_id").select("year", "encounter_id", "patient_id", "facility_id", "day", "disputed", F.col("import_window.starts").alias("import_window"), covered.alias("covered"), "area")


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, facility_id, earliest, latest, gap: the stitched windows of every facility whose evidence a year asks for, within the
    year's span. Windows that follow each other without a day between them join."""
    asked = bind.encounters(spark, sf_dir).select(_years(F.col("encounter_date")).alias("year"), "facility_id").distinct()
    low, _, high = span(F.col("year"))
    asked = asked.withColumns({"starts": low, "ends": high})
    m = intervals.overlapping(asked, windows(spark, sf_dir), ["facility_id"])
    before = F.max("b_ends").over(Window.partitionBy("year", "facility_id").orderBy("b_starts", "b_ends").rowsBetween(Window.unboundedPreceding, -1))
    gap = F.coalesce(F.col("b_starts") > F.date_add(before, 1), F.lit(False))
    c = m.withColumn("gap", gap).groupBy("year", "facility_id").agg(F.min("b_starts").alias("earliest"), F.max("b_ends").alias("latest"), F.count_if("gap").alias("gaps"))
    return asked.join(c, ["year", "facility_id"], "left").select("year", "facility_id", "starts", "ends", "earliest", "latest", F.coalesce("gaps", F.lit(0)).alias("gaps"))


_COV = f"""ask AS (SELECT DISTINCT facility_id, unnest([CAST(extract(year FROM encounter_date) AS INTEGER), CAST(extract(year FROM encounter_date + {RULE.window}) AS INTEGER)]) AS year FROM encounter),
sp AS (SELECT *, make_date(year, 1, 1) - {RULE.window} AS starts, make_date(year, 12, 31) AS ends FROM ask),
st AS (SELECT sp.year, sp.facility_id, w.starts AS b, w.ends AS e, max(w.ends) OVER (PARTITION BY sp.year, sp.facility_id ORDER BY w.starts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sp JOIN wi w ON w.facility_id = sp.facility_id AND w.starts <= sp.ends AND w.ends >= sp.starts),
cov AS MATERIALIZED (SELECT sp.year, sp.facility_id, sp.starts, sp.ends, min(b) AS earliest, max(e) AS latest, count(*) FILTER (before IS NOT NULL AND b > before + 1) AS gaps FROM sp LEFT JOIN st USING (year, facility_id) GROUP BY ALL)"""


@query("evidence_coverage", f"WITH {bind.CTES}, {_WIN}, {_COV} SELECT year, facility_id, earliest, latest, gaps, CASE WHEN earliest IS NULL THEN 'missing' WHEN gaps > 0 THEN 'gaps' WHEN earliest > starts THEN 'late_start' WHEN latest < ends THEN 'early_end' ELSE 'complete' END AS status FROM cov")
def evidence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far imports cover what each year asks of each facility."""
    status = F.when(F.col("earliest").isNull(), "missing").when(F.col("gaps") > 0, "gaps").when(F.col("earliest") > F.col("starts"), "late_start").when(F.col("latest") < F.col("ends"), "early_end").otherwise("complete")
    return coverage(spark, sf_dir).select("year", "facility_id", "earliest", "latest", "gaps", status.alias("status"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored evidence with what becomes of each encounter: reason, and whether it counts. ref: E1, E2, ... by day within patient and year."""
    return judged(stored_evidence(spark, sf_dir))


def judged(e: DataFrame) -> DataFrame:
    """decided() of evidence. Everything asks for one order, by day and encounter within year and patient, so that a task sorts its
    rows once."""
    order = Window.partitionBy("year", "patient_id").orderBy(F.col("day").asc_nulls_last(), "encounter_id")
    # Rows of one day are peers by the day alone, which the order above gives too.
    same = Window.partitionBy("year", "patient_id").orderBy(F.col("day").asc_nulls_last()).rangeBetween(Window.currentRow, Window.currentRow)
    dated = F.col("positive") & F.col("day").isNotNull()
    flag = {"possible_duplicate": dated & (F.count_if(dated).over(same) > 1), "date_quality_issue": F.col("disputed")}
    e = e.withColumn("ref", F.concat(F.lit("E"), F.row_number().over(order))).withColumns({f"is_{k}": v for k, v in flag.items()})
    bad = F.lit(False)
    for k in EXCLUDED:
        bad = bad | F.col(f"is_{k}")
    fits = F.col("positive") & F.col("day").isNotNull() & ~bad
    e = e.withColumn("place", F.count_if(fits).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    later = fits & (F.col("place") > F.min(F.when(fits, F.col("place"))).over(same))
    reason = F.when(~F.col("positive") & F.col("any_positive"), "positive_method_not_permitted").when(~F.col("positive"), "context_not_positive").when(F.col("day").isNull(), "excluded_unusable_date").when(bad, "excluded_by_quality_rule").when(later, "same_day_not_representative").otherwise("eligible_positive")
    return e.withColumn("reason", reason).drop("place").withColumn("counted", F.col("reason") == "eligible_positive")


_DEC = f"""dc AS MATERIALIZED (SELECT *, positive AND day IS NOT NULL AND count(*) OVER (PARTITION BY year, patient_id, day, positive AND day IS NOT NULL) > 1 AS twin, CASE WHEN NOT positive AND any_positive THEN 'positive_method_not_permitted' WHEN NOT positive THEN 'context_not_positive' WHEN day IS NULL THEN 'excluded_unusable_date' WHEN disputed THEN 'excluded_by_quality_rule'
  WHEN row_number() OVER (PARTITION BY year, patient_id, day, positive AND day IS NOT NULL AND NOT disputed ORDER BY encounter_id) > 1 THEN 'same_day_not_representative' ELSE 'eligible_positive' END AS reason FROM evd)"""


VERSION = "2"
TABLES = ("nation", "region", "supplier", "customer", "orders", "lineitem")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """decided(), written once for its tables; all views of an evaluation read it."""
    return stored.evaluation(spark, "decisions", VERSION, [f"{sf_dir}/{t}.parquet" for t in TABLES], lambda: decided(spark, sf_dir), rule=RULE, methods=METHODS, excluded=EXCLUDED)


@query("encounter_decisions", f"WITH {bind.CTES}, {_ENC}, {_EVID}, {_DEC} SELECT year, patient_id, encounter_id, day, reason, concat_ws(',', CASE WHEN disputed OR (positive AND day IS NULL) THEN 'date_quality_issue' END, CASE WHEN twin THEN 'possible_duplicate' END) AS flags FROM dc")
def encounter_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each encounter of the evidence counts or not, with its flags."""
    flags = F.concat_ws(",", F.when(F.col("disputed") | (F.col("positive") & F.col("day").isNull()), "date_quality_issue"), F.when(F.col("is_possible_duplicate"), "possible_duplicate"))
    return decisions(spark, sf_dir).select("year", "patient_id", "encounter_id", "day", "reason", flags.alias("flags"))


def determined(spark: SparkSession, sf_dir: str, rule: sequences.ChainRule = RULE) -> DataFrame:
    """year, patient_id, in_period, chain (days), unreliable: codes of why an absent chain proves nothing."""
    low, start, end = span(F.col("year"))
    d = decisions(spark, sf_dir).withColumns({"low": low, "start": start, "end": end})
    counted = F.col("counted") & F.col("day").between(F.col("low"), F.col("end"))
    inside = counted & (F.col("day") >= F.col("start"))
    open_test = F.col("unresolved") & (F.col("day").isNull() | F.col("day").between(F.col("low"), F.col("end")))
    p = d.groupBy("year", "patient_id").agg(F.array_sort(F.collect_set(F.when(counted, F.unix_date("day").cast("long")))).alias("days"), F.count_if(inside).alias("in_period"), F.min(F.when(inside, F.col("day"))).alias("first_inside"), F.bool_or(open_test).alias("unresolved"))
    # Coverage of the facilities that a patient's evidence comes from; a patient has few of them.
    c = d.select("year", "patient_id", "facility_id").distinct().join(coverage(spark, sf_dir), ["year", "facility_id"])
    c = c.groupBy("year", "patient_id").agg(F.bool_or(F.col("gaps") > 0).alias("incomplete"), F.bool_or(F.col("earliest").isNull()).alias("missing"), F.min("latest").alias("latest"), F.max("earliest").alias("earliest"), F.max("ends").alias("ends"))
    p = p.join(c, ["year", "patient_id"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            starts = (pd.to_datetime(pdf["year"].astype(str) + "-01-01") - pd.Timestamp("1970-01-01")).dt.days
            yield pdf.assign(chain=[sequences.best_chain(list(n), rule, s) for n, s in zip(pdf["days"], starts, strict=True)]).drop(columns="days")

    p = p.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in p.dtypes if n != "days") + ", chain array<bigint>")
    unseen = F.date_sub("first_inside", rule.window) < F.col("earliest")
    codes = F.concat_ws(",", F.when(F.col("incomplete"), "incomplete_coverage"), F.when(F.col("latest") < F.col("ends"), "early_end"), F.when(F.col("missing"), "missing_facilities"), F.when(unseen, "window_unobserved"), F.when(F.col("unresolved"), "unresolved_tests"))
    return p.select("year", "patient_id", "in_period", "chain", codes.alias("unreliable"))


_CHAIN = f"""dy AS (SELECT DISTINCT year, patient_id, date_diff('day', DATE '1970-01-01', day) AS n FROM dc WHERE reason = 'eligible_positive' AND day BETWEEN make_date(year, 1, 1) - {RULE.window} AND make_date(year, 12, 31)),
cc AS (SELECT year, patient_id, [n] AS c, n AS first, n AS last FROM dy UNION ALL SELECT cc.year, cc.patient_id, list_append(c, d.n), first, d.n FROM cc JOIN dy d ON d.year = cc.year AND d.patient_id = cc.patient_id AND d.n - cc.last >= {RULE.gap} AND d.n - cc.first <= {RULE.window}),
bc AS (SELECT year, patient_id, c FROM cc WHERE len(c) >= {RULE.least} AND last >= date_diff('day', DATE '1970-01-01', make_date(year, 1, 1)) QUALIFY row_number() OVER (PARTITION BY year, patient_id ORDER BY len(c) DESC, last, first, list_reverse(c) DESC) = 1),
pt AS (SELECT year, patient_id, count(*) FILTER (inside) AS in_period, min(day) FILTER (inside) AS first_inside, bool_or(unresolved AND (day IS NULL OR day BETWEEN lo AND hi)) AS open_test FROM (SELECT *, make_date(year, 1, 1) - {RULE.window} AS lo, make_date(year, 12, 31) AS hi, coalesce(reason = 'eligible_positive' AND day BETWEEN make_date(year, 1, 1) AND make_date(year, 12, 31), false) AS inside FROM dc) GROUP BY 1, 2),
pc AS (SELECT year, patient_id, bool_or(gaps > 0) AS incomplete, bool_or(earliest IS NULL) AS missing, min(latest) AS latest, max(earliest) AS earliest, max(ends) AS ends FROM (SELECT DISTINCT year, patient_id, facility_id FROM dc) JOIN cov USING (year, facility_id) GROUP BY 1, 2),
dt AS (SELECT year, patient_id, in_period, coalesce(c, []) AS chain, concat_ws(',', CASE WHEN incomplete THEN 'incomplete_coverage' END, CASE WHEN latest < ends THEN 'early_end' END, CASE WHEN missing THEN 'missing_facilities' END, CASE WHEN first_inside - {RULE.window} < earliest THEN 'window_unobserved' END, CASE WHEN open_test THEN 'unresolved_tests' END) AS unreliable
  FROM pt JOIN pc USING (year, patient_id) LEFT JOIN bc USING (year, patient_id))"""
_HOW = "CASE WHEN in_period = 0 THEN 'not_in_period' WHEN len(chain) > 0 THEN 'qualifies' WHEN unreliable <> '' THEN 'indeterminate' ELSE 'does_not_qualify' END"


def determination() -> Column:
    return F.when(F.col("in_period") == 0, "not_in_period").when(F.size("chain") > 0, "qualifies").when(F.col("unreliable") != "", "indeterminate").otherwise("does_not_qualify")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """determined() with the determination, written once for its tables."""
    build = lambda: determined(spark, sf_dir).withColumn("determination", determination())
    return stored.evaluation(spark, "determinations", VERSION, [f"{sf_dir}/{t}.parquet" for t in TABLES], build, rule=RULE, methods=METHODS, excluded=EXCLUDED)


@query("yearly_determinations", f"WITH RECURSIVE {bind.CTES}, {_ENC}, {_EVID}, {_DEC}, {_WIN}, {_COV}, {_CHAIN} SELECT year, patient_id, {_HOW} AS determination, in_period, array_to_string(chain, ',') AS chain, CASE WHEN {_HOW} = 'indeterminate' THEN unreliable ELSE '' END AS reasons FROM dt")
def yearly_determinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every patient and year: not in the period, qualifies by a chain, does not qualify, or indeterminate, with what was not
    observed or not resolved."""
    d = findings(spark, sf_dir)
    return d.select("year", "patient_id", "determination", "in_period", F.array_join(F.transform("chain", lambda x: x.cast("string")), ",").alias("chain"), F.when(F.col("determination") == "indeterminate", F.col("unreliable")).otherwise("").alias("reasons"))


@query("unlinked_positives", f"WITH {bind.CTES}, {_ENC} SELECT encounter_id, facility_id, day FROM en WHERE patient_id IS NULL AND positive")
def unlinked_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive encounters that belong to no known patient: no chain can hold them."""
    return encounters(spark, sf_dir).where("patient_id IS NULL AND positive").select("encounter_id", "facility_id", "day")


# Views of the evaluation

_REF = "rf AS (SELECT *, 'E' || row_number() OVER (PARTITION BY year, patient_id ORDER BY day NULLS LAST, encounter_id) AS ref FROM dc), fi AS (SELECT *, " + _HOW + " AS determination FROM dt)"
_ALL = f"{bind.CTES}, {_ENC}, {_EVID}, {_DEC}, {_WIN}, {_COV}, {_CHAIN}, {_REF}"
_ON = "date_diff('day', DATE '1970-01-01', day)"


@query("finding_encounters", f"WITH RECURSIVE {_ALL} SELECT year, patient_id, determination, ref, encounter_id, reason, coalesce(reason = 'eligible_positive' AND list_contains(chain, {_ON}), false) AS in_chain FROM rf JOIN fi USING (year, patient_id)")
def finding_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding's encounters under its own references, with those that make its chain."""
    d = decisions(spark, sf_dir).join(findings(spark, sf_dir).select("year", "patient_id", "determination", "chain"), ["year", "patient_id"])
    inside = F.coalesce(F.col("counted") & F.array_contains("chain", F.unix_date("day").cast("long")), F.lit(False))
    return d.select("year", "patient_id", "determination", "ref", "encounter_id", "reason", inside.alias("in_chain"))


@query("patient_rows", f"""WITH RECURSIVE {_ALL}, iv AS (SELECT year, patient_id, n - lag(n) OVER (PARTITION BY year, patient_id ORDER BY n) AS days, n FROM (SELECT DISTINCT year, patient_id, {_ON} AS n FROM dc WHERE reason = 'eligible_positive')),
ag AS (SELECT year, patient_id, count(*) AS encounters, count(*) FILTER (reason = 'eligible_positive') AS positives, max(day) FILTER (reason = 'eligible_positive') AS latest, count(DISTINCT facility_id) FILTER (reason = 'eligible_positive') AS facilities, bool_or(unresolved) AS unresolved FROM dc GROUP BY 1, 2)
SELECT year, patient_id, determination, encounters, positives, latest, facilities, unresolved, coalesce((SELECT string_agg(days, ',' ORDER BY n) FROM iv WHERE iv.year = fi.year AND iv.patient_id = fi.patient_id AND days IS NOT NULL), '') AS intervals, CASE WHEN len(chain) > 0 THEN chain[-1] - chain[1] END AS chain_days FROM fi JOIN ag USING (year, patient_id)""")
def patient_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a patient and year: counts, the days between counted positives, and the span of the chain."""
    d, own = decisions(spark, sf_dir), F.col("counted")
    n = F.unix_date("day").cast("long")
    a = d.groupBy("year", "patient_id").agg(F.count("*").alias("encounters"), F.count_if(own).alias("positives"), F.max(F.when(own, F.col("day"))).alias("latest"), F.count_distinct(F.when(own, F.col("facility_id"))).alias("facilities"), F.bool_or("unresolved").alias("unresolved"), F.array_sort(F.collect_set(F.when(own, n))).alias("days"))
    days = F.col("days")
    gaps = F.transform(F.slice(days, 2, F.greatest(F.size(days) - 1, F.lit(0))), lambda x, i: (x - F.get(days, i)).cast("string"))
    f = findings(spark, sf_dir).select("year", "patient_id", "determination", F.when(F.size("chain") > 0, F.element_at("chain", -1) - F.element_at("chain", 1)).alias("chain_days"))
    return f.join(a, ["year", "patient_id"]).select("year", "patient_id", "determination", "encounters", "positives", "latest", "facilities", "unresolved", F.array_join(gaps, ",").alias("intervals"), "chain_days")


@query("recurrence_by_area", f"""WITH RECURSIVE {_ALL}, ar AS (SELECT facility_id, CASE WHEN is_active THEN 'F' || facility_id ELSE 'D' || district_id END AS area FROM facility),
q AS (SELECT fi.year, area, count(*) AS qualifying FROM fi JOIN dc ON dc.year = fi.year AND dc.patient_id = fi.patient_id AND reason = 'eligible_positive' AND {_ON} = chain[-1] JOIN ar USING (facility_id) WHERE len(chain) > 0 GROUP BY 1, 2),
p AS (SELECT year, area, count(DISTINCT patient_id) AS positive FROM dc JOIN ar USING (facility_id) WHERE reason = 'eligible_positive' AND day BETWEEN make_date(year, 1, 1) AND make_date(year, 12, 31) GROUP BY 1, 2)
SELECT year, area, coalesce(qualifying, 0) AS qualifying, coalesce(positive, 0) AS positive FROM q FULL JOIN p USING (year, area)""")
def recurrence_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualifying patients by the area of their chain's last encounter, beside the patients with a positive there in the year."""
    f = bind.facilities(spark, sf_dir).select("facility_id", F.when(F.col("is_active"), F.concat(F.lit("F"), "facility_id")).otherwise(F.concat(F.lit("D"), "district_id")).alias("area"))
    d = decisions(spark, sf_dir).where("counted").join(f, "facility_id").withColumn("n", F.unix_date("day").cast("long"))
    last = findings(spark, sf_dir).where("size(chain) > 0").select("year", "patient_id", F.element_at("chain", -1).alias("n"))
    q = d.join(last, ["year", "patient_id", "n"]).groupBy("year", "area").agg(F.count("*").alias("qualifying"))
    p = d.where(F.year("day") == F.col("year")).groupBy("year", "area").agg(F.count_distinct("patient_id").alias("positive"))
    return q.join(p, ["year", "area"], "full").select("year", "area", F.coalesce("qualifying", F.lit(0)).alias("qualifying"), F.coalesce("positive", F.lit(0)).alias("positive"))


@query("same_day_evidence", f"WITH {bind.CTES}, {_ENC}, {_EVID}, {_DEC} SELECT year, patient_id, day, count(*) AS members, count(DISTINCT facility_id) AS facilities, min(encounter_id) AS representative, CASE WHEN count(DISTINCT facility_id) = 1 THEN 'near_duplicate' ELSE 'same_day_distinct' END AS kind FROM dc WHERE twin GROUP BY 1, 2, 3")
def same_day_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of positive encounters of one patient and day: all of one facility, or of several."""
    g = decisions(spark, sf_dir).where("is_possible_duplicate").groupBy("year", "patient_id", "day").agg(F.count("*").alias("members"), F.count_distinct("facility_id").alias("facilities"), F.min("encounter_id").alias("representative"))
    return g.withColumn("kind", F.when(F.col("facilities") == 1, "near_duplicate").otherwise("same_day_distinct"))


@query("recurrence_runs", f"WITH RECURSIVE {_ALL}, e AS (SELECT year, count(*) AS encounters, CAST(sum(CAST('0x' || substr(sha256(encounter_id || '|' || reason), 1, 8) AS BIGINT)) AS BIGINT) AS evidence FROM dc GROUP BY 1) SELECT year, 'gap={RULE.gap},window={RULE.window},least={RULE.least},methods={'+'.join(METHODS)}' AS definition, encounters, evidence, count(*) AS patients, count(*) FILTER (determination = 'qualifies') AS qualifying, count(*) FILTER (determination = 'indeterminate') AS indeterminate, count(*) FILTER (in_period > 0) AS eligible FROM fi JOIN e USING (year) GROUP BY ALL")
def recurrence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation of each year as a run: its definition, a checksum of the evidence that it judged, and its totals."""
    d, how = decisions(spark, sf_dir), F.col("determination")
    part = F.conv(F.substring(F.sha2(F.concat_ws("|", "encounter_id", "reason"), 256), 1, 8), 16, 10).cast("long")
    e = d.groupBy("year").agg(F.count("*").alias("encounters"), F.sum(part).alias("evidence"))
    f = findings(spark, sf_dir).groupBy("year").agg(F.count("*").alias("patients"), F.count_if(how == "qualifies").alias("qualifying"), F.count_if(how == "indeterminate").alias("indeterminate"), F.count_if(F.col("in_period") > 0).alias("eligible"))
    definition = f"gap={RULE.gap},window={RULE.window},least={RULE.least},methods={'+'.join(METHODS)}"
    return e.join(f, "year").withColumn("definition", F.lit(definition))

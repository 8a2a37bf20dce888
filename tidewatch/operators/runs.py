"""Recurrence runs and governed methods: transitions with treatment, determinations, comparisons, pages, versions in force."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import flags, sequences
from tidewatch.operators.sequences import CHAIN, PERIOD
from tidewatch.plans.registry import query
from tidewatch.sources import bind

_EV = f"{bind.CTES}, {sequences._POS}, {sequences._CH}"
#: The event types that stand for medicines, from the strongest evidence on.
MEDICINES = (("purchase", "dispensed"), ("signup", "prescribed"), ("view", "recorded"))
_MED = ", ".join(f"'{m}'" for m, _ in MEDICINES)
_CLASS = "CASE " + " ".join(f"WHEN list_contains(meds, '{m}') THEN '{c}'" for m, c in MEDICINES) + " WHEN patient_id % 7 = 0 THEN 'not_available' ELSE 'not_linked' END"
_STEPS = f"""med AS (SELECT patient_id, date_diff('day', DATE '1970-01-01', day) AS n, list(DISTINCT event_type ORDER BY event_type) AS meds FROM event WHERE event_type IN ({_MED}) GROUP BY ALL),
st0 AS (SELECT patient_id, i AS step, c[i] AS a, c[i + 1] AS b, c[1] AS first FROM ev, range(1, 40) t(i) WHERE i < len(c)), st AS (SELECT st0.*, coalesce(meds, []) AS meds FROM st0 LEFT JOIN med ON med.patient_id = st0.patient_id AND med.n = a),
tr AS (SELECT patient_id, step, b - a AS days, b - first AS since_first, array_to_string(meds, ' + ') AS medicines, {_CLASS} AS evidence FROM st)"""


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each pair of neighbours in a patient's chain, with what was recorded on the earlier day."""
    c = sequences.chains(spark, sf_dir).where("size(chain) > 1")
    pair = lambda i: F.struct((i + 1).cast("long").alias("step"), F.col("chain")[i].alias("a"), F.col("chain")[i + 1].alias("b"))
    s = c.select("patient_id", F.col("chain")[0].alias("first"), F.explode(F.transform(F.sequence(F.lit(0), F.size("chain") - 2), pair)).alias("s")).select("patient_id", "first", "s.*")
    e = bind.events(spark, sf_dir).where(F.col("event_type").isin(*(m for m, _ in MEDICINES)))
    med = e.groupBy("patient_id", F.unix_date("day").cast("long").alias("a")).agg(F.array_sort(F.collect_set("event_type")).alias("meds"))
    s = s.join(med, ["patient_id", "a"], "left").withColumn("meds", F.coalesce("meds", F.array().cast("array<string>")))
    kind = F.when(F.lit(False), "")
    for m, name in MEDICINES:
        kind = kind.when(F.array_contains("meds", m), name)
    kind = kind.when(F.col("patient_id") % 7 == 0, "not_available").otherwise("not_linked")
    return s.select("patient_id", "step", (F.col("b") - F.col("a")).alias("days"), (F.col("b") - F.col("first")).alias("since_first"), F.array_join("meds", " + ").alias("medicines"), kind.alias("evidence"))


@query("chain_transitions", f"WITH RECURSIVE {_EV}, {_STEPS} SELECT * FROM tr")
def chain_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent and anchored intervals of chains, with the strongest evidence of treatment before the later positive."""
    return transitions(spark, sf_dir)


@query("treatment_matrix", f"""WITH RECURSIVE {_EV}, {_STEPS}, c AS (SELECT CASE WHEN medicines <> '' THEN medicines WHEN evidence = 'not_available' THEN 'treatment not available' ELSE 'no linked treatment' END AS prior_treatment, CASE WHEN days BETWEEN 2 AND 3 THEN '2-3' WHEN days BETWEEN 4 AND 5 THEN '4-5' WHEN days BETWEEN 6 AND 9 THEN '6-9' ELSE 'outside bands' END AS band, evidence, count(*) AS n FROM tr GROUP BY ALL)
SELECT prior_treatment, band, CAST(sum(n) AS BIGINT) AS transitions, string_agg(evidence || ':' || n, ',' ORDER BY evidence) AS by_evidence FROM c GROUP BY 1, 2""")
def treatment_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions by what was given before and by interval band; absent treatment is a row of its own."""
    d = F.col("days")
    row = F.when(F.col("medicines") != "", F.col("medicines")).when(F.col("evidence") == "not_available", "treatment not available").otherwise("no linked treatment")
    band = F.when(d.between(2, 3), "2-3").when(d.between(4, 5), "4-5").when(d.between(6, 9), "6-9").otherwise("outside bands")
    c = transitions(spark, sf_dir).groupBy(row.alias("prior_treatment"), band.alias("band"), "evidence").agg(F.count("*").alias("n"))
    kinds = F.array_sort(F.collect_list(F.struct("evidence", "n")))
    return c.groupBy("prior_treatment", "band").agg(F.sum("n").alias("transitions"), F.array_join(F.transform(kinds, lambda x: F.concat_ws(":", x.evidence, x.n)), ",").alias("by_evidence"))


@query("filtered_transitions", f"WITH RECURSIVE {_EV}, {_STEPS} SELECT patient_id, count(*) AS transitions FROM tr WHERE patient_id IN (SELECT patient_id FROM tr WHERE contains(' + ' || medicines || ' + ', ' + purchase + ')) GROUP BY 1")
def filtered_transitions(spark: SparkSession, sf_dir: str, medicines: tuple[str, ...] = ("purchase",)) -> DataFrame:
    """Patients whose chain holds one of the asked medicines; the restriction follows the evaluation."""
    p = transitions(spark, sf_dir).groupBy("patient_id").agg(F.count("*").alias("transitions"), F.flatten(F.collect_set(F.split("medicines", r" \+ "))).alias("m"))
    return p.where(F.arrays_overlap("m", F.array(*map(F.lit, medicines)))).select("patient_id", "transitions")


_SPAN = """sp AS (SELECT patient_id, min(day) AS first_seen, max(day) AS last_seen FROM event GROUP BY 1), en AS (SELECT max(day) AS ends FROM event)"""


@query("patient_determinations", f"""WITH RECURSIVE {_EV}, {_SPAN}, r AS (SELECT ev.*, CASE WHEN last_seen < ends THEN 'early_end' END AS r1, CASE WHEN first_seen > DATE '{PERIOD}' - {CHAIN.window} THEN 'window_unobserved' END AS r2 FROM ev JOIN sp USING (patient_id), en)
SELECT patient_id, CASE WHEN in_period = 0 THEN 'not_in_period' WHEN len(c) > 0 THEN 'qualifies' WHEN r1 IS NOT NULL OR r2 IS NOT NULL THEN 'indeterminate' ELSE 'does_not_qualify' END AS determination, CASE WHEN in_period > 0 AND len(c) = 0 THEN concat_ws(',', r1, r2) ELSE '' END AS reasons FROM r""")
def patient_determinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absence of a chain counts only where observation was complete; else the patient is indeterminate, with the reasons."""
    e = bind.events(spark, sf_dir)
    seen = e.groupBy("patient_id").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    ends = e.select(F.max("day")).scalar()
    c = sequences.chains(spark, sf_dir).join(seen, "patient_id")
    early, unseen = F.col("last_seen") < ends, F.col("first_seen") > F.date_sub(F.to_date(F.lit(PERIOD)), CHAIN.window)
    none = (F.col("in_period") > 0) & (F.size("chain") == 0)
    reasons = F.concat_ws(",", F.when(early, "early_end"), F.when(unseen, "window_unobserved"))
    how = F.when(F.col("in_period") == 0, "not_in_period").when(F.size("chain") > 0, "qualifies").when(early | unseen, "indeterminate").otherwise("does_not_qualify")
    return c.select("patient_id", how.alias("determination"), F.when(none, reasons).otherwise("").alias("reasons"))


@query("same_day_policies", """WITH e AS (SELECT user_id AS patient_id, CAST(ts AS DATE) AS day, event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS n FROM events WHERE event_type = 'error'), p(policy) AS (VALUES ('include'), ('exclude'), ('review'))
SELECT policy, event_id, CASE WHEN policy = 'include' OR n = 1 THEN 'eligible' WHEN policy = 'review' THEN 'needs_review' ELSE 'excluded' END AS treatment FROM e, p""")
def same_day_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of three policies makes of several positives on a day; the smallest id represents a day."""
    w = Window.partitionBy("patient_id", "day").orderBy("event_id")
    e = bind.events(spark, sf_dir).where(F.col("event_type") == "error").select("event_id", F.row_number().over(w).alias("n"))
    x = e.select("event_id", "n", F.explode(F.array(*map(F.lit, ("include", "exclude", "review")))).alias("policy"))
    return x.select("policy", "event_id", F.when((F.col("policy") == "include") | (F.col("n") == 1), "eligible").when(F.col("policy") == "review", "needs_review").otherwise("excluded").alias("treatment"))


def deltas(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, a, b, delta of two tables of counts (key, n); what one lacks is zero."""
    both = a.select(key, F.col("n").alias("a")).join(b.select(key, F.col("n").alias("b")), key, "full")
    x, y = (F.coalesce(c, F.lit(0)) for c in "ab")
    return both.select(key, x.alias("a"), y.alias("b"), (y - x).alias("delta"))


@query("run_deltas", f"""WITH {flags.CTES}, {sequences._EP}, {sequences._SUM}, a AS (SELECT index_facility AS k, count(DISTINCT patient_id) AS n FROM es WHERE positives >= 2 GROUP BY 1), b AS (SELECT index_facility AS k, count(DISTINCT patient_id) AS n FROM es WHERE positives >= 1 AND visits >= 3 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS facility_id, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.k = b.k""")
def run_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualifying patients of facilities under two definitions, side by side."""
    e = sequences.episodes(spark, sf_dir)
    n = lambda where: e.where(where).groupBy(F.col("index_facility").alias("facility_id")).agg(F.count_distinct("patient_id").alias("n"))
    return deltas(n("positives >= 2"), n("positives >= 1 AND visits >= 3"), "facility_id")


def cursor(offset: int, dataset: str) -> str:
    """An opaque cursor, bound to the data and definition that `dataset` names."""
    return f"{offset}.{hashlib.sha256(f'{offset}|{dataset}'.encode()).hexdigest()[:16]}"


def page(rows: DataFrame, order: list[Column], limit: int, at: str | None, dataset: str) -> tuple[DataFrame, str]:
    """One page of ordered rows and the next cursor; a cursor of other data or another definition is refused."""
    offset = int(at.split(".")[0]) if at else 0
    if at and at != cursor(offset, dataset):
        raise ValueError("the cursor belongs to another dataset or definition")
    return rows.orderBy(*order).offset(offset).limit(limit), cursor(offset + limit, dataset)


_DATASET = f"events|{CHAIN}"


@query("patients_page", f"WITH RECURSIVE {_EV}, l AS (SELECT patient_id, max(n) AS latest FROM pos GROUP BY 1) SELECT patient_id, CAST(DATE '1970-01-01' + CAST(latest AS INTEGER) AS DATE) AS latest_positive, len(c) AS length, '{cursor(100, _DATASET)}' AS next FROM ev JOIN l USING (patient_id) ORDER BY latest DESC, patient_id DESC LIMIT 50 OFFSET 50")
def patients_page(spark: SparkSession, sf_dir: str, limit: int = 50, at: str | None = cursor(50, _DATASET)) -> DataFrame:
    """The second page of patients, newest positive first."""
    last = sequences.positives(spark, sf_dir).groupBy("patient_id").agg(F.max("day").alias("latest_positive"))
    rows = sequences.chains(spark, sf_dir).join(last, "patient_id").select("patient_id", "latest_positive", F.size("chain").cast("long").alias("length"))
    got, after = page(rows, [F.desc("latest_positive"), F.desc("patient_id")], limit, at, _DATASET)
    return got.withColumn("next", F.lit(after))


@query("governed_methods", """WITH v AS (SELECT CAST(n_regionkey AS BIGINT) AS definition, CAST(n_nationkey AS BIGINT) AS version, CASE n_nationkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'draft' ELSE 'retired' END AS status, CASE WHEN n_nationkey % 2 = 0 THEN 2.0 END AS threshold, CASE WHEN n_nationkey % 4 <> 1 THEN 6 END AS periods FROM nation),
a AS (SELECT definition, max(version) AS version, arg_max(CASE WHEN threshold IS NULL THEN 1 ELSE 0 END, version) AS t, arg_max(CASE WHEN periods IS NULL THEN 1 ELSE 0 END, version) AS p FROM v WHERE status = 'active' GROUP BY 1)
SELECT CAST(r_regionkey AS BIGINT) AS definition, version, CASE WHEN version IS NULL OR t = 1 OR p = 1 THEN 'not_configured' ELSE 'available' END AS status, CASE WHEN version IS NULL THEN 'version' ELSE concat_ws(',', CASE WHEN p = 1 THEN 'periods' END, CASE WHEN t = 1 THEN 'threshold' END) END AS missing FROM region LEFT JOIN a ON definition = r_regionkey""")
def governed_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each method's version in force; without one, or with parameters missing, a refusal that names them."""
    k = F.col("n_nationkey").cast("long")
    v = bind.table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("definition"), k.alias("version"), F.when(k % 3 == 0, "active").when(k % 3 == 1, "draft").otherwise("retired").alias("status"), F.when(k % 2 == 0, 2.0).alias("threshold"), F.when(k % 4 != 1, 6).alias("periods"))
    a = v.where("status = 'active'").groupBy("definition").agg(F.max("version").alias("version"), F.max_by(F.struct("threshold", "periods"), "version").alias("p"))
    d = bind.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("definition")).join(a, "definition", "left")
    missing = F.when(F.col("version").isNull(), "version").otherwise(F.concat_ws(",", F.when(F.col("p.periods").isNull(), "periods"), F.when(F.col("p.threshold").isNull(), "threshold")))
    return d.select("definition", "version", F.when(missing == "", "available").otherwise("not_configured").alias("status"), missing.alias("missing"))


@query("latest_builds", "SELECT o_custkey % 10 AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS target, max(struct_pack(s := o_orderdate, k := o_orderkey)).k AS build FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def latest_builds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The completed build of each series and period that was started last."""
    o = bind.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return o.groupBy((F.col("o_custkey") % 10).alias("series"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("target")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("build"))


@query("historical_units", """WITH d AS (SELECT DISTINCT l_partkey AS unit, CAST(l_shipdate AS DATE) AS valid_from FROM lineitem), r AS (SELECT unit, valid_from, lead(valid_from) OVER (PARTITION BY unit ORDER BY valid_from) AS valid_to FROM d), v AS (SELECT y AS version, make_date(y, 1, 1) AS starts FROM (SELECT unnest(range(min(extract(year FROM valid_from)), max(extract(year FROM valid_from)) + 2)) AS y FROM d))
SELECT version, unit, valid_from FROM r JOIN v ON valid_from <= starts AND (valid_to IS NULL OR starts < valid_to)""")
def historical_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision of every unit in force at the start of each year, up to the year after the last revision: a revision goes to its
    years, so no range join is needed."""
    l = bind.table(spark, sf_dir, "lineitem")
    end = l.select(F.year(F.max("l_shipdate")) + 1).scalar()
    d = l.select(F.col("l_partkey").alias("unit"), F.col("l_shipdate").cast("date").alias("valid_from")).distinct()
    r = d.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("unit").orderBy("valid_from"))).withColumn("end", end)
    first = F.year("valid_from") + F.when(F.date_trunc("year", "valid_from") == F.col("valid_from"), 0).otherwise(1)
    last = F.coalesce(F.year("valid_to") - F.when(F.date_trunc("year", "valid_to") == F.col("valid_to"), 1).otherwise(0), F.col("end"))
    r = r.withColumns({"a": first, "b": last}).where("a <= b")
    return r.select(F.explode(F.sequence(F.col("a").cast("long"), F.col("b").cast("long"))).alias("version"), "unit", "valid_from")


@query("missing_facilities", f"WITH {bind.CTES}, m AS (SELECT DISTINCT month FROM encounter) SELECT facility_id, m.month FROM facility, m WHERE is_active EXCEPT SELECT facility_id, month FROM encounter")
def missing_facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active facilities without a visit in a month that has visits."""
    e = bind.encounters(spark, sf_dir).select("facility_id", "month").distinct()
    every = bind.facilities(spark, sf_dir).where("is_active").select("facility_id", F.explode(bind.months(spark, sf_dir)).alias("month"))
    every = every.join(e.select("month").distinct(), "month", "left_semi")
    return every.join(e, ["facility_id", "month"], "left_anti")


#: (code, numerator, denominator) of the catalogue; entries without a numerator are declared and not executed.
CATALOGUE = (
    ("attendance", "true", None), ("suspected", "suspected", None), ("tested", "tested", None), ("confirmed", "confirmed", None), ("testing_rate", "suspected AND tested", "suspected"), ("positivity", "confirmed", "tested"),
    ("rdt_positivity", "rdt_positive", "rdt"), ("microscopy_positivity", "microscopy_positive", "microscopy"), ("treated_confirmed", "confirmed AND antimalarial", "confirmed"), ("treated_untested", "antimalarial AND NOT tested", "antimalarial"),
    ("reporting_rate", None, None), ("stock_out_rate", None, None), ("severe_share", None, None), ("incidence", None, None),
)
_CAT = " UNION ALL ".join(f"SELECT '{c}' AS code, 'executed' AS status, count(*) FILTER ({n}) AS numerator, {f'count(*) FILTER ({d})' if d else 'CAST(NULL AS BIGINT)'} AS denominator FROM visit" if n else f"SELECT '{c}', 'declared', NULL, NULL" for c, n, d in CATALOGUE)


@query("indicator_catalogue", f"WITH {flags.CTES} {_CAT}")
def indicator_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of the catalogue, those with a rule evaluated in one pass over visits."""
    sums = [F.count_if(F.expr(x)).alias(f"{side}_{c}") for c, n, d in CATALOGUE for side, x in (("n", n), ("d", d)) if x]
    one = flags.visits(spark, sf_dir).agg(*sums)
    at = lambda side, c, x: (F.col(f"{side}_{c}") if x else F.lit(None).cast("long"))
    rows = F.array(*(F.struct(F.lit(c).alias("code"), F.lit("executed" if n else "declared").alias("status"), at("n", c, n).alias("numerator"), at("d", c, d).alias("denominator")) for c, n, d in CATALOGUE))
    return one.select(F.explode(rows).alias("x")).select("x.*")


@query("area_confirmed", f"""WITH {flags.CTES}, a AS (SELECT district_name AS area FROM district WHERE district_id % 2 = 0 UNION SELECT region_name FROM district WHERE region_id <> 4), p AS (SELECT facility_id, district_name, region_name FROM facility JOIN district USING (district_id)),
x AS (SELECT facility_id, coalesce((SELECT area FROM a WHERE area = district_name), (SELECT area FROM a WHERE area = region_name)) AS area FROM p) SELECT area, count(*) FILTER (confirmed) AS confirmed FROM visit JOIN x USING (facility_id) WHERE area IS NOT NULL GROUP BY 1""")
def area_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed cases of areas: a facility goes to the first of its ancestors that is an area; others are left off the map."""
    d = bind.districts(spark, sf_dir)
    areas = d.where("district_id % 2 = 0").select(F.col("district_name").alias("area")).union(d.where("region_id <> 4").select("region_name")).distinct()
    f = bind.facilities(spark, sf_dir).join(d, "district_id").select("facility_id", F.posexplode(F.array("district_name", "region_name")).alias("place", "area"))
    own = f.join(areas, "area").groupBy("facility_id").agg(F.min_by("area", "place").alias("area"))
    c = flags.visits(spark, sf_dir).groupBy("facility_id").agg(F.count_if("confirmed").alias("n"))
    return c.join(own, "facility_id").groupBy("area").agg(F.sum("n").alias("confirmed"))

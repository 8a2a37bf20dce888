"""Testing and treatment measures, commodity facts and alerts, reconciliation of reported with derived figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.ratio import blank_sum, ratio, ratio_status, sql_ratio, sql_status
from tidewatch.operators import flags
from tidewatch.plans.registry import query
from tidewatch.sources import bind

KEYS = ["facility_id", "month"]


def _measures(base: DataFrame, rows: list[tuple[str, Column, Column | None]]) -> DataFrame:
    """A row for each measure: a ratio, or a count where there is no denominator."""
    one = lambda m, n, d: F.struct(F.lit(m).alias("measure"), n.cast("long").alias("numerator"), (F.lit(None) if d is None else d).cast("long").alias("denominator"), F.lit(d is None).alias("counted"))
    x = base.select(*KEYS, F.explode(F.array(*(one(*r) for r in rows))).alias("x")).select(*KEYS, "x.*")
    n, d = F.col("numerator"), F.col("denominator")
    value = F.when(F.col("counted"), n.cast("double")).otherwise(ratio(n, d))
    status = F.when(F.col("counted"), F.when(n.isNull(), "unavailable_insufficient_data").otherwise("available")).otherwise(ratio_status(n, d))
    return x.select(*KEYS, "measure", "numerator", "denominator", value.alias("value"), status.alias("value_status"))


def _sql_measures(rows: list[tuple[str, str, str | None]], source: str) -> str:
    parts = " UNION ALL ".join(f"SELECT facility_id, month, '{m}' AS measure, CAST({n} AS BIGINT) AS numerator, CAST({d or 'NULL'} AS BIGINT) AS denominator, {str(d is None).lower()} AS counted FROM {source}" for m, n, d in rows)
    return f"x AS ({parts}) SELECT facility_id, month, measure, numerator, denominator, CASE WHEN counted THEN CAST(numerator AS DOUBLE) ELSE {sql_ratio('numerator', 'denominator')} END AS value, CASE WHEN counted THEN CASE WHEN numerator IS NULL THEN 'unavailable_insufficient_data' ELSE 'available' END ELSE {sql_status('numerator', 'denominator')} END AS value_status FROM x"


_TESTING = [("testing_coverage", "tested", "attendance"), ("rdt_share", "rdt", "tested"), ("microscopy_share", "microscopy", "tested"), ("positivity", "confirmed", "tested"), ("negative_treated", "negative_treated", None), ("untested", "attendance - tested", None), ("untested_treated", "untested_treated", None), ("missing_result", "missing_result", None), ("volume_change", "tested", "previous_tested")]


@query("testing_measures", f"""WITH {flags.CTES}, c AS (SELECT facility_id, month, count(*) AS attendance, count(*) FILTER (tested) AS tested, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (rdt) AS rdt, count(*) FILTER (microscopy) AS microscopy,
count(*) FILTER (negative AND treated) AS negative_treated, count(*) FILTER (not_done AND treated) AS untested_treated, count(*) FILTER (missing_result) AS missing_result FROM visit GROUP BY ALL),
b AS (SELECT c.*, p.tested AS previous_tested FROM c LEFT JOIN c p ON p.facility_id = c.facility_id AND p.month = CAST(c.month - INTERVAL 1 MONTH AS DATE)), {_sql_measures(_TESTING, "b")}""")
def testing_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine testing measures of a facility and month from one aggregation; the month before comes by a window."""
    on = F.count_if
    c = flags.visits(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("attendance"), *(on(f).alias(f) for f in ("tested", "confirmed", "rdt", "microscopy", "missing_result")), on(F.col("negative") & F.col("treated")).alias("negative_treated"), on(F.col("not_done") & F.col("treated")).alias("untested_treated"))
    before = Window.partitionBy("facility_id").orderBy("month")
    near = F.lag("month").over(before) == F.add_months("month", -1)
    c = c.withColumn("previous_tested", F.when(near, F.lag("tested").over(before)))
    return _measures(c, [(m, F.expr(n), d and F.expr(d)) for m, n, d in _TESTING])


_TREATMENT = [("confirmed_treated", "confirmed_treated", "confirmed"), ("confirmed_untreated", "confirmed - confirmed_treated", None), ("treated_unconfirmed", "treated - confirmed_treated", None), ("no_prescription", "attendance - any_rx", None)]


@query("treatment_measures", f"""WITH {flags.CTES}, c AS (SELECT facility_id, month, count(*) AS attendance, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (treated) AS treated, count(*) FILTER (any_rx) AS any_rx, count(*) FILTER (confirmed AND treated) AS confirmed_treated FROM visit GROUP BY ALL), {_sql_measures(_TREATMENT, "c")}""")
def treatment_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four treatment measures; treated means any prescription with a medicine's name."""
    c = flags.visits(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("attendance"), *(F.count_if(f).alias(f) for f in ("confirmed", "treated", "any_rx")), F.count_if(F.col("confirmed") & F.col("treated")).alias("confirmed_treated"))
    return _measures(c, [(m, F.expr(n), d and F.expr(d)) for m, n, d in _TREATMENT])


_STOCK = f"""w AS (SELECT facility_id, district_id, month, commodity, sum(value) FILTER (metric = 'days_out') AS days_out, min(value) FILTER (metric = 'on_hand') AS on_hand, count(value) AS reported FROM stock GROUP BY ALL),
facts AS (SELECT *, CASE WHEN reported = 0 THEN 'stock_not_reported' WHEN days_out > 0 THEN 'days_out_of_stock' WHEN on_hand = 0 THEN 'zero_on_hand' END AS fact FROM w)"""


def commodity_facts(spark: SparkSession, sf_dir: str, watched: tuple[str, ...] = ()) -> DataFrame:
    """Facts of all commodities, or of the watched ones."""
    s = bind.stock(spark, sf_dir)
    s = s.where(F.col("commodity").isin(*watched)) if watched else s
    w = s.groupBy("facility_id", "district_id", "month", "commodity").agg(F.sum(F.when(F.col("metric") == "days_out", F.col("value"))).alias("days_out"), F.min(F.when(F.col("metric") == "on_hand", F.col("value"))).alias("on_hand"), F.count("value").alias("reported"))
    return w.withColumn("fact", F.when(F.col("reported") == 0, "stock_not_reported").when(F.col("days_out") > 0, "days_out_of_stock").when(F.col("on_hand") == 0, "zero_on_hand"))


@query("commodity_facts", f"WITH {bind.CTES}, {_STOCK} SELECT facility_id, month, commodity, CAST(days_out AS BIGINT) AS days_out, on_hand, fact FROM facts WHERE fact IS NOT NULL")
def commodity_fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts about watched stock; days out come before zero stock."""
    return commodity_facts(spark, sf_dir).where("fact IS NOT NULL").select("facility_id", "month", "commodity", "days_out", "on_hand", "fact")


@query("commodity_alerts", f"WITH {bind.CTES}, {_STOCK} SELECT facility_id, month, 'stock_out_reported' AS alert, 'unclassified' AS severity, count(*) AS facts, string_agg(DISTINCT commodity, ',' ORDER BY commodity) AS commodities FROM facts WHERE fact IN ('days_out_of_stock', 'zero_on_hand') GROUP BY 1, 2")
def commodity_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert a facility and month with any stock-out."""
    f = commodity_facts(spark, sf_dir).where(F.col("fact").isin("days_out_of_stock", "zero_on_hand"))
    return f.groupBy("facility_id", "month").agg(F.lit("stock_out_reported").alias("alert"), F.lit("unclassified").alias("severity"), F.count("*").alias("facts"), F.array_join(F.array_sort(F.collect_set("commodity")), ",").alias("commodities"))


@query("commodity_alerts_by_district", f"WITH {bind.CTES}, {_STOCK}, a AS (SELECT DISTINCT district_id, facility_id, month FROM facts WHERE fact IN ('days_out_of_stock', 'zero_on_hand')) SELECT district_id, count(*) AS alerts FROM a GROUP BY 1")
def alerts_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of each district."""
    f = commodity_facts(spark, sf_dir).where(F.col("fact").isin("days_out_of_stock", "zero_on_hand"))
    return f.select("district_id", "facility_id", "month").distinct().groupBy("district_id").agg(F.count("*").alias("alerts"))


@query("stock_overlap_context", f"""WITH {flags.CTES}, {_STOCK}, v AS (SELECT facility_id, month, count(*) FILTER (confirmed) AS confirmed FROM visit GROUP BY ALL)
SELECT v.facility_id, v.month, confirmed, string_agg(f.commodity || ':' || fact, ',' ORDER BY f.commodity, fact) AS context FROM v JOIN facts f ON f.facility_id = v.facility_id AND fact IS NOT NULL AND fact <> 'stock_not_reported' AND f.month <= last_day(v.month) AND last_day(f.month) >= v.month GROUP BY ALL""")
def stock_overlap_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock facts whose period overlaps a facility's; whole months overlap only themselves, so the month is a key of the join."""
    v = flags.visits(spark, sf_dir).groupBy(*KEYS).agg(F.count_if("confirmed").alias("confirmed"))
    f = commodity_facts(spark, sf_dir).where("fact IS NOT NULL AND fact <> 'stock_not_reported'").groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("commodity", "fact"))).alias("x"))
    return v.join(f, KEYS).select(*KEYS, "confirmed", F.array_join(F.transform("x", lambda r: F.concat(r.commodity, F.lit(":"), r.fact)), ",").alias("context"))


_RULES = [("OA01", "attendance = 'new'"), ("EP01b", "tested"), ("EP01c", "confirmed"), ("TESTED_RDT", "rdt"), ("RDT_POSITIVE", "rdt_positive"), ("TESTED_MICROSCOPY", "microscopy"), ("MICROSCOPY_POSITIVE", "microscopy_positive")]
#: Reported totals are bound to the visits with status F, with a blank for small facilities' first element.
_REPORTED = [("OA01", "attendance = 'new' AND encounter_id % 7 <> 0"), ("EP01b", "tested"), ("EP01c", "confirmed AND encounter_id % 11 <> 0"), ("OTHER", "suspected")]


def _totals(v: DataFrame, rules: list[tuple[str, str]], name: str) -> DataFrame:
    c = v.groupBy(*KEYS).agg(*(F.count_if(F.expr(w)).alias(e) for e, w in rules))
    return c.unpivot(KEYS, [e for e, _ in rules], "element", name)


def _sql_totals(rules: list[tuple[str, str]], name: str) -> str:
    return " UNION ALL ".join(f"SELECT facility_id, month, '{e}' AS element, count(*) FILTER ({w}) AS {name} FROM visit GROUP BY 1, 2" for e, w in rules)


@query("derived_totals", f"WITH {flags.CTES} {_sql_totals(_RULES, 'derived')}")
def derived_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What visits say about each element of the forms, all rules in one pass."""
    return _totals(flags.visits(spark, sf_dir), _RULES, "derived")


#: Needs flags.CTES.
SQL_RECONCILIATION = f"""WITH d AS ({_sql_totals(_RULES, 'derived')}), r0 AS ({_sql_totals(_REPORTED, 'reported')}), r AS (SELECT facility_id, month, element, CASE WHEN (facility_id + extract(month FROM month)) % 5 = 0 AND element <> 'EP01b' THEN NULL ELSE reported END AS reported FROM r0)
SELECT coalesce(d.facility_id, r.facility_id) AS facility_id, coalesce(d.month, r.month) AS month, coalesce(d.element, r.element) AS element, reported, derived, reported - derived AS difference,
CASE WHEN d.element IS NULL AND reported IS NULL THEN 'not_reported' WHEN d.element IS NULL THEN 'no_rule' WHEN r.element IS NULL THEN 'not_on_form' WHEN reported IS NULL THEN 'derived_only' WHEN reported = derived THEN 'matched' ELSE 'differs' END AS status
FROM d FULL JOIN r ON d.facility_id = r.facility_id AND d.month = r.month AND d.element = r.element"""


@query("reconciliation", f"WITH {flags.CTES} SELECT * FROM ({SQL_RECONCILIATION})")
def reconciliation(spark: SparkSession, sf_dir: str, visits: DataFrame | None = None) -> DataFrame:
    """Reported against derived figures of every element, with a six-way status; both come from one aggregation of visits."""
    derived, reported = dict(_RULES), dict(_REPORTED)
    v = flags.visits(spark, sf_dir) if visits is None else visits
    c = v.groupBy(*KEYS).agg(*(F.count_if(F.expr(w)).alias(f"d_{e}") for e, w in _RULES), *(F.count_if(F.expr(w)).alias(f"r_{e}") for e, w in _REPORTED))
    cell = lambda e: F.struct(F.lit(e).alias("element"), (F.col(f"r_{e}") if e in reported else F.lit(None).cast("long")).alias("reported"), (F.col(f"d_{e}") if e in derived else F.lit(None).cast("long")).alias("derived"), F.lit(e in reported).alias("on_form"), F.lit(e in derived).alias("ruled"))
    x = c.select(*KEYS, F.explode(F.array(*(cell(e) for e in {**derived, **reported}))).alias("x")).select(*KEYS, "x.*")
    blank = ((F.col("facility_id") + F.month("month")) % 5 == 0) & (F.col("element") != "EP01b")
    x = x.withColumn("reported", F.when(~blank, F.col("reported")))
    status = F.when(~F.col("ruled") & F.col("reported").isNull(), "not_reported").when(~F.col("ruled"), "no_rule").when(~F.col("on_form"), "not_on_form").when(F.col("reported").isNull(), "derived_only").when(F.col("reported") == F.col("derived"), "matched").otherwise("differs")
    return x.select(*KEYS, "element", "reported", "derived", (F.col("reported") - F.col("derived")).alias("difference"), status.alias("status"))


_SUBMISSIONS = """sub AS (SELECT o_custkey AS reporter, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey AS id, o_totalprice AS total, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS revision FROM orders)"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = bind.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reporter"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), "o_orderdate")
    return o.withColumn("revision", F.row_number().over(Window.partitionBy("reporter", "month").orderBy("o_orderdate", "id"))).drop("o_orderdate")


@query("submission_supersession", f"WITH {_SUBMISSIONS} SELECT reporter, month, id, CAST(revision AS BIGINT) AS revision, CASE WHEN revision = max(revision) OVER (PARTITION BY reporter, month) THEN 'accepted' ELSE 'superseded' END AS status FROM sub")
def submission_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest revision of a period is accepted, others are superseded, however late they come."""
    top = F.max("revision").over(Window.partitionBy("reporter", "month"))
    return submissions(spark, sf_dir).select("reporter", "month", "id", F.col("revision").cast("long").alias("revision"), F.when(F.col("revision") == top, "accepted").otherwise("superseded").alias("status"))


@query("accepted_totals", f"WITH {_SUBMISSIONS}, a AS (SELECT reporter, month, arg_max(total, revision) AS total FROM sub GROUP BY ALL) SELECT month, count(*) AS reporters, sum(CAST(total AS DECIMAL(18, 2)))::DOUBLE AS total FROM a GROUP BY 1")
def accepted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over accepted revisions only, picked by aggregation."""
    a = submissions(spark, sf_dir).groupBy("reporter", "month").agg(F.max_by("total", "revision").alias("total"))
    return a.groupBy("month").agg(F.count("*").alias("reporters"), F.sum(F.col("total").cast("decimal(18,2)")).cast("double").alias("total"))


@query("operational_alerts", f"""WITH {flags.CTES}, {_STOCK}, c AS (SELECT facility_id, month, count(*) FILTER (suspected) AS suspected, count(*) FILTER (tested) AS tested, count(*) FILTER (confirmed) AS confirmed FROM visit GROUP BY ALL)
SELECT facility_id, month, 'tested_exceeds_suspected' AS alert, NULL AS subject, tested - suspected AS excess FROM c WHERE tested > suspected UNION ALL SELECT facility_id, month, 'confirmed_exceeds_suspected', NULL, confirmed - suspected FROM c WHERE confirmed > suspected UNION ALL SELECT facility_id, month, 'days_out_of_stock', commodity, CAST(days_out AS BIGINT) FROM facts WHERE days_out > 0""")
def operational_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of a month that contradict each other, and commodities that were out of stock."""
    c = flags.visits(spark, sf_dir).groupBy(*KEYS).agg(*(F.count_if(x).alias(x) for x in ("suspected", "tested", "confirmed")))
    alert = lambda name, x: F.struct(F.lit(name).alias("alert"), F.lit(None).cast("string").alias("subject"), (F.col(x) - F.col("suspected")).alias("excess"))
    rows = F.explode(F.array(alert("tested_exceeds_suspected", "tested"), alert("confirmed_exceeds_suspected", "confirmed")))
    figures = c.select(*KEYS, rows.alias("x")).select(*KEYS, "x.*").where("excess > 0")
    out = commodity_facts(spark, sf_dir).where("days_out > 0").select(*KEYS, F.lit("days_out_of_stock").alias("alert"), F.col("commodity").alias("subject"), F.col("days_out").alias("excess"))
    return figures.unionByName(out)


@query("reported_totals", f"WITH {bind.CTES} SELECT commodity AS element, month, CAST(sum(value) AS BIGINT) AS total, CASE WHEN count(value) = 0 THEN 'all_blank' ELSE 'reported' END AS status FROM stock GROUP BY ALL")
def reported_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by element, null where all cells are blank."""
    return bind.stock(spark, sf_dir).groupBy(F.col("commodity").alias("element"), "month").agg(blank_sum(F.col("value")).alias("total"), F.when(F.count("value") == 0, "all_blank").otherwise("reported").alias("status"))

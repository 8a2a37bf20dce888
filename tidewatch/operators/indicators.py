"""Indicators: counts of visits, ratios with status, roll-ups, blank-aware sums, KPI strip and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.ratio import blank_sum, blanks, count_status, ratio, ratio_status, sql_ratio, sql_status
from tidewatch.operators import flags
from tidewatch.plans.registry import query
from tidewatch.sources import bind

COUNTS = ["attendance", "suspected", "tested", "confirmed", "treated"]


def counted(*names: str) -> list[Column]:
    own = {"attendance": F.count("*"), "treated": F.count_if("antimalarial")}
    return [own.get(n, F.count_if(n)).alias(n) for n in names]


@query("indicator_counts", f"""WITH {flags.CTES}, c AS (SELECT facility_id, month, count(*) AS attendance, count(*) FILTER (suspected) AS suspected, count(*) FILTER (tested) AS tested, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (antimalarial) AS treated FROM visit GROUP BY ALL)
UNPIVOT c ON attendance, suspected, tested, confirmed, treated INTO NAME indicator VALUE value""")
def indicator_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of a facility and month in one pass, one row each."""
    c = flags.visits(spark, sf_dir).groupBy("facility_id", "month").agg(*counted(*COUNTS))
    return c.unpivot(["facility_id", "month"], COUNTS, "indicator", "value")


@query("indicator_positivity_rollup", f"""WITH {flags.CTES}, b AS (SELECT month, region_id, v.district_id, facility_id, sum(n) AS numerator, sum(d) AS denominator FROM (
  SELECT month, facility_id, count(*) FILTER (confirmed) AS n, count(*) FILTER (tested) AS d FROM visit GROUP BY ALL) JOIN facility v USING (facility_id) JOIN district USING (district_id) WHERE is_active
  GROUP BY GROUPING SETS ((month, region_id, v.district_id, facility_id), (month, region_id, v.district_id), (month, region_id), (month)))
SELECT month, CASE WHEN facility_id IS NOT NULL THEN 'facility' WHEN district_id IS NOT NULL THEN 'district' WHEN region_id IS NOT NULL THEN 'region' ELSE 'national' END AS grain,
  coalesce(facility_id, district_id, region_id, -1) AS unit_id, CAST(numerator AS BIGINT) AS numerator, CAST(denominator AS BIGINT) AS denominator, {sql_ratio("numerator", "denominator")} AS value, {sql_status("numerator", "denominator")} AS value_status FROM b""")
def positivity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed over tested for facilities, districts, regions and the nation: parts are summed, ratios recomputed."""
    v = flags.visits(spark, sf_dir).groupBy("month", "facility_id").agg(F.count_if("confirmed").alias("n"), F.count_if("tested").alias("d"))
    placed = v.join(bind.facilities(spark, sf_dir).where("is_active"), "facility_id").join(bind.districts(spark, sf_dir), "district_id")
    sets = [["month", "region_id", "district_id", "facility_id"], ["month", "region_id", "district_id"], ["month", "region_id"], ["month"]]
    r = placed.groupingSets([[F.col(c) for c in s] for s in sets], "month", "region_id", "district_id", "facility_id").agg(F.sum("n").alias("numerator"), F.sum("d").alias("denominator"))
    grain = F.when(F.col("facility_id").isNotNull(), "facility").when(F.col("district_id").isNotNull(), "district").when(F.col("region_id").isNotNull(), "region").otherwise("national")
    n, d = F.col("numerator"), F.col("denominator")
    return r.select("month", grain.alias("grain"), F.coalesce("facility_id", "district_id", "region_id", F.lit(-1)).alias("unit_id"), n, d, ratio(n, d).alias("value"), ratio_status(n, d).alias("value_status"))


@query("rollup_completeness", f"""WITH {flags.CTES}, v AS (SELECT facility_id, month, count(*) FILTER (tested) AS d FROM visit GROUP BY ALL), e AS (SELECT district_id, count(*) AS expected FROM facility WHERE is_active GROUP BY 1),
m AS (SELECT DISTINCT month FROM v), c AS (SELECT district_id, month, count(*) FILTER (d > 0) AS contributing FROM v JOIN facility USING (facility_id) WHERE is_active GROUP BY ALL)
SELECT district_id, month, expected, coalesce(contributing, 0) AS contributing, greatest(expected - coalesce(contributing, 0), 0) AS missing, {sql_ratio("coalesce(contributing, 0)", "greatest(expected, coalesce(contributing, 0))", 4)} AS completeness FROM e CROSS JOIN m LEFT JOIN c USING (district_id, month)""")
def rollup_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected, contributing and missing facilities of a district and month."""
    v = flags.visits(spark, sf_dir).groupBy("facility_id", "month").agg(F.count_if("tested").alias("d"))
    active = bind.facilities(spark, sf_dir).where("is_active")
    expected = active.groupBy("district_id").agg(F.count("*").alias("expected"), F.lit(1).alias("one"))
    months = v.select("month").distinct().withColumn("one", F.lit(1))
    got = v.join(active, "facility_id").groupBy("district_id", "month").agg(F.count_if(F.col("d") > 0).alias("contributing"))
    out = expected.join(months, "one").join(got, ["district_id", "month"], "left").withColumn("contributing", F.coalesce("contributing", F.lit(0)))
    return out.select("district_id", "month", "expected", "contributing", F.greatest(F.col("expected") - F.col("contributing"), F.lit(0)).alias("missing"), ratio(F.col("contributing"), F.greatest("expected", "contributing"), 4).alias("completeness"))


@query("blank_aware_stock_sum", f"""WITH {bind.CTES} SELECT facility_id, month, commodity, metric, CAST(sum(value) AS BIGINT) AS total, count(*) FILTER (value IS NULL) AS blanks, CASE WHEN sum(value) IS NULL THEN 'unavailable_insufficient_data' ELSE 'available' END AS value_status FROM stock GROUP BY ALL""")
def blank_aware_stock_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of reported cells with the number of blank ones."""
    s = bind.stock(spark, sf_dir).groupBy("facility_id", "month", "commodity", "metric").agg(blank_sum(F.col("value")).alias("total"), blanks(F.col("value")).alias("blanks"))
    return s.withColumn("value_status", count_status(F.col("total")))


@query("laboratory_done_sum", f"""WITH {bind.CTES} SELECT facility_id, month, count(*) FILTER (method IN ('rdt', 'microscopy')) AS done, count(*) FILTER (method IN ('rdt', 'microscopy') AND result = 'positive') AS positive FROM encounter JOIN test USING (encounter_id) GROUP BY ALL""")
def laboratory_done_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests done and positive, counted before the join to visits."""
    done = F.col("method").isin("rdt", "microscopy")
    t = bind.tests(spark, sf_dir).groupBy("encounter_id").agg(F.count_if(done).alias("done"), F.count_if(done & (F.col("result") == "positive")).alias("positive"))
    return bind.encounters(spark, sf_dir).join(t, "encounter_id").groupBy("facility_id", "month").agg(F.sum("done").alias("done"), F.sum("positive").alias("positive"))


_KPI = f"""k AS (SELECT month, count(*) AS attendance, count(*) FILTER (suspected) AS suspected, count(*) FILTER (tested) AS tested, count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (antimalarial) AS treated FROM visit GROUP BY 1)"""


@query("kpi_strip", f"""WITH {flags.CTES}, {_KPI}, p AS (SELECT month, 'testing_rate' AS code, tested AS numerator, suspected AS denominator FROM k UNION ALL SELECT month, 'positivity', confirmed, tested FROM k UNION ALL SELECT month, 'treatment_rate', treated, confirmed FROM k)
SELECT month, code, numerator, denominator, {sql_ratio("numerator", "denominator")} AS value, {sql_status("numerator", "denominator")} AS value_status FROM p""")
def kpi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """National ratios of a month."""
    k = flags.visits(spark, sf_dir).groupBy("month").agg(*counted(*COUNTS))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(n).alias("numerator"), F.col(d).alias("denominator")) for c, n, d in (("testing_rate", "tested", "suspected"), ("positivity", "confirmed", "tested"), ("treatment_rate", "treated", "confirmed")))))
    n, d = F.col("numerator"), F.col("denominator")
    return k.select("month", rows.alias("x")).select("month", "x.*").withColumns({"value": ratio(n, d), "value_status": ratio_status(n, d)})


@query("period_comparison", f"""WITH {flags.CTES}, {_KPI}, c AS (SELECT n.month, n.confirmed, n.tested, p.confirmed AS previous_confirmed, p.tested AS previous_tested FROM k n LEFT JOIN k p ON p.month = CAST(n.month - INTERVAL 1 MONTH AS DATE)),
v AS (SELECT *, {sql_ratio("confirmed", "tested")} AS value, {sql_ratio("previous_confirmed", "previous_tested")} AS previous FROM c)
SELECT month, value, previous, CASE WHEN value IS NULL OR previous IS NULL THEN NULL WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'unchanged' END AS direction FROM v""")
def period_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positivity against the month before; a missing month compares with nothing."""
    k = flags.visits(spark, sf_dir).groupBy("month").agg(*counted("tested", "confirmed")).withColumn("value", ratio(F.col("confirmed"), F.col("tested")))
    before = k.select(F.add_months("month", 1).alias("month"), F.col("value").alias("previous"))
    direction = F.when(F.col("value") > F.col("previous"), "up").when(F.col("value") < F.col("previous"), "down").when(F.col("value") == F.col("previous"), "unchanged")
    return k.join(before, "month", "left").select("month", "value", "previous", direction.alias("direction"))


@query("facility_contributions", f"""WITH {flags.CTES}, c AS (SELECT facility_id, month, count(*) FILTER (confirmed) AS n FROM visit GROUP BY 1, 2), m AS (SELECT DISTINCT month FROM c)
SELECT facility.facility_id, facility_name, m.month, n AS numerator, CASE WHEN n IS NULL THEN 'unavailable_insufficient_data' ELSE 'available' END AS value_status FROM facility CROSS JOIN m LEFT JOIN c ON c.facility_id = facility.facility_id AND c.month = m.month""")
def facility_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each facility adds to each month's confirmed visits; a silent facility has no value."""
    c = flags.visits(spark, sf_dir).groupBy("facility_id", "month").agg(F.count_if("confirmed").alias("numerator"))
    seen = bind.encounters(spark, sf_dir).select("month").distinct()
    every = bind.facilities(spark, sf_dir).select("facility_id", "facility_name", F.explode(bind.months(spark, sf_dir)).alias("month")).join(seen, "month", "left_semi")
    return every.join(c, ["facility_id", "month"], "left").select("facility_id", "facility_name", "month", "numerator", count_status(F.col("numerator")).alias("value_status"))


@query("withheld_ratio_kpi", f"""WITH {flags.CTES}, c AS (SELECT facility_id, count(*) FILTER (antimalarial) AS n, count(*) FILTER (confirmed) AS d FROM visit GROUP BY 1)
SELECT facility_id, CASE WHEN d > 0 AND n <= d THEN n END AS numerator, CASE WHEN d > 0 AND n <= d THEN d END AS denominator, CASE WHEN d > 0 AND n <= d THEN round_even(100.0::DOUBLE * n / d, 6) END AS percent FROM c""")
def withheld_ratio_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ratio with all its parts, or nothing where the parts contradict each other."""
    c = flags.visits(spark, sf_dir).groupBy("facility_id").agg(F.count_if("antimalarial").alias("n"), F.count_if("confirmed").alias("d"))
    ok = (F.col("d") > 0) & (F.col("n") <= F.col("d"))
    return c.select("facility_id", F.when(ok, F.col("n")).alias("numerator"), F.when(ok, F.col("d")).alias("denominator"), F.when(ok, F.bround(F.lit(100.0) * F.col("n") / F.nullif(F.col("d"), F.lit(0)), 6)).alias("percent"))


@query("trend_twelve_months", f"""WITH {flags.CTES}, {_KPI}, last AS (SELECT max(month) AS m FROM k) SELECT strftime(month, '%Y%m') AS period, attendance, tested, confirmed, CASE WHEN tested > 0 AND confirmed <= tested THEN {sql_ratio("confirmed", "tested")} END AS positivity FROM k, last WHERE month > m - INTERVAL 12 MONTH""")
def trend_twelve_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twelve months of the data."""
    k = flags.visits(spark, sf_dir).groupBy("month").agg(*counted("attendance", "tested", "confirmed"))
    last = k.agg(F.max("month").alias("last"))
    kept = k.join(F.broadcast(last), F.col("month") > F.add_months("last", -12))  # one row
    valid = F.when((F.col("tested") > 0) & (F.col("confirmed") <= F.col("tested")), ratio(F.col("confirmed"), F.col("tested")))
    return kept.select(F.date_format("month", "yyyyMM").alias("period"), "attendance", "tested", "confirmed", valid.alias("positivity"))


@query("source_cutoff", """SELECT CAST(greatest((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) AS DATE) AS cutoff""")
def source_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest date of any source."""
    both = bind.table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("d")).union(bind.table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate")))
    return both.agg(F.max("d").cast("date").alias("cutoff"))


@query("indicator_summary", f"WITH {flags.CTES} SELECT month, facility_id, count(*) AS attendance, count(*) FILTER (confirmed) AS confirmed FROM visit GROUP BY ALL")
def indicator_summary(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Stored results, of a period and as a page (newest first) where these are asked for; dates reach the scan."""
    v = flags.visits(spark, sf_dir)
    v = v.where(F.col("encounter_date") >= start) if start else v
    v = v.where(F.col("encounter_date") <= end) if end else v
    rows = v.groupBy("month", "facility_id").agg(*counted("attendance", "confirmed"))
    return rows.orderBy(F.desc("month"), "facility_id").limit(limit) if limit else rows


@query("latest_facility_result", f"""WITH {flags.CTES}, c AS (SELECT facility_id, month, count(*) AS attendance FROM visit GROUP BY ALL) SELECT facility_id, max(month) AS month, arg_max(attendance, month) AS attendance FROM c GROUP BY 1""")
def latest_facility_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest result of each facility, by aggregation instead of a sort."""
    c = flags.visits(spark, sf_dir).groupBy("facility_id", "month").agg(*counted("attendance"))
    return c.groupBy("facility_id").agg(F.max("month").alias("month"), F.max_by("attendance", "month").alias("attendance"))


@query("cumulative_confirmed", f"""WITH {flags.CTES}, {_KPI} SELECT month, confirmed, CAST(sum(confirmed) OVER (PARTITION BY extract(year FROM month) ORDER BY month) AS BIGINT) AS cumulative FROM k""")
def cumulative_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed visits so far in the year."""
    k = flags.visits(spark, sf_dir).groupBy("month").agg(*counted("confirmed"))
    return k.withColumn("cumulative", F.sum("confirmed").over(Window.partitionBy(F.year("month")).orderBy("month")))

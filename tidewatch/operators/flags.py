"""One row a visit with everything that indicators ask of its tests and medicines.

Tests and medicines are summed up by visit before the join, so the join never multiplies rows and every later count is a
plain sum instead of a distinct count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources import bind


def line_flags(lines: DataFrame, pattern: str = bind.ANTIMALARIAL) -> DataFrame:
    """Flags of a visit's tests and medicines, from one aggregation over its lines."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    m, r = F.col("method"), F.col("result")
    tests = [some(m != "not_done").alias("tested"), some(r == "positive").alias("confirmed"), some(r == "negative").alias("negative"), some(m == "rdt").alias("rdt"), some(m == "microscopy").alias("microscopy"), some((m == "rdt") & (r == "positive")).alias("rdt_positive"), some((m == "microscopy") & (r == "positive")).alias("microscopy_positive"), some((m != "not_done") & (r == "unknown")).alias("missing_result"), some(m == "not_done").alias("not_done"), F.min("method").alias("first_method")]
    medicines = [some(F.col("drug_name").isNotNull()).alias("treated"), some(F.lower("drug_name").rlike(pattern)).alias("antimalarial"), some(F.col("prescribed")).alias("any_rx")]
    return lines.groupBy("encounter_id").agg(*tests, *medicines)


FLAGS = ["tested", "confirmed", "negative", "rdt", "microscopy", "rdt_positive", "microscopy_positive", "missing_result", "not_done"]
MEDICINE = ["treated", "antimalarial", "any_rx"]


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are scanned and shuffled once, for tests and medicines together."""
    e = bind.encounters(spark, sf_dir).join(line_flags(bind.lines(spark, sf_dir)), "encounter_id", "left")
    return e.withColumns({f: F.coalesce(f, F.lit(False)) for f in FLAGS + MEDICINE} | {"suspected": F.col("fever") == "yes"})


CTES = bind.CTES + """,
tf AS (SELECT encounter_id, bool_or(method <> 'not_done') AS tested, bool_or(result = 'positive') AS confirmed, bool_or(result = 'negative') AS negative, bool_or(method = 'rdt') AS rdt, bool_or(method = 'microscopy') AS microscopy,
  bool_or(method = 'rdt' AND result = 'positive') AS rdt_positive, bool_or(method = 'microscopy' AND result = 'positive') AS microscopy_positive, bool_or(method <> 'not_done' AND result = 'unknown') AS missing_result, bool_or(method = 'not_done') AS not_done, min(method) AS first_method FROM test GROUP BY 1),
mf AS (SELECT encounter_id, bool_or(drug_name IS NOT NULL) AS treated, bool_or(coalesce(regexp_matches(lower(drug_name), '(ring|bolt)'), false)) AS antimalarial FROM rx GROUP BY 1),
visit AS (SELECT e.*, coalesce(tested, false) AS tested, coalesce(confirmed, false) AS confirmed, coalesce(negative, false) AS negative, coalesce(rdt, false) AS rdt, coalesce(microscopy, false) AS microscopy, coalesce(rdt_positive, false) AS rdt_positive,
  coalesce(microscopy_positive, false) AS microscopy_positive, coalesce(missing_result, false) AS missing_result, coalesce(not_done, false) AS not_done, first_method, coalesce(treated, false) AS treated, coalesce(antimalarial, false) AS antimalarial, mf.encounter_id IS NOT NULL AS any_rx, fever = 'yes' AS suspected
  FROM encounter e LEFT JOIN tf USING (encounter_id) LEFT JOIN mf USING (encounter_id))
"""

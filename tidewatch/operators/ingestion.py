"""Loading: artefact scans, validators with ledgers of rows, merges, and resolution of names, parents and people."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import scalars as fn
from tidewatch.plans.registry import query
from tidewatch.sources import bind, jsonl

_LINES = f"""{bind.CTES}, ln AS (SELECT month AS artefact, encounter_id AS id, encounter_date, patient_id, fever, CASE WHEN encounter_id % 1019 = 0 THEN 'malformed_json' WHEN encounter_id % 1013 = 0 OR encounter_id % 1021 = 0 THEN 'forbidden_field' WHEN encounter_id % 9973 = 0 THEN 'wrong_record_type' WHEN encounter_id % 1009 = 0 THEN 'missing_source_row_id' END AS fault FROM encounter)"""


@query("jsonl_artefacts", f"WITH {_LINES} SELECT artefact, count(*) AS lines, count(fault) AS bad, CASE WHEN count(fault) > 0 THEN 'aborted' ELSE 'accepted' END AS outcome, arg_min(fault, id) FILTER (fault IS NOT NULL) AS first_fault FROM ln GROUP BY 1")
def jsonl_artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each artefact's outcome: one bad line aborts the whole."""
    j = jsonl.judged(jsonl.lines(spark, sf_dir))
    bad = F.col("fault").isNotNull()
    return j.groupBy("artefact").agg(F.count("*").alias("lines"), F.count_if(bad).alias("bad"), F.when(F.count_if(bad) > 0, "aborted").otherwise("accepted").alias("outcome"), F.min_by(F.col("fault"), F.when(bad, F.col("id"))).alias("first_fault"))


@query("jsonl_encounters", f"WITH {_LINES}, a AS (SELECT artefact FROM ln GROUP BY 1 HAVING count(fault) = 0) SELECT artefact, CAST(id AS VARCHAR) AS source_row_id, encounter_date AS visit_date, patient_id AS person, fever FROM ln JOIN a USING (artefact)")
def jsonl_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of accepted artefacts, typed."""
    j = jsonl.judged(jsonl.lines(spark, sf_dir))
    good = j.groupBy("artefact").agg(F.count("fault").alias("bad")).where("bad = 0").select("artefact")
    return j.join(good, "artefact").select("artefact", "row.source_row_id", F.col("row.visit_date").cast("date").alias("visit_date"), "row.person", "row.fever")


@query("forbidden_fields", f"WITH {_LINES} SELECT artefact, id, CASE WHEN id % 1013 = 0 THEN '$.extra.contact.Patient_Name' ELSE '$.extra.seen[1].patientName' END AS paths FROM ln WHERE (id % 1013 = 0 OR id % 1021 = 0) AND id % 1019 <> 0")
def forbidden_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold a person's fields at any depth, with the paths of the keys."""
    d = jsonl.lines(spark, sf_dir)
    found = d.withColumn("line_id", jsonl.line_id()).join(jsonl.forbidden_paths(d), "line_id")
    return found.select("artefact", "id", F.array_join("paths", ",").alias("paths"))


@query("payload_paths", "SELECT t.fullkey AS path, CASE t.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'void' ELSE 'number' END AS kind, count(*) AS events, count(DISTINCT event_type) AS types FROM events, json_tree(props) t WHERE t.fullkey <> '$' GROUP BY 1, 2")
def payload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path that the payloads of events hold, with the kinds of its values and how often it comes."""
    e = bind.table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    found = jsonl.walked(e.select(F.col("event_id").alias("id"), F.try_parse_json("props").alias("v")))
    kind = F.when(F.col("kind").isin("object", "array", "string", "void"), F.col("kind")).otherwise("number")
    return found.join(e, found.id == e.event_id).groupBy("path", kind.alias("kind")).agg(F.count("*").alias("events"), F.count_distinct("event_type").alias("types"))


RETURN = "id long, observations array<struct<element: string, value: string>>, stock array<struct<commodity: string, metric: string, value: string>>"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregate returns as JSON texts: the lines of an order as its observations and stock."""
    l, p = bind.table(spark, sf_dir, "lineitem"), bind.table(spark, sf_dir, "part")
    value = F.when(F.col("l_tax") != 0, F.when(F.col("l_discount") == 0, F.lit("NaN")).otherwise(F.col("l_quantity").cast("int").cast("string")))
    d = l.join(p, l.l_partkey == p.p_partkey)
    odd = F.col("l_linenumber") % 2 == 1
    d = d.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.when(odd, F.struct(F.concat(F.lit("E"), "l_linenumber").alias("element"), value.alias("value")))).alias("observations"), F.collect_list(F.when(~odd, F.struct(F.col("p_brand").alias("commodity"), F.lit("on_hand").alias("metric"), value.alias("value")))).alias("stock"))
    return d.select("id", F.to_json(F.struct("id", "observations", "stock")).alias("line"))


@query("jsonl_aggregate_cells", """SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 1 THEN 'observation' ELSE 'stock' END AS kind, CASE WHEN l_linenumber % 2 = 1 THEN 'E' || l_linenumber ELSE p_brand END AS cell,
CASE WHEN l_tax <> 0 AND l_discount <> 0 THEN CAST(l_quantity AS BIGINT) END AS value, CASE WHEN l_tax = 0 THEN 'blank' WHEN l_discount = 0 THEN 'rejected' ELSE 'reported' END AS status FROM lineitem JOIN part ON l_partkey = p_partkey""")
def jsonl_aggregate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested returns as rows of cells: a blank stays blank, what is no whole number is refused."""
    d = returns(spark, sf_dir).select(F.from_json("line", RETURN).alias("r")).select("r.*")
    cell = lambda kind, name: lambda x: F.struct(F.lit(kind).alias("kind"), x[name].alias("cell"), x.value.alias("raw"))
    x = d.select("id", F.explode(F.concat(F.transform("observations", cell("observation", "element")), F.transform("stock", cell("stock", "commodity")))).alias("x")).select("id", "x.*")
    value = fn.strict_count(F.col("raw"))
    return x.select("id", "kind", "cell", value.alias("value"), F.when(F.col("raw").isNull(), "blank").when(value.isNull(), "rejected").otherwise("reported").alias("status"))


def _codes(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(code)) for code, c in rules)))


@query("aggregate_validation", """WITH c AS (SELECT l_orderkey AS id, o_orderdate AS starts, l_shipdate AS ends, l_linenumber AS line, l_partkey % 12 AS element, l_quantity - 2 AS value, l_discount * 100 AS positive, l_tax * 100 AS done, count(*) OVER (PARTITION BY l_orderkey, l_partkey % 12) AS same FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT id, line, unnest([CASE WHEN element >= 10 THEN 'unknown_element' END, CASE WHEN value < 0 THEN 'negative_value' END, CASE WHEN same > 1 THEN 'duplicate_cell' END, CASE WHEN round(positive) > round(done) THEN 'positive_exceeds_done' END, CASE WHEN ends < starts THEN 'period_reversed' END,
CASE WHEN extract(isodow FROM starts) <> 1 THEN 'week_not_monday' END, CASE WHEN value > date_diff('day', starts, ends) + 1 AND ends >= starts THEN 'days_out_exceed_period' END]) AS code FROM c) SELECT * FROM x WHERE code IS NOT NULL""")
def aggregate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue of every cell of a return, a row each."""
    l, o = bind.table(spark, sf_dir, "lineitem"), bind.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("starts"))
    c = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("l_orderkey").alias("id"), "starts", F.col("l_shipdate").cast("date").alias("ends"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 12).alias("element"), (F.col("l_quantity") - 2).alias("value"), F.round(F.col("l_discount") * 100).alias("positive"), F.round(F.col("l_tax") * 100).alias("done"))
    c = c.withColumn("same", F.count("*").over(Window.partitionBy("id", "element")))
    days = F.date_diff("ends", "starts") + 1
    found = _codes(("unknown_element", F.col("element") >= 10), ("negative_value", F.col("value") < 0), ("duplicate_cell", F.col("same") > 1), ("positive_exceeds_done", F.col("positive") > F.col("done")), ("period_reversed", F.col("ends") < F.col("starts")), ("week_not_monday", F.weekday("starts") != 0), ("days_out_exceed_period", (F.col("value") > days) & (F.col("ends") >= F.col("starts"))))
    return c.select("id", "line", F.explode(found).alias("code"))


@query("issue_ledger", """WITH v AS (SELECT l_orderkey AS id, l_linenumber AS line, l_returnflag = 'N' AND l_linestatus = 'F' AS a, l_quantity > 45 AS b, l_tax = 0 AS c, l_shipdate < o_orderdate AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
i AS (SELECT id, line, a OR d AS blocked, unnest([CASE WHEN a THEN 'not_done_with_result:error' END, CASE WHEN b THEN 'value_out_of_bounds:warning' END, CASE WHEN c THEN 'drug_name_missing:warning' END, CASE WHEN d THEN 'date_before_visit:error' END]) AS x FROM v) SELECT id, line, split_part(x, ':', 1) AS code, split_part(x, ':', 2) AS severity, CASE WHEN blocked THEN 'quarantined' ELSE 'loaded' END AS disposition FROM i WHERE x IS NOT NULL""")
def issue_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each issue of each row, with what became of the row."""
    l, o = bind.table(spark, sf_dir, "lineitem"), bind.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    found = _codes(("not_done_with_result:error", (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")), ("value_out_of_bounds:warning", F.col("l_quantity") > 45), ("drug_name_missing:warning", F.col("l_tax") == 0), ("date_before_visit:error", F.col("l_shipdate") < F.col("o_orderdate")))
    r = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), found.alias("found"))
    blocked = F.exists("found", lambda x: x.endswith(":error"))
    x = r.select("id", "line", blocked.alias("blocked"), F.explode("found").alias("x"))
    return x.select("id", "line", F.split_part("x", F.lit(":"), F.lit(1)).alias("code"), F.split_part("x", F.lit(":"), F.lit(2)).alias("severity"), F.when(F.col("blocked"), "quarantined").otherwise("loaded").alias("disposition"))


@query("batch_idempotency", """WITH b AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS batch, sha256(count(*) || '|' || CAST(sum(o_orderkey) AS BIGINT)) AS checksum FROM orders GROUP BY 1), s AS (SELECT batch, checksum, 1 AS attempt FROM b UNION ALL SELECT batch, checksum, 2 FROM b WHERE extract(month FROM batch) % 2 = 0)
SELECT batch, attempt, checksum, CASE WHEN row_number() OVER w = 1 THEN 'imported' ELSE 'already_imported' END AS outcome, first_value(attempt) OVER w AS counters_of FROM s WINDOW w AS (PARTITION BY checksum ORDER BY batch, attempt)""")
def batch_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An artefact whose checksum is known gives the counters of the batch that imported it."""
    b = bind.table(spark, sf_dir, "orders").groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("batch")).agg(F.sha2(F.concat_ws("|", F.count("*"), F.sum("o_orderkey")), 256).alias("checksum"))
    s = b.withColumn("attempt", F.lit(1)).union(b.where(F.month("batch") % 2 == 0).withColumn("attempt", F.lit(2)))
    w = Window.partitionBy("checksum").orderBy("batch", "attempt")
    return s.select("batch", "attempt", "checksum", F.when(F.row_number().over(w) == 1, "imported").otherwise("already_imported").alias("outcome"), F.first("attempt").over(w).alias("counters_of"))


@query("upserted_rows", """WITH cur AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 2 = 0)
SELECT k, coalesce(new.v, cur.v) AS v, CASE WHEN cur.v IS NOT NULL AND new.v IS NOT NULL AND cur.v <> new.v THEN 2 ELSE 1 END AS revision FROM cur FULL JOIN new USING (k)""")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after a load: new rows inserted, changed ones under the next revision, equal ones as they were."""
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    o = bind.table(spark, sf_dir, "orders")
    stored = o.where(k % 3 != 0).select(k.alias("k"), v.alias("v"), F.lit(1).alias("revision"))
    return merged(stored, o.where(k % 2 == 0).select(k.alias("k"), F.when(k % 5 == 0, v + 1).otherwise(v).alias("v")), "k", ["v"])


def merged(stored: DataFrame, load: DataFrame, key: str, values: list[str]) -> DataFrame:
    """stored (key, values, revision) after a load (key, values), a row a key in either; loading the same rows again changes nothing."""
    n = load.select(key, *(F.col(c).alias(f"new_{c}") for c in values), F.lit(True).alias("loaded"))
    m = stored.withColumn("held", F.lit(True)).join(n, key, "full")
    differs = F.col("held") & F.col("loaded") & ~F.struct(*values).eqNullSafe(F.struct(*(F.col(f"new_{c}").alias(c) for c in values)))
    return m.select(key, *(F.when(F.col("loaded"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in values), (F.coalesce("revision", F.lit(1)) + F.when(differs, 1).otherwise(0)).alias("revision"))


@query("pulled_submissions", f"""WITH {bind.CTES}, p AS (SELECT o_orderkey % 40 AS org_unit, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderkey % 6 AS element, o_totalprice AS value FROM orders)
SELECT facility_id, period, count(*) AS cells, count(*) FILTER (facility_id IS NULL) AS rejected FROM p LEFT JOIN facility ON facility_id = org_unit AND is_active GROUP BY 1, 2""")
def pulled_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pulled values by facility and period; those of units without a facility are counted as rejected."""
    p = bind.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40).alias("org_unit"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("period"))
    f = bind.facilities(spark, sf_dir).where("is_active").select("facility_id")
    return p.join(f, p.org_unit == f.facility_id, "left").groupBy("facility_id", "period").agg(F.count("*").alias("cells"), F.count_if(F.col("facility_id").isNull()).alias("rejected"))


@query("live_totals", """WITH v AS (SELECT user_id % 20 AS facility, event_type AS element, user_id % 3 AS category, CAST(ts AS DATE) AS period, CAST(floor(value) AS BIGINT) AS value, row_number() OVER (PARTITION BY user_id % 20, event_type, user_id % 3, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT e.element, CAST(sum(v.value) AS BIGINT) AS total, count(v.value) AS cells FROM (SELECT DISTINCT event_type AS element FROM events UNION ALL SELECT 'never_reported') e LEFT JOIN v ON v.element = e.element AND n = 1 GROUP BY 1""")
def live_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last update of each cell, summed by element; an element that nobody reported has no total."""
    e = bind.table(spark, sf_dir, "events")
    cells = e.groupBy((F.col("user_id") % 20).alias("facility"), F.col("event_type").alias("element"), (F.col("user_id") % 3).alias("category"), F.col("ts").cast("date").alias("period")).agg(F.max_by(F.floor("value"), F.struct("ts", "event_id")).alias("value"))
    t = cells.groupBy("element").agg(F.sum("value").alias("total"), F.count("value").alias("cells"))
    every = e.select(F.col("event_type").alias("element")).distinct().union(spark.range(1).select(F.lit("never_reported")))
    return every.join(t, "element", "left").select("element", "total", F.coalesce("cells", F.lit(0)).alias("cells"))


@query("residence_resolution", f"""WITH {bind.CTES}, r AS (SELECT c_custkey AS person, CASE c_custkey % 4 WHEN 0 THEN ' nation ' || c_nationkey WHEN 1 THEN 'NATION_' || c_nationkey WHEN 2 THEN 'Nation-' || (c_nationkey + 20) ELSE NULL END AS raw FROM customer)
SELECT person, district_id, CASE WHEN raw IS NULL THEN 'not_recorded' WHEN district_id IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN district_id IS NULL THEN raw END AS retained FROM r LEFT JOIN district ON replace(district_name, '_', ' ') = trim(regexp_replace(upper(raw), '[^A-Z0-9]+', ' ', 'g'))""")
def residence_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts by normalised name; text that names none is kept."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" nation "), n)).when(k % 4 == 1, F.concat(F.lit("NATION_"), n)).when(k % 4 == 2, F.concat(F.lit("Nation-"), n + 20))
    r = bind.table(spark, sf_dir, "customer").select(k.alias("person"), raw.alias("raw")).withColumn("name", fn.place_name(F.col("raw")))
    d = bind.districts(spark, sf_dir).select("district_id", fn.place_name(F.col("district_name")).alias("name"))
    found = F.col("district_id").isNotNull()
    return r.join(d, "name", "left").select("person", "district_id", F.when(F.col("raw").isNull(), "not_recorded").when(found, "resolved").otherwise("unresolved").alias("status"), F.when(~found, F.col("raw")).alias("retained"))


def phone(raw: Column) -> Column:
    """256 and nine digits, or empty."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    local = F.when(digits.rlike("^256[0-9]{9}$"), F.substring(digits, 4, 9)).when(digits.rlike("^0[0-9]{9}$"), F.substring(digits, 2, 9)).when(digits.rlike("^[0-9]{9}$"), digits)
    return F.coalesce(F.concat(F.lit("256"), local), F.lit(""))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The keyed hash of a text as hex, from two plain ones."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in key)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


#: The key of the bound tables; a deployment passes its own.
TEST_KEY = b"key-of-the-tests"
_PAD = {x: "".join(f"\\x{b ^ x:02X}" for b in TEST_KEY.ljust(64, b"\0")) for x in (0x36, 0x5C)}
_PHONE = """ph AS (SELECT c_custkey AS person, CASE c_custkey % 4 WHEN 0 THEN '+256 7' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 1 THEN '07' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') WHEN 2 THEN '7' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') ELSE 'none' END AS raw, CASE WHEN c_custkey % 4 = 3 THEN '' ELSE '2567' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone FROM customer)"""


@query("linkage_tokens", f"WITH {_PHONE} SELECT person, phone, CASE WHEN phone <> '' THEN sha256('{_PAD[0x5C]}'::BLOB || unhex(sha256('{_PAD[0x36]}'::BLOB || encode('linkage|phone|' || phone)))) END AS token FROM ph")
def linkage_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed tokens of normalised phone numbers; nothing to link without one."""
    k = F.col("c_custkey")
    tail = F.lpad(k.cast("string"), 8, "0")
    raw = F.when(k % 4 == 0, F.concat(F.lit("+256 7"), tail)).when(k % 4 == 1, F.concat(F.lit("07"), tail)).when(k % 4 == 2, F.concat(F.lit("7"), tail)).otherwise("none")
    p = bind.table(spark, sf_dir, "customer").select(k.alias("person"), phone(raw).alias("phone"))
    return p.withColumn("token", F.when(F.col("phone") != "", hmac_sha256(TEST_KEY, F.concat(F.lit("linkage|phone|"), F.col("phone")))))


@query("test_options", """SELECT l_orderkey AS id, l_linenumber AS line, CASE l_linenumber % 4 WHEN 0 THEN 'rdt' WHEN 1 THEN 'microscopy' WHEN 2 THEN 'microscopy' END AS method, CASE l_returnflag WHEN 'R' THEN 'positive' WHEN 'A' THEN 'negative' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'not_recorded' ELSE 'unmapped' END END AS outcome FROM lineitem""")
def test_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of forms under one spelling: dashes and case folded, methods and outcomes mapped, unknown ones told apart from blanks."""
    n = F.col("l_linenumber")
    method = F.element_at(F.array(F.lit("Malaria RDT – P.f"), F.lit("MICROSCOPY"), F.lit("Malaria ‑ BS"), F.lit("other")), (n % 4 + 1).cast("int"))
    result = F.when(F.col("l_returnflag") == "R", " Positive ").when(F.col("l_returnflag") == "A", "NEGATIVE").when(n % 2 == 0, "").otherwise("invalid strip")
    d = bind.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), n.alias("line"), method.alias("m"), result.alias("r"))
    return d.select("id", "line", fn.test_method(F.col("m")).alias("method"), fn.test_outcome(F.col("r")).alias("outcome"))


@query("shared_parent_groups", "SELECT l_orderkey AS parent, count(*) AS tests, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS members FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1 HAVING count(*) >= 2")
def shared_parent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two or more tests under one visit."""
    t = bind.table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    g = t.groupBy(F.col("l_orderkey").alias("parent")).agg(F.count("*").alias("tests"), F.array_sort(F.collect_list("l_linenumber")).alias("m")).where("tests >= 2")
    return g.select("parent", "tests", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


@query("medicine_visits", "SELECT l_orderkey AS parent, l_linenumber AS line, CASE WHEN o_orderkey IS NOT NULL THEN o_orderkey END AS visit, CASE WHEN o_orderkey IS NULL THEN 'unlinked' ELSE 'linked' END AS status FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND l_orderkey % 13 <> 0 WHERE l_tax <> 0")
def medicine_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medicines with the visit of their parent id and the same person; a parent of another person links nothing."""
    o = bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("visit"), F.col("o_custkey").alias("person"))
    m = bind.table(spark, sf_dir, "lineitem").where("l_tax <> 0").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("line"))
    owner = bind.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 13 == 0, -1 - F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("taker"))
    m = m.join(owner, m.parent == owner.k)
    got = m.join(o, (m.parent == o.visit) & (m.taker == o.person), "left")
    return got.select("parent", "line", "visit", F.when(F.col("visit").isNull(), "unlinked").otherwise("linked").alias("status"))


@query("source_profile", "SELECT source, lang, count(*) AS rows, count(text) AS texts, CAST(sum(strlen(text)) AS BIGINT) AS bytes, min(n_chars) AS least, max(n_chars) AS most, CAST(sum(CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM documents GROUP BY ALL")
def source_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bytes, extents and a checksum, whatever the order of rows, of each source and language."""
    d = bind.table(spark, sf_dir, "documents")
    return d.groupBy("source", "lang").agg(F.count("*").alias("rows"), F.count("text").alias("texts"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.sum(F.conv(F.substring(F.sha2("text", 256), 1, 8), 16, 10).cast("long")).alias("checksum"))


@query("geojson_features", f"""WITH {bind.CTES}, u AS (SELECT district_id AS id, district_name AS name, region_id * 10.0 AS x, (district_id % 10) * 10.0 AS y FROM district) SELECT id, '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[[' || x || ',' || y || '],[' || (x + 10) || ',' || y || '],[' || (x + 10) || ',' || (y + 10) || '],[' || x || ',' || (y + 10) || '],[' || x || ',' || y || ']]]}},"properties":{{"id":' || id || ',"name":"' || name || '"}}}}' AS feature, 100.0::DOUBLE AS area FROM u""")
def geojson_features(spark: SparkSession, sf_dir: str, most: int = 400) -> DataFrame:
    """Features as GeoJSON texts with their planar area; a request that matches more than `most` is refused, not cut."""
    u = bind.districts(spark, sf_dir)
    if u.count() > most:
        raise ValueError(f"more than {most} features match; narrow the request")
    x, y = F.col("region_id") * F.lit(10.0), (F.col("district_id") % 10) * F.lit(10.0)
    ring = F.array(*(F.array(a, b) for a, b in ((x, y), (x + 10, y), (x + 10, y + 10), (x, y + 10), (x, y))))
    shape = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(F.col("district_id").alias("id"), F.col("district_name").alias("name")).alias("properties"))
    points = F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return u.select(F.col("district_id").alias("id"), F.to_json(shape).alias("feature"), F.abs(fn.ring_area(points)).alias("area"))

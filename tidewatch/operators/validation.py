"""Validators of inbound rows: visits and aggregate returns as JSON texts, judged by every rule of their contract.

A text is parsed once, as a variant; each rule is an expression over it, lists are judged element by element with their
paths. Rules that exclude each other are one CASE in their order; a row gives all its issues, and a row with an error is
not loaded. Nothing is repaired or guessed: an absent value takes its default, an unknown one is an issue.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.plans.registry import query
from tidewatch.sources import bind

#: Codes that a visit may carry, by field.
CODES = {
    "sex": ("m", "male", "f", "female", "unknown"),
    "date_source": ("source_supplied", "register_heading", "entry_date"),
    "patient_category": ("n", "national", "r", "refugee", "f", "foreigner", "unknown"),
    "attendance_type": ("new", "re_attendance", "unknown"),
    "fever_present": ("yes", "no", "unknown"),
    "method": ("rdt", "microscopy", "not_done", "unknown"),
    "result": ("positive", "negative", "unknown", "not_recorded"),
    "direction": ("inbound", "outbound"),
}
#: The largest age of each unit.
AGE_BOUNDS = {"years": 130, "months": 11, "days": 30}
FACTORS = ("units_per_dose", "doses_per_day", "days")
ISSUE = "array<struct<code: string, path: string, severity: string>>"
#: Codes that do not keep a row from being loaded.
WARNINGS = ("diagnosis_blank", "prescription_blank", "referral_number_missing", "value_not_numeric", "stock_value_not_numeric", "laboratory_value_not_numeric")


def issue(code: str | Column, path: Column | str) -> Column:
    code = F.lit(code) if isinstance(code, str) else code
    path = F.lit(path) if isinstance(path, str) else path
    return F.struct(code.alias("code"), path.alias("path"), F.when(code.isin(*WARNINGS), "warning").otherwise("error").alias("severity"))


def when(condition: Column, code: str | Column, path: Column | str) -> Column:
    """One issue where the condition holds, else none."""
    return F.when(condition, F.array(issue(code, path))).otherwise(F.array().cast(ISSUE))


def text(v: Column, path: str) -> Column:
    """A member as text, null if it is absent, null or empty."""
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, or what else a variant is; null if there is none. A schema is only asked of what is neither."""
    whole = lambda t: F.try_variant_get(v, "$", t).isNotNull()
    return F.when(whole("map<string,variant>"), "OBJECT").when(whole("array<variant>"), "ARRAY").otherwise(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))


def folded(value: Column) -> Column:
    return F.lower(F.trim(value))


def unknown(value: Column, field: str) -> Column:
    """Whether a folded value is none of its field's codes; an absent one is not."""
    return value.isNotNull() & ~value.isin(*CODES[field])


def _element(*members: str) -> Callable[[Column], Column]:
    """An element of a list as a struct: its kind, itself as text, and its members."""
    return lambda e: F.struct(kind(e).alias("kind"), F.try_variant_get(e, "$", "string").alias("self"), *(text(e, f"$.{m}").alias(m) for m in members))


def _blank(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) == ""


def _test(e: Column, path: Column) -> Column:
    method, result = folded(e.method), folded(e.result)
    both = F.coalesce((method == "not_done") & result.isin("positive", "negative"), F.lit(False))
    found = F.concat(when(unknown(method, "method"), "unrecognised_code", under(path, "method")), when(unknown(result, "result"), "unrecognised_code", under(path, "result")), when(both, "result_without_a_test", path))
    return F.when(e.kind != "OBJECT", F.array(issue("test_not_an_object", path))).otherwise(found)


def _diagnosis(e: Column, path: Column) -> Column:
    return when(_blank(e["self"]), "diagnosis_blank", path)


def _prescription(e: Column, path: Column) -> Column:
    def factor(name: str) -> Column:
        number = e[name].try_cast("double")
        return F.concat(when(e[name].isNotNull() & number.isNull(), "prescription_factor_unparsable", under(path, name)), when(F.coalesce(number <= 0, F.lit(False)), "prescription_factor_not_positive", under(path, name)))

    whole = F.when(_blank(e.text), F.array(issue("prescription_blank", path))).otherwise(F.concat(*map(factor, FACTORS)))
    return F.when(e.kind == "STRING", F.array().cast(ISSUE)).when(e.kind != "OBJECT", F.array(issue("prescription_not_an_object", path))).otherwise(whole)


def _referral(e: Column, path: Column) -> Column:
    rest = F.when(_blank(e.number), F.array(issue("referral_number_missing", path))).otherwise(when(unknown(folded(e.direction), "direction"), "unrecognised_code", under(path, "direction")))
    return F.when(e.kind != "OBJECT", F.array(issue("referral_not_an_object", path))).otherwise(rest)


#: Blocks of a visit: what an element holds and the rule of an element.
BLOCKS = {"tests": (("method", "result"), _test), "diagnoses": ((), _diagnosis), "prescriptions": (("text", *FACTORS), _prescription), "referrals": (("number", "direction"), _referral)}
CODED = ("date_source", "patient_category", "attendance_type", "fever_present")


def under(path: Column, field: str) -> Column:
    return F.concat(path, F.lit(f".{field}"))


def visit_issues(lines: DataFrame, today: Column) -> DataFrame:
    """lines (line: JSON of a visit) with all their issues. Without a usable date nothing but its sex is judged further.

    Members are taken out of the parsed text once, as columns; faults are columns too, so no rule is evaluated twice.
    """
    own, v = lines.columns, F.col("v")
    d = lines.withColumn("v", F.try_parse_json("line"))
    d = d.withColumns({"v_date": text(v, "$.encounter_date"), "v_value": text(v, "$.age.value"), "v_unit": folded(text(v, "$.age.unit"))} | {f"v_{c}": folded(text(v, f"$.{c}")) for c in ("sex", *CODED)} | {f"b_{b}": F.try_variant_get(v, f"$.{b}", "variant") for b in BLOCKS})
    d = d.withColumns({"day": F.when(F.col("v_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("v_date", "yyyy-MM-dd")), "number": F.col("v_value").try_cast("bigint"), "most": F.element_at(F.create_map(*(F.lit(x) for kv in AGE_BOUNDS.items() for x in kv)), F.col("v_unit"))} | {f"k_{b}": F.when(F.col(f"b_{b}").isNotNull(), kind(F.col(f"b_{b}"))) for b in BLOCKS})
    value, unit = F.col("v_value"), F.col("v_unit")
    date = F.when(F.col("v_date").isNull(), "encounter_date_missing").when(F.col("day").isNull(), "encounter_date_unparsable").when(F.col("day") > today, "encounter_date_in_future")
    age = F.when(value.isNull() & unit.isNull(), None).when(value.isNull() | unit.isNull(), "age_pair_incomplete").when(F.col("number").isNull(), "age_value_unparsable").when(F.col("most").isNull(), "unrecognised_code").when(F.col("number") < 0, "age_negative").when(F.col("number") > F.col("most"), "age_outside_unit_bounds")
    items = {f"i_{b}": F.when(F.col(f"k_{b}") == "ARRAY", F.transform(F.try_variant_get(f"b_{b}", "$", "array<variant>"), _element(*members))) for b, (members, _) in BLOCKS.items()}
    d = d.withColumns({"f_date": date, "f_age": age} | items)

    def block(b: str) -> Column:
        k = F.col(f"k_{b}")
        absent = F.coalesce(k.isNull() | (k == "VOID") | ((k == "STRING") & (F.try_variant_get(f"b_{b}", "$", "string") == "")), F.lit(True))
        judged = F.flatten(F.transform(f"i_{b}", lambda e, i: BLOCKS[b][1](e, F.concat(F.lit(f"{b}["), i, F.lit("]")))))
        return F.when(absent, F.array().cast(ISSUE)).when(k != "ARRAY", F.array(issue(f"{b}_not_a_list", b))).otherwise(judged)

    at_age = F.when(F.col("f_age") == "age_pair_incomplete", "age").when(F.col("f_age") == "unrecognised_code", "age.unit").otherwise("age.value")
    head = F.concat(when(F.col("f_date").isNotNull(), F.col("f_date"), "encounter_date"), when(unknown(F.col("v_sex"), "sex"), "unrecognised_code", "sex"))
    rest = F.concat(*(when(unknown(F.col(f"v_{c}"), c), "unrecognised_code", c) for c in CODED), when(F.col("f_age").isNotNull(), F.col("f_age"), at_age), *map(block, BLOCKS))
    whole = F.when(v.isNull(), F.array(issue("malformed_json", "$"))).when(F.col("f_date").isNotNull(), head).otherwise(F.concat(head, rest))
    return d.select(*own, whole.alias("issues"))


#: What the bound rows hold by their key modulo 32: a member and its value, and the issue that it makes (none: it is sound).
SEEDED: dict[int, tuple[str, object, str, str]] = {
    1: ("encounter_date", None, "encounter_date_missing", "encounter_date"),
    2: ("encounter_date", "1998-02-30", "encounter_date_unparsable", "encounter_date"),
    3: ("encounter_date", "12/03/1998", "encounter_date_unparsable", "encounter_date"),
    4: ("sex", "X", "unrecognised_code", "sex"),
    5: ("date_source", "guess", "unrecognised_code", "date_source"),
    6: ("patient_category", "tourist", "unrecognised_code", "patient_category"),
    7: ("attendance_type", " NEW ", "", ""),
    8: ("fever_present", "maybe", "unrecognised_code", "fever_present"),
    9: ("tests", "none", "tests_not_a_list", "tests"),
    10: ("tests", [1], "test_not_an_object", "tests[0]"),
    11: ("tests", [{"method": "rdt", "result": "negative"}, {"method": "pcr"}], "unrecognised_code", "tests[1].method"),
    12: ("tests", [{"method": "rdt", "result": "+"}], "unrecognised_code", "tests[0].result"),
    13: ("tests", [{"method": "Not_Done", "result": "positive"}], "result_without_a_test", "tests[0]"),
    14: ("diagnoses", {"a": 1}, "diagnoses_not_a_list", "diagnoses"),
    15: ("diagnoses", ["fever", "  "], "diagnosis_blank", "diagnoses[1]"),
    16: ("prescriptions", 7, "prescriptions_not_a_list", "prescriptions"),
    17: ("prescriptions", ["tablets", [2]], "prescription_not_an_object", "prescriptions[1]"),
    18: ("prescriptions", [{"text": " "}], "prescription_blank", "prescriptions[0]"),
    19: ("prescriptions", [{"text": "x", "days": "three"}], "prescription_factor_unparsable", "prescriptions[0].days"),
    20: ("prescriptions", [{"text": "x", "doses_per_day": -1}], "prescription_factor_not_positive", "prescriptions[0].doses_per_day"),
    21: ("referrals", "away", "referrals_not_a_list", "referrals"),
    22: ("referrals", ["out"], "referral_not_an_object", "referrals[0]"),
    23: ("referrals", [{"direction": "outbound"}], "referral_number_missing", "referrals[0]"),
    24: ("referrals", [{"number": "r1", "direction": "up"}], "unrecognised_code", "referrals[0].direction"),
    25: ("tests", "", "", ""),
    26: ("encounter_date", "2999-01-01", "encounter_date_in_future", "encounter_date"),
}


def visit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, line: visits as JSON texts. Ages come from the balances of customers, so some are negative or above their unit."""
    o, c = bind.table(spark, sf_dir, "orders"), bind.table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*map(F.lit, AGE_BOUNDS)), (F.col("c_custkey") % 3 + 1).cast("int"))
    age = F.concat(F.lit('{"value":'), F.floor(F.col("c_acctbal") / 100).cast("string"), F.lit(',"unit":"'), unit, F.lit('"}'))
    day = F.concat(F.lit('"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('"'))
    seed = F.create_map(*(x for m, (f, value, _, _) in SEEDED.items() for x in (F.lit(m), F.lit(f'"{f}":{json.dumps(value)}'))))
    m = (k % 32).cast("int")
    dated = F.when(m.isin(*(i for i, s in SEEDED.items() if s[0] == "encounter_date")), F.lit('"sex":"f"')).otherwise(F.concat(F.lit('"encounter_date":'), day))
    body = F.concat_ws(",", dated, F.concat(F.lit('"age":'), age), F.element_at(seed, m))
    line = F.concat(F.lit("{"), body, F.when(k % 2003 == 0, F.lit(",,")).otherwise(F.lit("")), F.lit("}"))
    return o.join(c, o.o_custkey == c.c_custkey).select(k.alias("id"), line.alias("line"))


_SEED = "sd(m, code, path) AS (VALUES " + ", ".join(f"({m}, '{c}', '{p}')" for m, (_, _, c, p) in SEEDED.items() if c) + ")"
_AGES = """ages AS (SELECT o_orderkey AS id, floor(c_acctbal / 100) AS a, [130, 11, 30][c_custkey % 3 + 1] AS most FROM orders JOIN customer ON o_custkey = c_custkey)"""
_DATED = ", ".join(str(i) for i, s in SEEDED.items() if s[0] == "encounter_date")
_VISIT_ISSUES = f"""{_SEED}, {_AGES}, vi AS (SELECT id, 'malformed_json' AS code, '$' AS path FROM ages WHERE id % 2003 = 0 UNION ALL SELECT id, code, path FROM ages JOIN sd ON id % 32 = m WHERE id % 2003 <> 0
UNION ALL SELECT id, CASE WHEN a < 0 THEN 'age_negative' ELSE 'age_outside_unit_bounds' END, 'age.value' FROM ages WHERE (a < 0 OR a > most) AND id % 2003 <> 0 AND id % 32 NOT IN ({_DATED})),
vs AS (SELECT *, CASE WHEN code IN ({", ".join(f"'{w}'" for w in WARNINGS)}) THEN 'warning' ELSE 'error' END AS severity FROM vi)"""


@query("visit_issues", f"WITH {_VISIT_ISSUES} SELECT id, code, path, severity FROM vs")
def visit_issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue of every visit, with the path of what it is about."""
    d = visit_issues(visit_lines(spark, sf_dir), F.to_date(F.lit("2100-01-01")))
    return d.select("id", F.explode("issues").alias("i")).select("id", "i.*")


@query("visit_outcomes", f"WITH {_VISIT_ISSUES}, s AS (SELECT id, count(*) FILTER (severity = 'error') AS errors, count(*) AS issues FROM vs GROUP BY 1) SELECT CASE WHEN coalesce(errors, 0) > 0 THEN 'quarantined' WHEN coalesce(issues, 0) > 0 THEN 'loaded_with_warnings' ELSE 'loaded' END AS outcome, count(*) AS visits, CAST(sum(coalesce(issues, 0)) AS BIGINT) AS issues FROM ages LEFT JOIN s USING (id) GROUP BY 1")
def visit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of all visits, those without an issue too."""
    d = visit_issues(visit_lines(spark, sf_dir), F.to_date(F.lit("2100-01-01"))).select(F.col("issues").alias("i"))
    outcome = F.when(F.exists("i", lambda x: x.severity == "error"), "quarantined").when(F.size("i") > 0, "loaded_with_warnings").otherwise("loaded")
    return d.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("visits"), F.sum(F.size("i")).alias("issues"))


# Aggregate returns

#: The contract's limits of lengths.
LIMITS = {"period_label": 32, "source_reference": 128, "unit": 64}
BANDS, SEXES = ("under_5", "5_and_over", "unspecified"), ("male", "female", "unspecified")


class Form:
    """What a form prints: its period, elements (disaggregated or not), commodities, stock metrics, and whether it has tests."""

    def __init__(self, period: str, elements: dict[str, bool], commodities: tuple[str, ...], metrics: tuple[str, ...], tests: tuple[str, ...] = ()) -> None:
        self.period, self.elements, self.commodities, self.metrics, self.tests = period, elements, commodities, metrics, tests


TESTS = ("smear", "rapid")
FORMS = {
    "weekly": Form("week", {"cases": True, "deaths": False}, ("tablets", "kits"), ("on_hand", "days_out"), ()),
    "monthly": Form("month", {"cases": True, "attendance": True, "stays": False}, ("tablets", "kits", "nets"), ("on_hand", "days_out", "received"), TESTS),
}


def _printed() -> dict[str, dict[str, str]]:
    """What forms print, by block (and `metric`) and form|name: an observation is `split` or `whole`, or of the wrong block, a test is
    `on` its form or `off`."""
    out: dict[str, dict[str, str]] = {"observations": {}, "stock": {}, "metric": {}, "laboratory": {}}
    for name, f in FORMS.items():
        out["observations"] |= {f"{name}|{e}": "split" if split else "whole" for e, split in f.elements.items()} | {f"{name}|{e}": "wrong" for e in (*f.commodities, *TESTS)}
        out["stock"] |= {f"{name}|{e}": "on" for e in f.commodities}
        out["metric"] |= {f"{name}|{m}": "on" for m in f.metrics}
        out["laboratory"] |= {f"{name}|{e}": "on" if e in f.tests else "off" for e in TESTS}
    return out


def printed(block: str, name: str) -> Column:
    """What a name is to a block of its form (form), null if it is not printed there."""
    known = F.create_map(*(F.lit(x) for kv in _printed()[block].items() for x in kv))
    return F.try_element_at(known, F.concat_ws("|", "form", name))


def head_faults(r: DataFrame) -> DataFrame:
    """Returns (form, starts, ends, revision, period_label, source_reference, and cells: how many) with issues and stops: a form or
    period that is not sound stops everything else."""
    form, span = F.col("form"), F.date_diff("ends", "starts")
    week, month = form == "weekly", form == "monthly"
    stop = F.when(form.isNull() | ~form.isin(*FORMS), verdict("unknown_form", "form")).when(span < 0, verdict("period_reversed", "period_end")).when(week & (span != 6), verdict("period_is_not_a_week", "period_end")).when(week & (F.weekday("starts") != 0), verdict("week_does_not_start_on_monday", "period_start")).when(month & (F.dayofmonth("starts") != 1), verdict("month_does_not_start_on_the_first", "period_start")).when(month & (F.col("ends") != F.last_day("starts")), verdict("month_does_not_end_on_the_last_day", "period_end"))
    long = lambda c: F.when(F.length(c) > LIMITS[c], verdict("text_exceeds_contract_limit", c))
    rest = [F.when(F.col("revision") < 1, verdict("revision_not_positive", "revision")), long("period_label"), long("source_reference"), F.when(F.col("cells") == 0, verdict("submission_is_empty", "$"))]
    r = r.withColumn("stop", stop)
    return r.withColumns({"stops": F.col("stop").isNotNull(), "issues": F.array_compact(F.when(F.col("stop").isNotNull(), F.array("stop")).otherwise(F.array(*rest)))}).drop("stop")


def verdict(code: str, path: str) -> Column:
    """An issue whose code and path are fixed: one constant, so that a chain of rules stays small as generated code (the JVM does
    not compile methods above 8,000 bytes, and runs them many times slower)."""
    return F.struct(F.lit(code).alias("code"), F.lit(path).alias("path"), F.lit("warning" if code in WARNINGS else "error").alias("severity"))


def cell_faults(c: DataFrame) -> DataFrame:
    """Issues of cells (id, form, days, block, place, a row's members as texts; place is null if a return has no cells, and issues
    are those of the whole return, at one of its rows): id, code, path, severity. A cell's rules come in the form's order and
    the first one counts; a cell is a duplicate if a sound one before it has the same key.
    """
    block, e, band, sex = F.col("block"), F.col("element"), F.col("age_band"), F.col("sex")
    observation, item, laboratory = block == "observations", block == "stock", block == "laboratory"
    filled, done, positive = F.col("filled"), F.col("done"), F.col("positives")
    # What rules share is a column first.
    c = c.withColumns({
        "printed": F.when(observation, printed("observations", "element")).when(item, printed("stock", "element")).otherwise(printed("laboratory", "element")), "metric_printed": F.when(item, printed("metric", "metric")), "filled": F.coalesce(F.col("value"), F.lit("")) != "",
        "number": F.when(~laboratory, F.col("value").try_cast("double")), "done": F.when(laboratory, F.col("value").try_cast("bigint")), "positives": F.when(laboratory, F.col("positive").try_cast("bigint")),
    })
    what, number, unknown_element = F.col("printed"), F.col("number"), e.isNotNull() & F.col("printed").isNull()
    observed = F.when(what == "wrong", verdict("element_in_the_wrong_block", "element")).when(unknown_element, verdict("unknown_element", "element")).when(~band.isin(*BANDS), verdict("unknown_age_band", "age_band")).when((what == "split") & (band == "unspecified"), verdict("disaggregation_missing", "age_band")).when((what == "whole") & (band != "unspecified"), verdict("unexpected_disaggregation", "age_band")).when(~sex.isin(*SEXES), verdict("unknown_sex", "sex")).when(filled & number.isNull(), verdict("value_not_numeric", "value")).when(number < 0, verdict("value_negative", "value"))
    stocked = F.when(unknown_element, verdict("unknown_commodity", "commodity")).when(F.col("metric").isNotNull() & F.col("metric_printed").isNull(), verdict("unknown_stock_metric", "metric")).when(filled & number.isNull(), verdict("stock_value_not_numeric", "value")).when(number < 0, verdict("stock_value_negative", "value")).when(F.length("unit") > LIMITS["unit"], verdict("text_exceeds_contract_limit", "unit")).when((F.col("metric") == "days_out") & (number > F.col("days")), verdict("days_out_of_stock_exceeds_period", "value"))
    tested = F.when(unknown_element, verdict("unknown_laboratory_test", "test")).when(what == "off", verdict("laboratory_block_on_the_wrong_form", "")).when(done < 0, verdict("laboratory_value_negative", "done")).when(positive < 0, verdict("laboratory_value_negative", "positive")).when(filled & done.isNull(), verdict("laboratory_value_not_numeric", "done")).when((F.coalesce(F.col("positive"), F.lit("")) != "") & positive.isNull(), verdict("laboratory_value_not_numeric", "positive")).when(positive > done, verdict("more_positive_than_done", ""))
    key = F.when(observation, F.concat_ws("|", e, band, sex)).when(item, F.concat_ws("|", e, "metric")).otherwise(e)
    c = c.select("id", "block", "place", "issues", key.alias("key"), F.when(observation, observed).when(item, stocked).when(laboratory, tested).alias("fault"))
    c = c.withColumn("sound", F.col("place").isNotNull() & (F.col("fault").isNull() | (F.col("fault.severity") == "warning")))
    c = c.withColumn("twin", F.col("sound") & (F.row_number().over(Window.partitionBy("id", "block", "key", "sound").orderBy("place")) > 1))
    c = c.where(F.col("fault").isNotNull() | F.col("twin") | F.col("issues").isNotNull())
    name = F.when(observation, verdict("duplicate_cell", "element")).when(item, verdict("duplicate_stock_row", "commodity")).otherwise(verdict("duplicate_laboratory_row", "test"))

    def own(holds: Column, i: Column) -> Column:
        path = F.concat(block, F.lit("["), "place", F.lit("]"), F.when(i.path != "", F.concat(F.lit("."), i.path)).otherwise(""))
        return F.when(holds, F.array(F.struct(i.code.alias("code"), path.alias("path"), i.severity.alias("severity")))).otherwise(F.array().cast(ISSUE))

    found = F.concat(F.coalesce("issues", F.array().cast(ISSUE)), own(F.col("fault").isNotNull(), F.col("fault")), own(F.col("twin"), name))
    return c.select("id", F.explode(found).alias("i")).select("id", "i.*")


#: A cell of any block: members that its block has not are null.
CELL = "struct<element: string, age_band: string, sex: string, metric: string, value: string, unit: string, positive: string>"
RETURN = "id long, form string, starts date, ends date, revision int, period_label string, source_reference string, " + ", ".join(f"{b} array<{CELL}>" for b in ("observations", "stock", "laboratory"))


def return_issues(lines: DataFrame) -> DataFrame:
    """id, code, path, severity of aggregate returns (line: JSON). Lines may hold id, that of their return, too: where they are
    already parted by it, duplicates are told without another shuffle."""
    own = [F.col("id").alias("line_id")] if "id" in lines.columns else []
    r = lines.select(*own, F.from_json("line", RETURN).alias("r")).select(*(["line_id"] if own else []), "r.*")
    if own:
        r = r.drop("id").withColumnRenamed("line_id", "id")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    r = r.withColumns({"observed": size("observations"), "stocked": size("stock"), "tested": size("laboratory")})
    r = head_faults(r.withColumn("cells", F.col("observed") + F.col("stocked") + F.col("tested")))
    blocks = F.flatten(F.array(*(F.coalesce(b, F.array().cast(f"array<{CELL}>")) for b in ("observations", "stock", "laboratory"))))
    # All cells of a return in one array, the blocks one after another; without any it keeps one row, for its issues.
    c = r.select("id", "form", (F.date_diff("ends", "starts") + 1).alias("days"), "observed", "stocked", F.when(F.size("issues") > 0, F.col("issues")).alias("issues"), F.when(~F.col("stops"), blocks).alias("x"))
    c = c.select("id", "form", "days", "observed", "stocked", "issues", F.posexplode_outer("x").alias("at", "c"))
    at, observed, stocked = F.col("at"), F.col("observed"), F.col("stocked")
    block = F.when(at < observed, "observations").when(at < observed + stocked, "stock").when(at.isNotNull(), "laboratory")
    place = F.when(at < observed, at).when(at < observed + stocked, at - observed).otherwise(at - observed - stocked)
    return cell_faults(c.select("id", "form", "days", block.alias("block"), place.alias("place"), F.when(F.coalesce(at, F.lit(0)) == 0, F.col("issues")).alias("issues"), "c.*"))


def return_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, line: an order as a return, its lines as cells, by their numbers' remainder of 3: observations, stock and tests. Forms,
    elements, bands and metrics come from the lines' columns, so many do not fit."""
    o, l = bind.table(spark, sf_dir, "orders"), bind.table(spark, sf_dir, "lineitem")
    pick = lambda column, *values: F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))
    value = lambda x: F.when(x.t != 0, F.when(x.d == 0, F.lit("nil")).otherwise((x.q - 3).cast("int").cast("string"))).alias("value")
    # Lines travel as numbers; each becomes the one cell that it stands for afterwards.
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))
    g = l.select(F.col("l_orderkey").alias("id"), line.alias("x")).groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    cells = {
        "observations": (1, lambda x: F.struct(pick(x.p, "cases", "deaths", "attendance", "stays", "births", "tablets").alias("element"), pick(x.p, "under_5", "unspecified", "5_and_over", "unspecified", "under_5", "adult").alias("age_band"), pick(x.s, "male", "female", "unspecified", "x").alias("sex"), value(x))),
        "stock": (2, lambda x: F.struct(pick(x.p, "tablets", "kits", "nets", "soap").alias("element"), pick(x.s, "on_hand", "days_out", "received", "lost").alias("metric"), value(x), F.when(x.p % 50 == 0, F.repeat(F.lit("u"), 65)).alias("unit"))),
        "laboratory": (0, lambda x: F.struct(pick(x.p, "smear", "rapid", "culture").alias("element"), value(x), F.when(x.t != 0.05, F.floor(x.d * 100 * 3 - 2).cast("string")).otherwise(F.lit("few")).alias("positive"))),
    }
    of = lambda block: F.transform(F.filter("x", lambda x: x.n % 3 == cells[block][0]), cells[block][1]).alias(block)
    i, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    form = F.when(i % 101 == 0, "yearly").when(i % 2 == 0, "weekly").otherwise("monthly")
    starts = F.when(i % 7 == 0, day).when(i % 2 == 0, F.date_trunc("week", day).cast("date")).otherwise(F.trunc(day, "month"))
    ends = F.when(i % 11 == 0, F.date_sub(starts, 1)).when(i % 13 == 0, F.date_add(starts, 9)).when(i % 2 == 0, F.date_add(starts, 6)).otherwise(F.last_day(starts))
    head = o.select(i.alias("id"), form.alias("form"), starts.alias("starts"), ends.alias("ends"), (i % 17).cast("int").alias("revision"), F.when(i % 19 == 0, F.repeat(F.lit("p"), 33)).alias("period_label"), F.when(i % 23 == 0, F.repeat(F.lit("s"), 129)).alias("source_reference"))
    every = head.join(g, "id", "left").select(*head.columns, *map(of, cells))
    return every.select("id", F.to_json(F.struct(*every.columns)).alias("line"))


def _pick(column: str, *values: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{column} % {len(values)} + 1]"


_W = ", ".join(f"'{w}'" for w in WARNINGS)
_RETURNS = f"""h0 AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 101 = 0 THEN 'yearly' WHEN o_orderkey % 2 = 0 THEN 'weekly' ELSE 'monthly' END AS form, CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 2 = 0 THEN CAST(date_trunc('week', o_orderdate) AS DATE) ELSE CAST(date_trunc('month', o_orderdate) AS DATE) END AS starts FROM orders),
h AS (SELECT *, CASE WHEN id % 11 = 0 THEN starts - 1 WHEN id % 13 = 0 THEN starts + 9 WHEN id % 2 = 0 THEN starts + 6 ELSE last_day(starts) END AS ends FROM h0),
hf AS (SELECT *, CASE WHEN form = 'yearly' THEN 'unknown_form' WHEN ends < starts THEN 'period_reversed' WHEN form = 'weekly' AND ends - starts <> 6 THEN 'period_is_not_a_week' WHEN form = 'weekly' AND extract(isodow FROM starts) <> 1 THEN 'week_does_not_start_on_monday' WHEN form = 'monthly' AND extract(day FROM starts) <> 1 THEN 'month_does_not_start_on_the_first' WHEN form = 'monthly' AND ends <> last_day(starts) THEN 'month_does_not_end_on_the_last_day' END AS stop FROM h),
cl AS (SELECT l_orderkey AS id, l_linenumber % 3 AS b, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax) - 1 AS place, l_partkey AS p, {_pick('l_partkey', 'cases', 'deaths', 'attendance', 'stays', 'births', 'tablets')} AS oe, {_pick('l_partkey', 'under_5', 'unspecified', '5_and_over', 'unspecified', 'under_5', 'adult')} AS band, {_pick('l_suppkey', 'male', 'female', 'unspecified', 'x')} AS sex,
  {_pick('l_partkey', 'tablets', 'kits', 'nets', 'soap')} AS se, {_pick('l_suppkey', 'on_hand', 'days_out', 'received', 'lost')} AS metric, {_pick('l_partkey', 'smear', 'rapid', 'culture')} AS le, CASE WHEN l_tax = 0 THEN 'blank' WHEN l_discount = 0 THEN 'nil' ELSE 'n' END AS vk, CAST(l_quantity - 3 AS INTEGER) AS v, l_tax <> 0.05 AS pk, CAST(floor(l_discount * 100 * 3 - 2) AS BIGINT) AS pv FROM lineitem),
cf AS (SELECT cl.*, form, starts, ends, CASE b WHEN 1 THEN CASE WHEN oe = 'tablets' THEN 'element_in_the_wrong_block' WHEN NOT (form = 'weekly' AND oe IN ('cases', 'deaths') OR form = 'monthly' AND oe IN ('cases', 'attendance', 'stays')) THEN 'unknown_element' WHEN band = 'adult' THEN 'unknown_age_band' WHEN oe IN ('cases', 'attendance') AND band = 'unspecified' THEN 'disaggregation_missing' WHEN oe IN ('deaths', 'stays') AND band <> 'unspecified' THEN 'unexpected_disaggregation' WHEN sex = 'x' THEN 'unknown_sex' WHEN vk = 'nil' THEN 'value_not_numeric' WHEN vk = 'n' AND v < 0 THEN 'value_negative' END
  WHEN 2 THEN CASE WHEN se = 'soap' OR form = 'weekly' AND se = 'nets' THEN 'unknown_commodity' WHEN metric = 'lost' OR form = 'weekly' AND metric = 'received' THEN 'unknown_stock_metric' WHEN vk = 'nil' THEN 'stock_value_not_numeric' WHEN vk = 'n' AND v < 0 THEN 'stock_value_negative' WHEN p % 50 = 0 THEN 'text_exceeds_contract_limit' WHEN metric = 'days_out' AND vk = 'n' AND v > ends - starts + 1 THEN 'days_out_of_stock_exceeds_period' END
  ELSE CASE WHEN le = 'culture' THEN 'unknown_laboratory_test' WHEN form <> 'monthly' THEN 'laboratory_block_on_the_wrong_form' WHEN vk = 'n' AND v < 0 OR pk AND pv < 0 THEN 'laboratory_value_negative' WHEN vk = 'nil' OR NOT pk THEN 'laboratory_value_not_numeric' WHEN vk = 'n' AND pk AND pv > v THEN 'more_positive_than_done' END END AS fault FROM cl JOIN hf USING (id) WHERE stop IS NULL),
ck AS (SELECT *, CASE b WHEN 1 THEN oe || '|' || band || '|' || sex WHEN 2 THEN se || '|' || metric ELSE le END AS key, fault IS NULL OR fault IN ({_W}) AS sound, CASE b WHEN 1 THEN 'observations' WHEN 2 THEN 'stock' ELSE 'laboratory' END || '[' || place || ']' AS cell FROM cf),
ct AS (SELECT *, sound AND row_number() OVER (PARTITION BY id, b, key, sound ORDER BY place) > 1 AS twin FROM ck),
ri AS (SELECT id, stop AS code, CASE WHEN stop = 'unknown_form' THEN 'form' WHEN stop IN ('week_does_not_start_on_monday', 'month_does_not_start_on_the_first') THEN 'period_start' ELSE 'period_end' END AS path FROM hf WHERE stop IS NOT NULL
  UNION ALL SELECT id, 'revision_not_positive', 'revision' FROM hf WHERE stop IS NULL AND id % 17 = 0 UNION ALL SELECT id, 'text_exceeds_contract_limit', 'period_label' FROM hf WHERE stop IS NULL AND id % 19 = 0 UNION ALL SELECT id, 'text_exceeds_contract_limit', 'source_reference' FROM hf WHERE stop IS NULL AND id % 23 = 0
  UNION ALL SELECT id, 'submission_is_empty', '$' FROM hf WHERE stop IS NULL AND id NOT IN (SELECT id FROM cl)
  UNION ALL SELECT id, fault, cell || CASE WHEN fault IN ('unknown_age_band', 'disaggregation_missing', 'unexpected_disaggregation') THEN '.age_band' WHEN fault = 'unknown_sex' THEN '.sex' WHEN fault IN ('element_in_the_wrong_block', 'unknown_element') THEN '.element' WHEN fault = 'unknown_commodity' THEN '.commodity' WHEN fault = 'unknown_stock_metric' THEN '.metric' WHEN fault = 'text_exceeds_contract_limit' THEN '.unit' WHEN fault = 'unknown_laboratory_test' THEN '.test'
    WHEN fault IN ('laboratory_block_on_the_wrong_form', 'more_positive_than_done') THEN '' WHEN fault = 'laboratory_value_negative' THEN CASE WHEN vk = 'n' AND v < 0 THEN '.done' ELSE '.positive' END WHEN fault = 'laboratory_value_not_numeric' THEN CASE WHEN vk = 'nil' THEN '.done' ELSE '.positive' END ELSE '.value' END FROM ct WHERE fault IS NOT NULL
  UNION ALL SELECT id, CASE b WHEN 1 THEN 'duplicate_cell' WHEN 2 THEN 'duplicate_stock_row' ELSE 'duplicate_laboratory_row' END, cell || CASE b WHEN 1 THEN '.element' WHEN 2 THEN '.commodity' ELSE '.test' END FROM ct WHERE twin)"""


@query("return_issues", f"WITH {_RETURNS} SELECT id, code, path, CASE WHEN code IN ({_W}) THEN 'warning' ELSE 'error' END AS severity FROM ri")
def return_issue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every issue of every aggregate return and its cells, with paths."""
    return return_issues(return_lines(spark, sf_dir))

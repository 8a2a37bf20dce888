"""Quality rules as a learned decision list, in native Spark expressions.

statistics() gives counts of every whole text. learn() grows and prunes conjunctions of thresholds on ratios of those
counts by sequential covering, against labelled rows; each step is one grouped aggregation that returns a few hundred
sums. verdict() is the list as one CASE expression: the first rule that holds rejects, else the document is kept.

Defined cases: null or empty text has zero counts and fails the base rule (under 50 words); a null doc_id and repeated
rows are kept, a row each; a doc_id with several labels counts with the larger; other columns are ignored; without
labels of both classes the list is empty and only the base rule rejects. Words of a window are compared by a 64-bit
hash that is only ever compared within one document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

#: Labelled rows that a list is fitted on at most, taken by a hash of doc_id.
FIT_ROWS = 200_000
CUTS, RULES, LITERALS = 32, 12, 4
#: What a pruned rule must reach on the rows kept for pruning.
PRECISION, COVER = 0.9, 5


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and counts of every whole text."""
    none = F.array().cast("array<bigint>")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    d = d.select("*", common.words(F.col("text")).alias("w"), lines.alias("lines"))
    window = lambda i: F.xxhash64(F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2])
    d = d.select(
        "doc_id",
        F.size("w").alias("n_words"),
        F.length(F.array_join("w", "")).alias("word_chars"),
        count(r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        count(r"\p{Lu}+").alias("n_upper"),
        count(r"!+").alias("n_bangs"),
        F.size("lines").alias("n_lines"),
        F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), window)).otherwise(none).alias("h"),
    )
    # Texts without a repeated window are done; the others sort their windows, so that equal ones are neighbours.
    own = lambda x, i: F.struct(x.alias("h"), i.alias("p"))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", own))))
    near = lambda x, i: ((i > 0) & (F.col("s")[F.greatest(i - 1, F.lit(0))].h == x.h)) | ((i + 1 < F.size("s")) & (F.col("s")[F.least(i + 1, F.size("s") - 1)].h == x.h))
    d = d.withColumn("p", F.sort_array(F.transform(F.filter("s", near), lambda x: x.p)))
    step = lambda acc, x: F.struct((acc.n + F.least(F.lit(3), x - acc.last)).alias("n"), x.alias("last"))
    covered = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step, lambda acc: acc.n)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_upper", "n_bangs", "n_lines"]
    return d.select("doc_id", *(F.col(c).cast("long") for c in names), F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def features() -> dict[str, Column]:
    """Ratios of the statistics, each a double and never null."""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols": ratio("n_symbols", "word_chars"),
        "upper": ratio("n_upper", "word_chars"),
        "bangs": ratio("n_bangs", "n_words"),
        "repeats": ratio("n_repeat_words", "n_words"),
        "dup_lines": ratio("n_dup_lines", "n_lines"),
        "word_length": ratio("word_chars", "n_words"),
        "line_words": ratio("n_words", "n_lines"),
        "words": F.col("n_words").cast("double"),
    }


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Literal:
    feature: str
    at_least: bool
    cut: float

    def column(self) -> Column:
        x = features()[self.feature]
        return x >= F.lit(self.cut) if self.at_least else x < F.lit(self.cut)


Rule = tuple[Literal, ...]


def _holds(rule: Rule) -> Column:
    return reduce(and_, (x.column() for x in rule), F.lit(True))


def learn(stats: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS) -> list[Rule]:
    """The ordered rules that tell quality 0; stats: statistics(), written, as plans over it unwritten grow huge; labelled: doc_id, quality."""
    one = labelled.groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality IS NOT NULL AND doc_id IS NOT NULL")
    share = min(1.0, fit_rows / max(1, one.count()))
    one = one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = stats.join(one, "doc_id").where(f"NOT ({BASE_FAILED})")
    rows = rows.select(*(c.alias(f) for f, c in features().items()), (1 - F.col("quality")).alias("bad"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0).alias("prune"), *[c for c in stats.columns if c != "doc_id"])
    rows = common.written(rows, "rule-rows")
    names = list(features())
    # Cuts are quantiles of either class, as a rare class would hardly show among those of all rows.
    points = [i / CUTS for i in range(CUTS + 1)]
    found = rows.groupBy("bad").agg(*(F.percentile_approx(f, points, 10_000).alias(f) for f in names)).collect()
    cuts = {f: sorted({x for r in found for x in r[f]}) for f in names}
    rules: list[Rule] = []
    if not any(cuts.values()):  # no labelled rows
        return rules
    left = rows
    while len(rules) < RULES:
        rule = _grown(left.where("NOT prune"), cuts)
        best = _pruned(left.where("prune"), rule)
        if not best:
            break
        rules.append(best)
        left = left.where(~_holds(best))
    return rules


def _grown(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    """Adds the literal of the largest information gain until no good row is covered."""
    rule: Rule = ()
    while len(rule) < LITERALS:
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), _bin(f, c).alias("b")) for f, c in cuts.items() if c)))
        sums: dict[str, dict[int, tuple[int, int]]] = {}
        for r in rows.where(_holds(rule)).select(pairs.alias("x"), "bad").groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect():
            sums.setdefault(r.f, {})[r.b] = (r.p, r.n - r.p)
        best: tuple[float, Literal] | None = None
        for f, bins in sorted(sums.items()):
            p0, n0 = (sum(x[i] for x in bins.values()) for i in (0, 1))
            for i, cut in enumerate(cuts[f], 1):
                p, n = (sum(x[k] for b, x in bins.items() if b >= i) for k in (0, 1))
                for literal, a, b in ((Literal(f, True, cut), p, n), (Literal(f, False, cut), p0 - p, n0 - n)):
                    gain = a * (_log_share(a, b) - _log_share(p0, n0)) if a else 0.0
                    if gain > 1e-9 and b < n0 and (best is None or gain > best[0]):
                        best = gain, literal
        if best is None:
            break
        rule = (*rule, best[1])
    return rule


def _bin(feature: str, cuts: list[float]) -> Column:
    """How many of the cuts the feature reaches."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(feature)))


def _log_share(p: int, n: int) -> float:
    return log2((p + 1e-9) / (p + n + 1e-9))


def _pruned(rows: DataFrame, rule: Rule) -> Rule | None:
    """The prefix that does best on rows that the rule was not grown on, None if it is not good enough."""
    if not rule:
        return None
    prefixes = [rule[: i + 1] for i in range(len(rule))]
    got = rows.agg(*(F.sum(F.when(_holds(x) & (F.col("bad") == k), 1).otherwise(0)).alias(f"x{i}_{k}") for i, x in enumerate(prefixes) for k in (0, 1))).first()
    scored = [((p - n) / (p + n), p, x) for i, x in enumerate(prefixes) if (p := got[f"x{i}_1"] or 0) + (n := got[f"x{i}_0"] or 0) and p >= COVER and p >= PRECISION * (p + n)]
    return max(scored, key=lambda s: s[:2])[2] if scored else None


def verdict(rules: list[Rule]) -> Column:
    """True where no rule of the list rejects."""
    out = F.lit(True)
    for r in reversed(rules):
        out = F.when(_holds(r), F.lit(False)).otherwise(out)
    return out


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kept: neither the base rule nor the learned list rejects."""
    stats = common.written(statistics(common.documents(spark, sf_dir)), "text-statistics")
    rules = learn(stats, common.labels(spark, sf_dir))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr(BASE_FAILED).alias("base_failed"), (~F.expr(BASE_FAILED) & verdict(rules)).alias("kept"))

"""Personal data: candidate spans scored by boosted trees, in native Spark expressions.

Base spans follow fixed patterns and checks and always stay. Wider patterns propose further spans of each kind, which
may overlap base ones: defanged addresses, spelled-out mail addresses, numbers in other groupings. Each candidate has
small integer features of its format and its context. Labels come from checks and from agreement: what passes its check
speaks for a kind, what fails it against (a mail address also needs a last part of letters), and a candidate that
overlaps a sound span of another kind but none of its own speaks against its kind. Features never hold these.

Counts of labels by features, over all documents, are a bounded table, as every feature has few values: at most the
product of FEATURES for each kind and fold, and no more than the labels. On it, gradient boosting fits regression trees
of depth two; a logistic curve on held-out documents calibrates their sum, and for each kind the least probability at
which PRECISION of its held-out labels above are right (LEAST at least) is its threshold. Trees become one CASE
expression over the candidates' array. A candidate without a label is added if it reaches its kind's threshold and
overlaps no base span of its kind; one that is labelled never is.

Documents are read once: base spans and candidates are written and reread.

Defined cases: null or empty text has no spans; a null doc_id and repeated rows are kept, a row each; other columns are
ignored; positions are code points, end exclusive. Patterns are possessive or anchored at the starts of runs, so long
runs of letters or digits cost no more than their length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.compression import logistic

KINDS = ("email", "ip", "card", "phone")
ROUNDS, RATE, PRECISION, LEAST = 30, 0.3, 0.95, 0.8
#: Characters before and behind a span that features see.
BEFORE, BEHIND = 24, 1


def _from_run(chars: str) -> str:
    """Only where a run of these characters starts, or the match before ended."""
    return rf"(?:\G|(?<![{chars}]))"


#: The base patterns, with the matches of the plain ones.
BASE = {
    "email": _from_run(r"A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _from_run("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,64}\x20?(?:@|[\[(]\x20?at\x20?[\])]|\x20at\x20)\x20?[a-z0-9-]{2,63}(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[a-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?:\[\.\]|\(\.\)|\.)[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,2}[0-9]{4}){2}[\x20./_-]{1,2}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+(])(?:00[1-9][0-9]{0,2}[\x20.-])?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Each is implied by the wide pattern: a part of it that every match holds.
WIDE_NEEDS = {"email": r"(?i)@|[\[(]\x20?at\x20?[\])]|\x20at\x20\x20?[a-z0-9-]{2,63}(?:\.|\x20?[\[(]\x20?dot|\x20dot\x20)", "ip": r"[0-9][\[(]?\.", "card": r"[0-9]{4}[\x20./_-]", "phone": r"[0-9][\x20.)-]{1,2}[0-9]{3}[\x20.-][0-9]{4}"}
CONTEXT = {"email": r"(?i)(?:mail|contact|write|address)", "ip": r"(?i)(?:\bip\b|host|server|address|from)", "card": r"(?i)(?:card|visa|credit|account)", "phone": r"(?i)(?:phone|tel|call|mobile|fax)"}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, though a lambda inside reads it for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def starts(lengths: Column) -> Column:
    """For an array of lengths, the sum before each: chunks of 64 first, so that long arrays stay cheap."""
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 64).cast("int")), lambda c: F.aggregate(F.slice(lengths, c * 64 + 1, 64), F.lit(0), lambda a, x: a + x))
    before = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    place = lambda b: F.transform(lengths, lambda _, i: F.get(b, F.floor(i / 64).cast("int")) + F.aggregate(F.slice(lengths, F.floor(i / 64).cast("int") * 64 + 1, i % 64), F.lit(0), lambda a, x: a + x))
    return once(before, place)


def _matches(kind: str, pattern: str, needs: str, d: DataFrame, out: str) -> DataFrame:
    """d with `out`, an array of start, end, piece, before, behind of a pattern's matches."""
    hit = F.col("text").rlike(needs)
    d = d.withColumn("_m", F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("_g", F.when(F.size("_m") > 0, F.split("text", pattern, -1)))
    d = d.withColumn("_l", F.when(F.size("_m") > 0, F.transform("_m", lambda x, i: F.length(F.get(F.col("_g"), i)) + F.length(x))))
    d = d.withColumn("_s", F.when(F.size("_m") > 0, starts(F.col("_l"))))
    at = lambda x, i: F.get(F.col("_s"), i) + F.length(F.get(F.col("_g"), i))
    made = lambda x, i: F.struct(at(x, i).cast("long").alias("s"), (at(x, i) + F.length(x)).cast("long").alias("e"), x.alias("piece"), F.right(F.get(F.col("_g"), i), F.lit(BEFORE)).alias("before"), F.left(F.get(F.col("_g"), i + 1), F.lit(BEHIND)).alias("behind"))
    return d.withColumn(out, F.when(F.size("_m") > 0, F.transform("_m", made))).drop("_m", "_g", "_l", "_s")


def _digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, from the right, every second doubled, sum to a multiple of ten."""
    value = lambda i: F.ascii(F.substr(digits, F.length(digits) - i + 1, F.lit(1))) - 48
    twice = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, twice(value(i))).otherwise(value(i)))
    return total % 10 == 0


def passes(kind: str, piece: Column) -> Column:
    """The check of a kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.regexp_extract_all(piece, F.lit("0*([0-9]+)"), F.lit(1))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p.cast("int")) <= 255))
    digits = _digits(piece)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


#: Features of a candidate with their numbers of values.
FEATURES = {"digits": 6, "groups": 5, "size": 5, "left": 4, "right": 4, "context": 2, "mark": 3, "odd": 2}


def _bucket(x: Column, *cuts: int) -> Column:
    return sum(((x >= c).cast("int") for c in cuts), F.lit(0))


def _side(c: Column) -> Column:
    return F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^\p{L}$"), 1).when(c.rlike("^[0-9]$"), 2).otherwise(3)


def _features(kind: str, x: Column) -> list[Column]:
    n = F.length(_digits(x.piece))
    return [
        _bucket(n, 4, 9, 13, 17, 20).alias("digits"),
        _bucket(F.size(F.split(x.piece, "[^A-Za-z0-9]+")), 2, 3, 4, 5).alias("groups"),
        _bucket(x.e - x.s, 8, 13, 20, 40).alias("size"),
        _side(F.right(x.before, F.lit(1))).alias("left"),
        _side(x.behind).alias("right"),
        x.before.rlike(CONTEXT[kind]).cast("int").alias("context"),
        F.when(x.piece.contains("+"), 1).when(x.piece.contains("("), 2).otherwise(0).alias("mark"),
        x.piece.rlike(r"[\[\]_/]|\s\s|(?i)\bat\b|\bdot\b").cast("int").alias("odd"),
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (arrays of s, e by kind) and cand (kind, s, e, label 1, 0 or null, features) of every row."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for k in KINDS:
        d = _matches(k, BASE[k], NEEDS[k], d, f"base_{k}")
        d = _matches(k, WIDE[k], WIDE_NEEDS[k], d, f"wide_{k}")
    found = []
    for i, k in enumerate(KINDS):
        none = F.array().cast(f"array<struct<kind:int,s:bigint,e:bigint,label:int,{','.join(f'{f}:int' for f in FEATURES)}>>")
        plain = F.transform(f"base_{k}", _labelled(i, True))
        wide = F.transform(f"wide_{k}", _labelled(i, False))
        found += [F.coalesce(plain, none), F.coalesce(wide, none)]
    base = [F.coalesce(F.transform(F.filter(f"base_{k}", _good(k)), lambda x: F.struct(x.s.alias("s"), x.e.alias("e"))), F.array().cast("array<struct<s:bigint,e:bigint>>")).alias(f"base_{k}") for k in KINDS]
    return d.select("doc_id", *base, F.concat(*found).alias("cand"))


def _labelled(i: int, plain: bool):
    """A candidate's row: base shapes are labelled by their check; wide ones only where the check fails."""

    def row(x: Column) -> Column:
        good = passes(KINDS[i], x.piece)
        if KINDS[i] == "email":
            good = x.piece.rlike(r"(?i)[a-z]{2,12}$")
        label = good.cast("int") if plain else F.when(~good, F.lit(0))
        return F.struct(F.lit(i).alias("kind"), x.s.alias("s"), x.e.alias("e"), label.alias("label"), *_features(KINDS[i], x))

    return row


def _good(kind: str):
    return lambda x: passes(kind, x.piece)


@dataclass(frozen=True)
class Stump:
    """A tree of depth two: (feature, cut) at the root and on either side, and four leaves."""

    root: tuple[str, int]
    low: tuple[str, int]
    high: tuple[str, int]
    leaves: tuple[float, float, float, float]

    def column(self, x: Column) -> Column:
        side = lambda split, a, b: F.when(x[split[0]] < split[1], F.lit(a)).otherwise(F.lit(b))
        return F.when(x[self.root[0]] < self.root[1], side(self.low, *self.leaves[:2])).otherwise(side(self.high, *self.leaves[2:]))

    def values(self, cells: dict[str, np.ndarray]) -> np.ndarray:
        side = lambda split, a, b: np.where(cells[split[0]] < split[1], a, b)
        return np.where(cells[self.root[0]] < self.root[1], side(self.low, *self.leaves[:2]), side(self.high, *self.leaves[2:]))


SPLITS = [("kind", c) for c in range(1, len(KINDS))] + [(f, c) for f, n in FEATURES.items() for c in range(1, n)]


def _split(cells: dict[str, np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray) -> tuple[float, tuple[str, int]]:
    """The best gain of second-order boosting and its split, among rows."""
    def worth(take: np.ndarray) -> float:
        return float(g[take].sum() ** 2 / (h[take].sum() + 1.0))

    whole = worth(rows)
    return max(((worth(rows & (cells[f] < c)) + worth(rows & (cells[f] >= c)) - whole, (f, c)) for f, c in SPLITS), key=lambda s: s[0])


def boosted(cells: dict[str, np.ndarray], positive: np.ndarray, negative: np.ndarray, rounds: int = ROUNDS) -> list[Stump]:
    """Trees for counts of labels by cell."""
    margin, trees = np.zeros(len(positive)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = positive * (1 - p) - negative * p, (positive + negative) * p * (1 - p)
        every = np.ones(len(p), bool)
        root = _split(cells, g, h, every)[1]
        below = cells[root[0]] < root[1]
        low, high = _split(cells, g, h, below)[1], _split(cells, g, h, ~below)[1]
        parts = [below & (cells[low[0]] < low[1]), below & (cells[low[0]] >= low[1]), ~below & (cells[high[0]] < high[1]), ~below & (cells[high[0]] >= high[1])]
        trees.append(Stump(root, low, high, tuple(float(RATE * g[x].sum() / (h[x].sum() + 1.0)) for x in parts)))
        margin += trees[-1].values(cells)
    return trees


def overlaps(x: Column, base: Column) -> Column:
    """Whether a span meets one of `base`, spans in order that do not overlap: by halving, so that many matches stay cheap."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(base) + 1.0)).cast("int"))

    def halved(at: Column, _: Column) -> Column:
        mid = F.floor((at.lo + at.hi) / 2).cast("int")
        left = F.get(base, mid).e <= x.s
        return F.when(at.lo >= at.hi, at).when(left, F.struct((mid + 1).alias("lo"), at.hi.alias("hi"))).otherwise(F.struct(at.lo.alias("lo"), mid.alias("hi")))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(base).alias("hi")), halved, lambda at: at.lo)
    return F.when(F.size(base) > 0, F.coalesce(F.get(base, found).s < x.e, F.lit(False))).otherwise(F.lit(False))


def labelled(found: DataFrame) -> DataFrame:
    """doc_id, base arrays and cand with free, whether it overlaps no base span of its kind, and labels by agreement."""

    def row(x: Column) -> Column:
        def made(met: Column) -> Column:
            own = F.get(met, x.kind)
            other = F.exists(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda i: (i != x.kind) & F.get(met, i))
            label = F.when(x.label.isNull() & ~own & other, F.lit(0)).otherwise(x.label)
            return F.struct(x.kind.alias("kind"), x.s.alias("s"), x.e.alias("e"), label.alias("label"), *(x[f].alias(f) for f in FEATURES), (~own).alias("free"))

        return once(F.array(*(overlaps(x, F.col(f"base_{k}")) for k in KINDS)), made)

    bases = [f"base_{k}" for k in KINDS]
    return found.select("doc_id", *bases, F.when(F.size("cand") > 0, F.transform("cand", row)).alias("cand"))


def cutoffs(kinds: np.ndarray, chance: np.ndarray, p: np.ndarray, n: np.ndarray) -> list[float]:
    """For each kind the least chance at which PRECISION of the labels at or above it are positive; above 1 where there is none."""
    out = []
    for i in range(len(KINDS)):
        own = np.flatnonzero(kinds == i)
        own = own[np.argsort(-chance[own], kind="stable")]
        hit, miss = np.cumsum(p[own]), np.cumsum(n[own])
        last = np.append(np.diff(chance[own]) != 0, True)[: len(own)]  # equal chances stand or fall together
        good = np.flatnonzero((hit >= PRECISION * (hit + miss)) & (hit > 0) & last)
        out.append(max(LEAST, float(chance[own][good[-1]])) if len(good) else 2.0)
    return out


def fit(found: DataFrame) -> tuple[list[Stump], tuple[float, float, float], list[float]]:
    """Trees, their curve and the kinds' thresholds, from the counts of labels of all documents; found: labelled()."""
    names = ["kind", *FEATURES]
    fold = common.held_out(F.col("doc_id"), 4, 0).alias("fold")
    c = found.where(F.size("cand") > 0).select(fold, F.explode("cand").alias("c")).where("c.label IS NOT NULL")
    rows = c.groupBy("fold", *(F.col(f"c.{f}") for f in names)).agg(F.sum("c.label").alias("p"), F.count("*").alias("n")).collect()
    part = lambda held: [r for r in rows if r.fold == held]
    cells = lambda rs: {f: np.array([r[f] for r in rs], int) for f in names}
    counts = lambda rs: (np.array([r.p for r in rs], float), np.array([r.n - r.p for r in rs], float))
    trees = boosted(cells(part(False)), *counts(part(False))) if part(False) else []
    held = part(True)
    if not held or not trees:
        return trees, (1.0, 1.0, 0.0), [2.0] * len(KINDS)
    margin, (p, n) = sum(t.values(cells(held)) for t in trees), counts(held)
    curve = logistic(np.tile(margin, 2), np.repeat([1.0, 0.0], len(p)), np.concatenate([p, n]))
    return trees, curve, cutoffs(cells(held)["kind"], probability(margin, curve), p, n)


def probability(margin: np.ndarray, curve: tuple[float, float, float]) -> np.ndarray:
    scale, slope, intercept = curve
    return 1 / (1 + np.exp(-(margin / scale * slope + intercept)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of kind, s, e; by kind, then start."""
    found = labelled(common.written(candidates(docs), "pii-candidates"))
    trees, (scale, slope, intercept), cuts = fit(found)
    chance = lambda x: 1 / (1 + F.exp(-(sum((t.column(x) for t in trees), F.lit(0.0)) / scale * slope + intercept)))
    base = F.concat(*(F.transform(f"base_{k}", _tag(i)) for i, k in enumerate(KINDS)))
    cut = lambda x: F.element_at(F.array(*map(F.lit, cuts)), x.kind + 1)
    wanted = lambda x: F.when(x.label.isNull() & x.free, chance(x) >= cut(x)).otherwise(F.lit(False))
    more = F.transform(F.filter("cand", wanted), lambda x: F.struct(x.kind.alias("kind"), x.s.alias("s"), x.e.alias("e")))
    spans = F.when(F.size("cand") > 0, F.array_sort(F.concat(base, more))).otherwise(base) if trees else base
    return found.select("doc_id", base.alias("base"), spans.alias("spans"))


def _tag(i: int):
    return lambda x: F.struct(F.lit(i).alias("kind"), x.s.alias("s"), x.e.alias("e"))


def digest(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x.kind + 1), x.s, x.e)), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_<kind> count base spans; base_sha256 digests them; spans lists these and the added ones."""
    got = scan(common.documents(spark, sf_dir))
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return got.select("doc_id", *counts, F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _is(i: int):
    return lambda x: x.kind == i

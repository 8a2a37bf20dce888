"""Mixing sources to target weights by Pareto order sampling, in native Spark expressions.

targets() shares the mix among sources. Of a source whose target is q times its size, every document is taken floor(q)
times for certain. The rest of the target is a Pareto sample without replacement of that many words: a document of
size s has inclusion odds p / (1 - p) = c / sqrt(s), so that long texts are repeated less often, and c is solved for
each source so that the words expected, the sum of p times s, are the rest of its target. Documents are ranked by
their random odds u / (1 - u) over their inclusion odds and taken in that order; one that does not fit the words that
are left is passed over, until none fits. A last document is taken beyond that if it brings the source nearer to its
target than stopping short.

Nothing orders a whole source in one task: ranks go to BINS bins, bins are summed before the shuffle, and only the bin
in which a source's words run out is sorted. Such a pass is repeated until less than FILL words are free; then, of
each size s, only the first free / s documents by rank can be taken, and these few are gone through in one array.

Defined cases: null or empty text has size 0 and is taken 0 words; the null source comes last; a null doc_id counts as
the smallest; repeated rows have equal ranks and are taken or left together; other columns are ignored; an empty table
gives an empty result. Random numbers are md5 of doc_id and seed, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import common

WEIGHTS, SHARE, MOST, BINS = (3, 1, 2), 1.5, 2, 4096
#: Free words below which the last documents of a source are found in one array; steps in which c is found.
FILL, STEPS = 1000, 60
#: Rows up to which a table of sources is broadcast; beyond it Spark chooses the join.
SMALL_ROWS = 100_000
FLOOR = -(2**63)


def _small(df: DataFrame, name: str) -> DataFrame:
    df = common.written(df, name)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(common.words(F.col("text"))).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, n, target: water-filling, as the sources that reach their limit come first by limit over weight."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    by = by.withColumn("limit_ratio", F.col("source_size") * F.lit(float(most)) / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("limit_ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * float(most)
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumns({"k": F.row_number().over(order), "level": (F.sum("source_size").over(everything) * share - before) / rest})
    found = by.withColumn("first", F.min(F.when(F.col("level") <= F.col("limit_ratio"), F.struct("k", "level"))).over(everything))
    target = F.when(F.col("k") < F.col("first.k"), F.col("source_size") * float(most)).otherwise(F.col("first.level") * F.col("weight"))
    return found.select("source", "source_size", "n", target.alias("target"))


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number strictly between 0 and 1 from 52 bits of md5."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(2**52))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row."""
    sized = common.written(sizes(docs), "mix-sizes")
    goal, ends = plan(sized, weights, share, most, seed)
    return taken(sized, goal, ends, seed).select("doc_id", "source", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """The rows of docs, all columns as they are, as often as the mix takes them."""
    goal, ends = plan(common.written(sizes(docs), "mix-sizes"), weights, share, most, seed)
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.size(common.words(F.col("row.text"))).cast("long").alias("size"))
    return taken(rows, goal, ends, seed).where("times > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def _weight(size: Column, mean: Column) -> Column:
    """A document's share in its inclusion odds."""
    return F.sqrt(F.greatest(mean, F.lit(1.0)) / F.greatest(size, F.lit(1)))


def _factor(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """source, c: the factor of inclusion odds at which the words expected are the source's room; of sizes in classes of a ninth."""
    rows = sized.where("size > 0").groupBy("source", F.floor(F.log2("size") * 8).alias("class")).agg(F.count("*").alias("n"), F.avg("size").alias("s"))
    rows = rows.groupBy("source").agg(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), "s")).alias("classes"))
    g = goal.withColumnRenamed("source", "its")
    rows = rows.join(g, rows.source.eqNullSafe(g.its)).select("source", "classes", "room", "mean")
    odds = lambda c, x: c * _weight(x.s, F.col("mean"))
    words = lambda c: F.aggregate("classes", F.lit(0.0), lambda acc, x: acc + x.n * x.s * odds(c, x) / (1 + odds(c, x)))

    def halved(acc: Column, _: Column) -> Column:
        mid = (acc.low + acc.high) / 2
        return F.when(words(F.exp(mid)) < F.col("room"), F.struct(mid.alias("low"), acc.high.alias("high"))).otherwise(F.struct(acc.low.alias("low"), mid.alias("high")))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(-40.0).alias("low"), F.lit(40.0).alias("high")), halved)
    return rows.select(F.col("source").alias("of"), F.exp(found.low).alias("c"))


def inclusion(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, copies, room and p, the chance of one more copy, of every row."""
    sized = common.written(sizes(docs), "mix-sizes")
    goal = goals(sized, weights, share, most)
    odds = F.col("c") * _weight(F.col("size"), F.col("mean"))
    p = F.when((F.col("size") > 0) & (F.col("room") > 0), odds / (1 + odds)).otherwise(0.0)
    return sized.join(goal, sized.source.eqNullSafe(goal.source)).select("doc_id", sized.source, "size", "copies", "room", p.alias("p"))


def _ranked(sized: DataFrame, goal: DataFrame, seed: int) -> DataFrame:
    """sized with its source's figures and the document's rank, bin and tie."""
    u = uniform(F.col("doc_id"), seed)
    rank = u / (1 - u) / (F.col("c") * _weight(F.col("size"), F.col("mean")))
    return sized.join(goal, sized.source.eqNullSafe(goal.source)).select(sized["*"], "source_size", "target", "copies", "room", rank.alias("rank"), F.coalesce("doc_id", F.lit(FLOOR)).alias("tie"), F.floor(rank / (1 + rank) * BINS).alias("bin"))


def taken(sized: DataFrame, goal: DataFrame, ends: DataFrame, seed: int = 0) -> DataFrame:
    """sized with source_size, target and times, how often a document is taken."""
    return _with(_ranked(sized, goal, seed), ends).select(*sized.columns, "source_size", "target", (F.col("copies") + F.col("took").cast("long")).alias("times"))


def goals(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """By source: source_size, target, copies, the room left for the sample, mean size and c."""
    goal = targets(sized, weights, share, most)
    goal = goal.withColumns({"copies": F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)), "mean": F.col("source_size") / F.col("n")})
    goal = common.written(goal.withColumn("room", F.floor(F.col("target") - F.col("copies") * F.col("source_size") + 0.5)), "mix-rooms")
    c = _factor(sized, goal)
    return _small(goal.join(c, goal.source.eqNullSafe(c["of"]), "left").select(goal["*"], F.coalesce("c", F.lit(1.0)).alias("c")), "mix-targets")


PASS = "struct<bin:bigint,rank:double,tie:bigint,gap:bigint>"
EXTRA = "struct<rank:double,tie:bigint,size:bigint>"


def plan(sized: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Two small tables by source: its goal; where each pass ends and which documents are taken beyond."""
    goal = goals(sized, weights, share, most)
    ranked = _ranked(sized, goal, seed).where("size > 0")
    # As the rows of a pass are those up to an end, what passes took is a small table of ends by source.
    ends = goal.select("source", F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{PASS}>").alias("passes"), F.array().cast(f"array<{EXTRA}>").alias("extra"))
    first = True
    while True:
        left = _with(ranked, ends).where("NOT took AND size <= room - used").withColumn("room", F.col("room") - F.col("used"))
        left = left if first else left.where(F.col("room") > FILL)
        bins = left.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("room").alias("room"))
        bins = bins.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
        whole = F.col("upto") <= F.col("room")
        cut = bins.groupBy("source").agg(F.max(F.when(whole, F.col("bin"))).alias("full"), F.coalesce(F.max(F.when(whole, F.col("upto"))), F.lit(0)).alias("filled"), F.min(F.when(~whole, F.col("bin"))).alias("edge"))
        cut = common.written(cut, "mix-cut")
        n = cut.count()
        if not n:
            break
        cut = F.broadcast(cut) if n <= SMALL_ROWS else cut
        edge = left.join(cut, left.source.eqNullSafe(cut.source) & (left.bin == cut.edge)).select(left["*"], "filled")
        edge = edge.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("rank", "tie"))).where("filled + upto <= room")
        edge = edge.groupBy("source").agg(F.max(F.struct("bin", "rank", "tie")).alias("last"), F.max("upto").alias("more"))
        end = F.coalesce("last", F.struct(F.coalesce("full", F.lit(-1).cast("long")).alias("bin"), F.lit(float("inf")).alias("rank"), F.lit(2**63 - 1).alias("tie")))
        new = cut.join(edge, cut.source.eqNullSafe(edge.source), "left").select(cut.source.alias("its"), end.alias("end"), (F.col("filled") + F.coalesce("more", F.lit(0))).alias("now"))
        old, more = ends, F.array(F.struct("end.bin", "end.rank", "end.tie", F.col("used").alias("gap")))
        ends = old.join(new, old.source.eqNullSafe(new.its), "left")
        ends = _small(ends.select("source", (F.col("used") + F.coalesce("now", F.lit(0))).alias("used"), F.when(F.col("end").isNull(), F.col("passes")).otherwise(F.concat("passes", more)).alias("passes"), "extra"), "mix-ends")
        first = False
    return goal, _nearest(ranked, _filled(ranked, ends))


def _filled(ranked: DataFrame, ends: DataFrame) -> DataFrame:
    """ends with the documents that still fit, taken in the order of ranks."""
    left = _with(ranked, ends).where("NOT took AND size <= room - used").withColumn("free", F.col("room") - F.col("used"))
    left = left.groupBy("source", "rank", "tie", "size").agg(F.count("*").alias("n"), F.first("free").alias("free"))
    order = Window.partitionBy("source", "size").orderBy("rank", "tie")
    left = left.withColumn("k", F.row_number().over(order)).where(F.col("k") <= FILL).where("k * size <= free")
    rows = left.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("rank", "tie", "size", "n"))).alias("rows"), F.first("free").alias("free"))
    fits = lambda acc, x: F.when(x.n * x.size <= acc.free, F.struct((acc.free - x.n * x.size).alias("free"), F.concat(acc.got, F.array(F.struct(x.rank.alias("rank"), x.tie.alias("tie"), x.size.alias("size")))).alias("got"))).otherwise(acc)
    done = F.aggregate("rows", F.struct(F.col("free"), F.array().cast(f"array<{EXTRA}>").alias("got")), fits)
    rows = rows.select(F.col("source").alias("its"), (F.col("free") - done.free).alias("now"), done.got.alias("got"))
    found = ends.join(rows, ends.source.eqNullSafe(rows.its), "left")
    return _small(found.select("source", (F.col("used") + F.coalesce("now", F.lit(0))).alias("used"), "passes", F.coalesce("got", "extra").alias("extra")), "mix-filled")


def _nearest(ranked: DataFrame, ends: DataFrame) -> DataFrame:
    """ends with one more document where that overshoots a source's target by less than it falls short."""
    left = _with(ranked, ends).where("NOT took AND size < 2 * (room - used)")
    best = left.groupBy("source", "rank", "tie", "size").agg(F.count("*").alias("n"), F.first(F.col("room") - F.col("used")).alias("free")).where("n * size < 2 * free")
    best = best.groupBy(F.col("source").alias("its")).agg(F.min(F.struct((F.col("n") * F.col("size")).alias("words"), "rank", "tie", "size")).alias("x"))
    found = ends.join(best, ends.source.eqNullSafe(best.its), "left")
    one = F.array(F.struct(F.col("x.rank").alias("rank"), F.col("x.tie").alias("tie"), F.col("x.size").alias("size")))
    return _small(found.select("source", (F.col("used") + F.coalesce("x.words", F.lit(0))).alias("used"), "passes", F.when(F.col("x").isNull(), F.col("extra")).otherwise(F.concat("extra", one)).alias("extra")), "mix-nearest")


def _with(ranked: DataFrame, ends: DataFrame) -> DataFrame:
    """ranked with took, whether the row is taken beyond its copies, and used, the words that its source's sample has."""
    own, key = F.struct("bin", "rank", "tie"), F.struct("rank", "tie", "size")
    took = F.exists("passes", lambda p: (own <= F.struct(p.bin.alias("bin"), p.rank.alias("rank"), p.tie.alias("tie"))) & (F.col("size") <= F.col("room") - p.gap)) | F.array_contains("extra", key)
    e = ends.withColumnRenamed("source", "its")
    return ranked.join(e, ranked.source.eqNullSafe(e.its), "left").select(ranked["*"], (F.coalesce(took, F.lit(False)) & (F.col("size") > 0)).alias("took"), F.coalesce("used", F.lit(0)).alias("used"))


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken: the words of a document's certain and sampled copies."""
    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
s1 AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM s0),
s2 AS (SELECT *, source_size * 2.0::DOUBLE / weight AS limit_ratio FROM s1),
s3 AS (SELECT *, row_number() OVER o AS k,
  ((SELECT sum(source_size) FROM s0)::DOUBLE * 1.5::DOUBLE - coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0::DOUBLE) / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM s2 WINDOW o AS (ORDER BY limit_ratio, source NULLS LAST)),
f AS (SELECT k AS fk, level AS fl FROM s3 WHERE level <= limit_ratio ORDER BY k LIMIT 1),
g AS (SELECT source, source_size, n, CASE WHEN k < fk THEN source_size * 2.0::DOUBLE ELSE fl * weight END AS target FROM s3, f),
g1 AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS copies FROM g),
r AS (SELECT d.*, source_size, target, copies, floor(target - copies * source_size + 0.5::DOUBLE) AS room,
  (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':0'), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
  sqrt(greatest(size, 1)::DOUBLE / greatest(source_size::DOUBLE / n, 1.0::DOUBLE)) AS w, coalesce(doc_id, -9223372036854775808) AS tie
  FROM d JOIN g1 ON d.source IS NOT DISTINCT FROM g1.source),
q AS (SELECT source, room, list({'size': size, 'free': CAST(0 AS BIGINT), 'got': [tie], 'left': CAST([] AS STRUCT(size BIGINT, k BIGINT, tie BIGINT)[])} ORDER BY u / (1 - u) * w, tie) AS rows FROM r WHERE size > 0 GROUP BY source, room),
z AS (SELECT source, list_reduce(rows, lambda acc, x: CASE WHEN x.size <= acc.free
    THEN {'size': acc.size, 'free': acc.free - x.size, 'got': list_concat(acc.got, x.got), 'left': acc.left}
    ELSE {'size': acc.size, 'free': acc.free, 'got': acc.got, 'left': list_append(acc.left, {'size': x.size, 'k': CAST(len(acc.left) AS BIGINT), 'tie': x.got[1]})} END,
  {'size': CAST(0 AS BIGINT), 'free': CAST(room AS BIGINT), 'got': CAST([] AS BIGINT[]), 'left': CAST([] AS STRUCT(size BIGINT, k BIGINT, tie BIGINT)[])}) AS e FROM q),
y AS (SELECT source, list_concat(e.got, CASE WHEN list_min(e.left).size < 2 * e.free THEN [list_min(e.left).tie] ELSE [] END) AS got FROM z)
SELECT doc_id, size, r.source_size, r.target, CAST((copies + coalesce(list_contains(y.got, r.tie), false)::INT) * size AS BIGINT) AS taken, r.source FROM r LEFT JOIN y ON r.source IS NOT DISTINCT FROM y.source
"""

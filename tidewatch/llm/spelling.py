"""Spelling variants: words that differ by one inserted, deleted or replaced letter, and the common word that each stands for.

Words are counted natively. NumPy takes, for every letter of a batch of words, the hash of the word without it from
prefix and suffix sums of a polynomial in 64-bit integers. Such a hash is a deletion key, and with the place it is a key
of all words that agree but for the letter there; a word's own hash meets the deletion keys of words longer by one. Two
near words share exactly one key: their one replaced place, or the one deletion (of a run of equal letters, the first).
Keys, of fixed width, are dealt to partitions by their leading bits and sorted there; what meets nobody goes. The rest
take their words back and meet once more by the strings themselves, so a collision of hashes has no effect.

No pairs are made. Of words that share a key every one takes the count of the others and the most frequent of them: sums
over a group, which the letters at one place (or of one insertion) bound, whatever the number of documents.

Defined cases: a null text has no words; a null doc_id counts as empty text where it is hashed; repeated rows count as
often as they come; other columns are ignored; an empty table gives an empty result. Words may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import common

LEAST_LENGTH, LEAST_COUNT, TIMES, EVERY = 6, 5, 5, 199
#: Keys of a partition, about; letters of which keys are made at once.
KEYS, LETTERS = 4_000_000, 500_000
ODD = 0x9E3779B97F4A7C15
INVERSE = np.uint64(pow(ODD, -1, 1 << 64))
#: The slot of a word's own key; that of its letter i is 2 i with the place held open and 2 i + 1 with the letter gone.
OWN = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """wid, word, n: words of the least length and count; of some runs of letters, by a hash, one letter is left out first."""
    lowered = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    runs = F.regexp_extract_all(lowered, F.lit(f"[a-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    r = docs.select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":")).alias("head"), F.explode(runs).alias("run"))
    r = r.select("run", F.crc32(F.concat("head", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    n = r.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= least_count).select(F.monotonically_increasing_id().alias("wid"), "word", "n")


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all words, the places of the words in the list, and slots."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(codes)) - starts[word]
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(lengths.max(initial=0), ODD, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(codes) * powers[at], dtype=np.uint64)])
    prefix, suffix = sums[:-1] - sums[starts[word]], sums[ends[word]] - sums[1:]
    gone = prefix + suffix * INVERSE
    first = (at == 0) | (codes != np.concatenate([codes[:1], codes[:-1]]))
    opened = common.mix(gone ^ common.mix((2 * at + 1).astype(np.uint64)))
    keys = np.concatenate([common.mix(sums[ends] - sums[starts]), opened, common.mix(gone[first])])
    return keys, np.concatenate([np.arange(len(words)), word, word[first]]), np.concatenate([np.full(len(words), OWN), 2 * at, 2 * at[first] + 1])


def _keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        after = np.cumsum(pdf["word"].str.len().to_numpy()) // LETTERS
        for part in np.unique(after):
            own = pdf[after == part]
            keys, word, slot = keys_of(own["word"].tolist())
            yield pd.DataFrame({"key": keys.view(np.int64), "wid": own["wid"].to_numpy()[word], "slot": slot.astype(np.int32)})


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of rows ascending by key and slot, those that may have met another word."""
    key, slot = pdf["key"].to_numpy(), pdf["slot"].to_numpy()
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    many, owned = np.repeat(size > 1, size), np.repeat(slot[start] == OWN, size)
    return pdf[many & (owned | ((slot >= 0) & (slot % 2 == 0)))]


def _shared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of sorted frames whose keys have met; the last key of a frame waits for the next one."""
    held = None
    for pdf in frames:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if len(pdf):
            key = pdf["key"].to_numpy()
            other = np.flatnonzero(key != key[-1])
            cut = other[-1] + 1 if len(other) else 0
            yield _met(pdf.iloc[:cut])[["wid", "slot"]]
            held = pdf.iloc[cut:]
    if held is not None:
        yield _met(held)[["wid", "slot"]]


def meeting(words: DataFrame) -> DataFrame:
    """wid, slot: the keys of words that another word seems to share."""
    letters = words.agg(F.sum(F.length("word"))).first()[0] or 0
    n = max(common.partitions(words.sparkSession), 2 * letters // KEYS)
    digits = F.shiftrightunsigned("key", 64 - (16 * n).bit_length())
    keys = words.select("wid", "word").mapInPandas(_keyed, "key long, wid long, slot int")
    return keys.repartition(n, digits).sortWithinPartitions("key", "slot").mapInPandas(_shared, "wid long, slot int")


def near(words: DataFrame) -> DataFrame:
    """wid, n_near, best (minus its count, its text) of every word (wid, word, n) that has near words."""
    i, own = F.shiftright("slot", 1), F.col("slot") == OWN
    gone = (F.col("slot") % 2 == 1) & ~own
    left, right = F.substring("word", F.lit(1), i), F.substring("word", i + 2, F.length("word"))
    # No word holds an asterisk, so places held open never meet deletions.
    pattern = F.when(own, F.col("word")).when(gone, F.concat(left, right)).otherwise(F.concat(left, F.lit("*"), right))
    item = F.struct((-F.col("n")).alias("less"), "word")
    met = meeting(words).join(words, "wid").select("wid", pattern.alias("pattern"), own.alias("own"), gone.alias("gone"), item.alias("item"))
    order = Window.partitionBy("pattern").orderBy("item")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    others = F.when(F.row_number().over(order) == 1, F.lead("item").over(order)).otherwise(F.first("item").over(whole))
    of = lambda c: (F.count_if(c).over(whole), F.min(F.when(c, F.col("item"))).over(whole))
    (n_own, best_own), (n_gone, best_gone) = of(F.col("own")), of(F.col("gone"))
    n = F.when(F.col("own"), n_gone).when(F.col("gone"), n_own).otherwise(F.count("*").over(whole) - 1)
    best = F.when(F.col("own"), best_gone).when(F.col("gone"), best_own).otherwise(others)
    found = met.select("wid", n.alias("n"), best.alias("best")).where("n > 0")
    return found.groupBy("wid").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of every word (word, form) that has a form. A form is TIMES as frequent as its word, so chains have few
    links, and each round takes the form of the form of all."""
    up = common.written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("far"))
        if up.join(over, "root", "left_semi").isEmpty():
            return up
        up = common.written(up.join(over, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "spelling-roots")


def variants(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root of all words."""
    words = common.written(counted(docs), "spelling-words")
    found = words.join(near(words), "wid", "left")
    much = -F.col("best.less") >= times * F.col("n")
    forms = common.written(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(much, F.col("best.word")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n")), "spelling-forms")
    up = roots(forms.where("form IS NOT NULL"))
    return forms.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with the word that it stands for."""
    return variants(common.documents(spark, sf_dir))


#: The bits of a text's bytes go through the CRC one by one, each byte's lowest first.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * octet_length(encode({x}))), lambda k: CAST(substr(CAST(CAST(encode({x}) AS BIT) AS VARCHAR), CAST(k // 8 * 8 + 8 - k % 8 AS INTEGER), 1) AS BIGINT))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"
ORACLE = f"""WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS w FROM documents),
g AS (SELECT d, w, count(*) AS n FROM r WHERE length(w) >= 6 GROUP BY ALL), h AS (SELECT w, n, {_CRC.format(x="(d || ':' || w)")} AS h FROM g),
o AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM h),
v AS MATERIALIZED (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5),
del AS (SELECT w, n, i, substr(w, 1, i - 1) AS a, substr(w, i + 1) AS b FROM v, range(1, 200) t(i) WHERE i <= length(w)),
p AS (SELECT x.w, y.w AS o, y.n FROM del x JOIN del y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.w <> y.w
  UNION SELECT v.w, del.w, del.n FROM v JOIN del ON v.w = a || b UNION SELECT del.w, v.w, v.n FROM v JOIN del ON v.w = a || b),
m AS (SELECT w, count(*) AS n_near, max(n) AS most FROM p GROUP BY w), f0 AS (SELECT m.w, most, min(o) AS form FROM m JOIN p ON p.w = m.w AND p.n = m.most GROUP BY ALL),
f AS MATERIALIZED (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN f0.most >= 5 * v.n THEN form END AS form, CASE WHEN f0.most >= 5 * v.n THEN f0.most END AS form_n FROM v LEFT JOIN m ON m.w = v.w LEFT JOIN f0 ON f0.w = v.w),
up AS (SELECT w, w AS at FROM f UNION SELECT up.w, f.form FROM up JOIN f ON f.w = up.at WHERE f.form IS NOT NULL)
SELECT f.w AS word, f.form, up.at AS root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.w = f.w JOIN f last ON last.w = up.at WHERE last.form IS NULL"""

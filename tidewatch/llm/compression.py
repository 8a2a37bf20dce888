"""Quality scores from compressed sizes.

Two zstandard dictionaries are trained on labelled text, one on good and one on bad documents. A text is compressed in
blocks with either; the difference of the two sizes over their sum is positive where the bad dictionary fits better.
A logistic curve, fitted on labelled rows that trained no dictionary, turns it into a score.

Scoring is one pass without a shuffle. What reaches the driver is bounded: two dictionaries of DICT_BYTES and the
differences of at most FIT_DOCS rows a class.

Defined cases: null or empty text has difference 0 and the score that the curve gives to it; a null doc_id and repeated
rows are kept, a row each; a doc_id with several labels counts with the larger; other columns are ignored; without
labels of both classes every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

#: Labelled documents of a class that are used at most: half train its dictionary, half the curve.
FIT_DOCS = 4000
DICT_BYTES, BLOCK, LEVEL, FOLDS, FOLD, CUT = 64 << 10, 1024, 3, 4, 2, 0.7


def difference(data: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """(good - bad) / (good + bad) of the sizes of all blocks."""
    a = b = 0
    for i in range(0, len(data), BLOCK):
        block = data[i : i + BLOCK]
        a += len(good.compress(block))
        b += len(bad.compress(block))
    return (a - b) / (a + b) if a + b else 0.0


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    made = zstandard.ZstdCompressionDict(dictionary)
    made.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)


def _trained(pdf: pd.DataFrame) -> pd.DataFrame:
    """The dictionary of one class's bounded sample; raw text where there is too little of it to train on."""
    blocks = [d[i : i + BLOCK] for d in (t.encode() for t in pdf.sort_values(["doc_id", "text"])["text"]) for i in range(0, len(d), BLOCK)]
    try:
        made = zstandard.train_dictionary(DICT_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:
        made = b"".join(blocks)[-DICT_BYTES:] or b"\0"
    return pd.DataFrame({"label": pdf["label"].iloc[:1], "made": [made]})


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Scale, slope and intercept of P(y = 1) by Newton steps, with a little ridge so that it also ends on separable rows."""
    scale = float(np.std(x)) or 1.0
    z, beta = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        w = weight * p * (1 - p)
        hess = z.T @ (z * w[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, z.T @ (weight * (y - p)) - 1e-2 * beta)
        beta += step
        if abs(step).max() < 1e-9:
            break
    return scale, float(beta[0]), float(beta[1])


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """doc_id, text, label, share of rows outside the held-out fold; at most about `most` of each class, by a hash of doc_id."""
    one = labels.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    one = one.where(~common.held_out(F.col("doc_id"), folds, fold))
    n = {r.label: r["count"] for r in one.groupBy("label").count().collect()}
    share = F.lit(0.0)
    for k, v in n.items():
        share = F.when(F.col("label") == k, F.lit(min(1.0, most / v))).otherwise(share)
    one = one.withColumn("share", share).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long"), text).join(F.broadcast(one), "doc_id")  # at most 2 * `most` rows


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = FOLDS, fold: int = FOLD, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, difference, score of every row."""
    sample = common.written(labelled(docs, labels, label, folds, fold, fit_docs), "compression-sample")
    first = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0
    made = {r.label: bytes(r.made) for r in sample.where(first).groupBy("label").applyInPandas(_trained, "label int, made binary").collect()}
    if set(made) != {0, 1}:
        return docs.select("doc_id", F.lit(0.0).alias("difference"), F.lit(0.5).alias("score"))
    rows = _differences(sample.where(~first), made, ["label", "share"]).select("label", "share", "difference").collect()
    x, y, w = (np.array([r[c] for r in rows], float) for c in ("difference", "label", "share"))
    curve = logistic(x, y, 1 / w) if len(set(y)) == 2 else (1.0, 0.0, 0.0)
    scale, slope, intercept = curve
    # A better fit of the bad dictionary never speaks for a document.
    z = F.col("difference") / scale * min(slope, 0.0) + intercept
    return _differences(docs, made, []).select("doc_id", "difference", (1 / (1 + F.exp(-z))).alias("score"))


def _differences(docs: DataFrame, made: dict[int, bytes], more: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = compressor(made[1]), compressor(made[0])
        for b in batches:
            diffs = [difference(t.encode(), good, bad) if t else 0.0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(diffs, pa.float64())], ["doc_id", *more, "difference"])

    cast = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
    kinds = "".join(f"{c} {k}, " for c, k in cast.dtypes[2:])
    return cast.mapInArrow(run, f"doc_id long, {kinds}difference double")


def op6_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, fitted outside the held-out fold."""
    got = score(common.documents(spark, sf_dir), common.labels(spark, sf_dir))
    return got.select("doc_id", common.held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "difference")


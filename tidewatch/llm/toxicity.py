"""Toxicity from class-conditional Kneser-Ney models of the letters of words.

One model is of toxic, one of ordinary labelled text. Either gives the probability of a letter (or a word's end) after
the four before it in its word, by discounted counts; each class's discount is n1 / (n1 + 2 n2), of its grams counted
once and twice. What discounting takes off goes to one fallback that both classes
share: Kneser-Ney continuation counts of the shorter contexts. A rare expression, which neither class has counted well,
thus gets the same probability from both and speaks for neither. The score is a logistic curve of the difference of the
two log-likelihoods per letter, fitted on labelled rows that no model has counted.

Counts (of documents that hold a letter in its context, so that one text's repetitions count once) cover all labelled
rows outside the held-out fold. Tasks count their own rows first; what they shuffle is sorted lists of distinct grams,
with one entry for even the commonest. All grams, those of one document too, are in the model, which grows with the
labelled rows. Buckets by the two letters before a gram's own hold all that
longer contexts need; counts of shorter ones, at most 2**24 pairs of letters, are shared. Each bucket's part of the model
is a file in the shared folder, which workers map into memory, so that neither driver nor task ever holds the whole.

Defined cases: null or empty text has difference 0 and the score that the curve gives to it; a null doc_id and repeated
rows are kept, a row each; a doc_id with several labels counts with the larger; other columns are ignored; without
labels of both classes in two folds there is no model: every score is 0, no row is told toxic and keep() keeps all.
Every letter or digit of Unicode counts; those above U+07FF share 2048 codes by a hash.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm.compression import logistic

FOLDS, FOLD, CUT = 5, 0, 0.5
#: Labelled rows of a class in the curve at most, by a hash of doc_id.
CURVE_DOCS = 4000
#: Labelled rows up to which their ids are broadcast.
SMALL_ROWS = 2_000_000
#: Taken off the continuation counts of shorter contexts, and counts that a context leaves to the shared fallback besides the
#: discounted ones. Both, and that grams of one document stay, were chosen by cross-validation among the learning folds
#: (README); the held-out fold took no part.
DISCOUNT, SHARED = 1.0, 0.1
FLUSH = 4_000_000
#: Bytes of the model that a worker keeps where it cannot map files.
HELD = 256 << 20
#: Letters that are looked up in the model at once, about.
BATCH = 500_000
ORDER, BITS = 5, 12
PAIR, TRIPLE = np.uint64((1 << 2 * BITS) - 1), np.uint64((1 << 3 * BITS) - 1)


def _codes() -> np.ndarray:
    """12-bit codes of all characters: 0 for what ends a word, else the character or a hash of it."""
    own = np.arange(0x110000, dtype=np.uint64)
    hashed = common.mix(own) % np.uint64(1 << 11) + np.uint64(1 << 11)
    out = np.where(own < (1 << 11), own, hashed).astype(np.uint16)
    return np.where([chr(c).isalnum() for c in range(0x110000)], out, 0).astype(np.uint16)


CODES = _codes()


def grams_of(text: str) -> np.ndarray:
    """For every letter and word end of a text, that one in the lowest 12 bits and those before it in its word above."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    code = np.concatenate([CODES[points], np.zeros(1, np.uint16)])
    code = code[(code > 0) | np.concatenate([[False], code[:-1] > 0])]  # one end a word
    place = np.arange(len(code))
    last_end = np.maximum.accumulate(np.where(code == 0, place, -1))
    depth = place - np.concatenate([[-1], last_end[:-1]]) - 1 if len(code) else place  # letters before it in its word
    out = code.astype(np.uint64)
    for j in range(1, ORDER):
        before = np.concatenate([np.zeros(min(j, len(code)), np.uint16), code[:-j]]).astype(np.uint64)
        out |= np.where(depth >= j, before, 0).astype(np.uint64) << np.uint64(BITS * j)
    return out


def _buckets(grams: np.ndarray, n: int) -> np.ndarray:
    """One for all grams with the same two letters before their own."""
    return (common.mix((grams >> np.uint64(BITS)) & PAIR) % np.uint64(n)).astype(np.int64)


def _blobs(keys: np.ndarray, counts: list[np.ndarray], bucket: np.ndarray, n: int) -> Iterator[pd.DataFrame]:
    """A row for each bucket that has keys (ascending within it) and their counts."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    rows = [(b, common.pack_sorted(keys[o]), *(c[o].astype("<u4").tobytes() for c in counts)) for b in range(n) if len(o := order[ends[b] : ends[b + 1]])]
    if rows:
        yield pd.DataFrame(rows, columns=["bucket", "keys", *(f"c{i}" for i in range(len(counts)))])


def _merged(pdf: pd.DataFrame, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys of a bucket's rows, ascending, and the sums of their counts."""
    keys = np.concatenate([common.unpack_sorted(k) for k in pdf["keys"]])
    uniq, at = np.unique(keys, return_inverse=True)
    return uniq, [np.bincount(at, np.concatenate([np.frombuffer(x, "<u4") for x in pdf[f"c{i}"]])).astype(np.int64) for i in range(n)]


def _counted(rows: DataFrame, n: int) -> DataFrame:
    """Distinct grams of each task's rows with the documents of either class that hold them, by bucket."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = ([], []), 0

        def flush() -> Iterator[pd.DataFrame]:
            parts = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in held]
            uniq, at = np.unique(np.concatenate(parts), return_inverse=True)
            toxic = np.arange(len(at)) >= len(parts[0])
            counts = [np.bincount(at[~toxic], minlength=len(uniq)), np.bincount(at[toxic], minlength=len(uniq))]
            yield from _blobs(uniq, counts, _buckets(uniq, n), n)

        for pdf in frames:
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                held[label].append(np.unique(grams_of(text)))
                size += len(held[label][-1])
                if size >= FLUSH:
                    yield from flush()
                    held, size = ([], []), 0
        yield from flush()

    return rows.select("text", "label").mapInPandas(run, "bucket long, keys binary, c0 binary, c1 binary")


def _gram_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's grams with their sums, and the totals; also pairs of letters and how many letters come before each."""
    keys, (c0, c1) = _merged(pdf, 2)
    pairs, types = np.unique(np.unique(keys & TRIPLE) & PAIR, return_counts=True)
    return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "keys": [common.pack_sorted(keys)], "c0": [c0.astype("<u4").tobytes()], "c1": [c1.astype("<u4").tobytes()], "t0": [int(c0.sum())], "t1": [int(c1.sum())], **{f"n{i}{k}": [int((c == i).sum())] for i in (1, 2) for k, c in enumerate((c0, c1))}, "pairs": [common.pack_sorted(pairs)], "types": [types.astype("<u4").tobytes()]})


class Model:
    """Log-ratios of the two models, a file a bucket: of grams (ascending), and after contexts (ascending) of any other letter."""

    def __init__(self, folder: str, names: dict[int, str], n: int) -> None:
        self.folder, self.names, self.n, self.size = folder, names, n, 0
        self.held: OrderedDict[int, tuple[list[np.ndarray], int]] = OrderedDict()

    def _part(self, bucket: int) -> list[np.ndarray]:
        """grams, known, contexts, other; mapped where the folder is a local path, else those used last are held."""
        if bucket in self.held:
            self.held.move_to_end(bucket)
        else:
            files, path = fs.FileSystem.from_uri(f"{self.folder}/{self.names[bucket]}")
            local = isinstance(files, fs.LocalFileSystem)
            data = np.memmap(path, np.uint64, "r") if local else np.frombuffer(files.open_input_file(path).read(), np.uint64)
            a, b = int(data[0]), int(data[1])
            g, k, c, o = np.split(data[2:], np.cumsum([a, a, b]))
            self.held[bucket] = [g, k.view(np.float64), c, o.view(np.float64)], 0 if local else data.nbytes
            self.size += self.held[bucket][1]
            while self.size > HELD and len(self.held) > 1:
                self.size -= self.held.popitem(last=False)[1][1]
        return self.held[bucket][0]

    def _values(self, bucket: int, keys: np.ndarray) -> np.ndarray:
        grams, known, contexts, other = self._part(bucket)
        if not len(grams):
            return np.zeros(len(keys))
        g = np.minimum(np.searchsorted(grams, keys), len(grams) - 1)
        context = keys >> np.uint64(BITS)
        c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        return np.where(grams[g] == keys, known[g], np.where(contexts[c] == context, other[c], 0.0))

    def _batch(self, held: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(x) for x in held])
        keys, at = np.unique(np.concatenate(held), return_inverse=True)
        bucket, value = _buckets(keys, self.n), np.zeros(len(keys))
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.n + 1))
        for b in np.unique(bucket):
            if b in self.names:
                own = np.sort(order[ends[b] : ends[b + 1]])
                value[own] = self._values(int(b), keys[own])
        return np.bincount(np.repeat(np.arange(len(held)), sizes), value[at], len(held)) / np.maximum(sizes, 1)

    def ratios(self, texts: list[str | None]) -> np.ndarray:
        """The toxic less the ordinary log-likelihood of each text, per letter and word end."""
        out, held, size = [np.zeros(0)], [], 0
        for t in texts:
            held.append(grams_of(t or ""))
            size += len(held[-1])
            if size >= BATCH:
                out.append(self._batch(held))
                held, size = [], 0
        return np.concatenate([*out, self._batch(held)] if held else out)


def _discounted(keys: np.ndarray, types: np.ndarray, order: int, shared: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The shared probability of each key's letter after its context, from the types of letters before the keys."""
    context, where = np.unique(keys >> np.uint64(BITS), return_inverse=True)
    own = np.maximum(types - DISCOUNT, 0)
    every = np.bincount(where, types, len(context))
    rest = 1 - np.bincount(where, own, len(context)) / every
    return own / every[where] + rest[where] * fallback(keys, order, shared)


def fallback(grams: np.ndarray, order: int, shared: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """The shared probability of each gram's letter after the upper order - 2 letters of its context: continuation counts.

    shared: pairs of letters (ascending) and their probabilities, from all buckets; without it, grams are all there are.
    """
    if order <= 1:
        return np.full(len(grams), 1 / 256)
    if order == 3 and shared is not None:
        return shared[1][np.searchsorted(shared[0], grams & PAIR)]
    uniq, at, types = np.unique(grams & np.uint64((1 << BITS * (order - 1)) - 1), return_inverse=True, return_counts=True)
    return _discounted(uniq, types, order - 1, shared)[at]


def _shared(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of letters, ascending, and the shared probability of the second after the first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for a, b in zip(pdf["pairs"], pdf["types"], strict=True):
                yield pd.DataFrame({"pair": common.unpack_sorted(a).astype(np.int64), "types": np.frombuffer(b, "<u4").astype(np.int64)})

    rows = table.select("pairs", "types").mapInPandas(run, "pair long, types long").groupBy("pair").agg(F.sum("types").alias("types")).toArrow()
    pairs, types = (rows[c].to_numpy() for c in ("pair", "types"))
    order = np.argsort(pairs)
    pairs = pairs[order].astype(np.uint64)
    return pairs, _discounted(pairs, types[order], 2)


def train(rows: DataFrame, n: int) -> Model | None:
    """rows: text, label 0 or 1; n: buckets. None without text of both classes."""
    kinds = "bucket long, keys binary, c0 binary, c1 binary, t0 long, t1 long, n10 long, n11 long, n20 long, n21 long, pairs binary, types binary"
    table = common.written(_counted(rows, n).groupBy("bucket").applyInPandas(_gram_bucket, kinds), "toxicity-grams")
    total = table.agg(*(F.sum(c).alias(c) for c in ("t0", "t1", "n10", "n11", "n20", "n21"))).first()
    if not total.t0 or not total.t1:
        return None
    spark, totals = rows.sparkSession, (total.t0, total.t1)
    discounts = tuple(discount(total[f"n1{k}"], total[f"n2{k}"]) for k in (0, 1))
    sent, folder = spark.sparkContext.broadcast(_shared(table)), f"{common.shared_folder(spark)}/toxicity-model-{uuid.uuid4().hex}"
    common.dropped_later(spark, folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                name = uuid.uuid4().hex  # a task that runs again writes other files
                grams, known, contexts, other = fitted(common.unpack_sorted(row.keys), [np.frombuffer(c, "<u4").astype(float) for c in (row.c0, row.c1)], totals, discounts, sent.value)
                with files.open_output_stream(f"{path}/{name}") as out:
                    for x in (np.array([len(grams), len(contexts)], np.uint64), grams, known, contexts, other):
                        out.write(x.tobytes())
                yield pd.DataFrame({"bucket": [row.bucket], "name": [name]})

    names = table.select("bucket", "keys", "c0", "c1").mapInPandas(common.forgetting(run), "bucket long, name string").collect()
    sent.destroy()
    return Model(folder, {r["bucket"]: r["name"] for r in names}, n)


def discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once else 0.5


def fitted(grams: np.ndarray, counts: list[np.ndarray], totals: tuple[int, int], discounts: tuple[float, float], shared: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """A bucket's part of the model, of ascending grams with their counts in either class, out of the classes' totals."""
    # Counts of the larger class shrink to the smaller one's total, so that a rare gram is discounted away in both alike.
    least = min(totals)
    c = np.stack(counts) * np.array([[least / totals[0]], [least / totals[1]]])
    contexts, at = np.unique(grams >> np.uint64(BITS), return_inverse=True)
    every = np.stack([np.bincount(at, x, len(contexts)) for x in c])
    own = np.maximum(c - np.array(discounts)[:, None], 0) / (every[:, at] + SHARED)
    rest = 1 - np.stack([np.bincount(at, x, len(contexts)) for x in own])
    p = own + rest[:, at] * fallback(grams, ORDER, shared)
    return grams, np.log(p[1] / p[0]), contexts, np.log(rest[1] / rest[0])


def ratios(docs: DataFrame, model: Model, more: list[str]) -> DataFrame:
    """doc_id, `more` and difference of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            out = sent.value.ratios(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(out, pa.float64())], ["doc_id", *more, "difference"])

    cast = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *more)
    kinds = "".join(f"{c} {k}, " for c, k in cast.dtypes[2:])
    return cast.mapInArrow(common.forgetting(run), f"doc_id long, {kinds}difference double")


def with_labels(docs: DataFrame, labels: DataFrame, label: str, where: Column) -> DataFrame:
    """doc_id, text, label of labelled rows; the labels are broadcast if they are few."""
    one = labels.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL").where(where)
    one = common.written(one, "toxicity-labels")
    one = F.broadcast(one) if one.count() <= SMALL_ROWS else one
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(one, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, fold: int = FOLD) -> tuple[Model, tuple[float, float, float]] | None:
    """The model and its curve (scale, slope, intercept), from labelled rows outside the held-out fold; None without both classes."""
    idc, part = F.col("doc_id"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    n: dict[int, dict[int, int]] = {}
    own = labels.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    for r in own.groupBy(part.alias("part"), "label").count().where(F.col("part") != fold).collect():
        n.setdefault(r.part, {})[r.label] = r["count"]
    # The curve takes the first fold that has both classes and leaves both to the model.
    rest = lambda k: {x for i, c in n.items() if i != k for x in c}
    curve = next((k for k in sorted(n, key=lambda k: (k - fold) % folds) if len(n[k]) == 2 == len(rest(k))), None)
    if curve is None:
        return None
    train_rows = with_labels(docs, labels, label, ~common.held_out(idc, folds, fold) & ~common.held_out(idc, folds, curve))
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = train(train_rows, max(common.partitions(docs.sparkSession), volume // (32 << 20)))
    if model is None:
        return None
    some = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.when(F.col("label") == 1, min(1.0, CURVE_DOCS / n[curve][1])).otherwise(min(1.0, CURVE_DOCS / n[curve][0])) * (1 << 20)
    rows = ratios(with_labels(docs, labels, label, common.held_out(idc, folds, curve) & some), model, ["label"]).collect()
    x, y = (np.array([r[c] for r in rows], float) for c in ("difference", "label"))
    if len(set(y)) < 2:  # labels of rows that docs does not hold
        return None
    weight = np.where(y == 1, max(1.0, n[curve][1] / CURVE_DOCS), max(1.0, n[curve][0] / CURVE_DOCS))
    scale, slope, intercept = logistic(x, y, weight)
    return model, (scale, max(slope, 0.0), intercept)  # a likelier toxic reading never speaks against toxicity


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """doc_id, difference, score of every row."""
    fitted_to = fit(docs, labels, label, folds, fold)
    if fitted_to is None:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0.0).alias("difference"), F.lit(0.0).alias("score"))
    model, (scale, slope, intercept) = fitted_to
    z = F.col("difference") / scale * slope + intercept
    return ratios(docs, model, []).select("doc_id", "difference", (1 / (1 + F.exp(-z))).alias("score"))


def keep(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below the cut."""
    fitted_to = fit(docs, labels)
    if fitted_to is None:
        return docs
    model, (scale, slope, intercept) = fitted_to
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            z = sent.value.ratios(b.column(at).to_pylist()) / scale * slope + intercept
            yield b.filter(pa.array(1 / (1 + np.exp(-z)) < cut))

    return docs.mapInArrow(common.forgetting(run), docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learnt outside the held-out fold."""
    got = score(common.documents(spark, sf_dir), common.labels(spark, sf_dir))
    return got.select("doc_id", common.held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "difference")

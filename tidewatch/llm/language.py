"""Language by prediction by partial matching: the language whose byte model codes a text in the fewest bits.

Each language has a context tree over the bytes of lower-cased text, of contexts of ORDER bytes down to none. A byte seen
c times after a context of which T bytes with D different ones are known costs -log2 of c / (T + D); another one costs
the escape, -log2 of D / (T + D), and goes on with the context shorter by its first byte; a context that is not known
costs nothing and goes on; below the empty context a byte costs 8 bits. Counts are frozen before any text is scored, and
START bytes, which no text holds, come before its first.

Counts cover all rows to learn from. Tasks merge theirs before they send them, a row for each distinct window of ORDER
bytes and the next; sums are taken natively, and windows of shorter contexts are sums of those. Windows that share the
two bytes before their last go to one bucket, which makes their part of the model: for windows of every order their
costs in all languages, escapes included, so that a window is looked up once. At most 2**16 pairs of bytes are left,
with windows of one context byte or none. Each bucket is a file in the shared folder; workers map it, or, where the
folder is not a local path, keep the parts used last within HELD bytes. So the model grows with the rows, and neither
driver nor task holds it whole.

Defined cases: a null text, or one without a letter, is `und` with score 0, and so is every text if there is nothing to
learn from; rows to learn from whose text or lang is null teach nothing; a null doc_id counts as empty text in folds;
repeated rows count as often as they come; equal code lengths go to the smaller name; other columns are ignored. Names
of languages are few: a bucket holds a cost for every window and language.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

FOLDS, FOLD, NONE = 4, 2, "und"
ORDER, START = 4, 0xFF
#: Windows that a task counts before it merges them; merged windows that it holds before it sends them; windows scored at once.
FLUSH, SEND, BATCH = 2_000_000, 4_000_000, 500_000
#: Bytes of parts of the model that a worker keeps where it cannot map files.
HELD = 256 << 20
WINDOWS = [np.uint64((1 << 8 * (k + 1)) - 1) for k in range(ORDER + 1)]


def windows_of(text: str) -> np.ndarray:
    """For every byte of the lower-cased text, that byte in the lowest 8 bits and the ORDER bytes before it above."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    padded = np.concatenate([np.full(ORDER, START, np.uint8), data]).astype(np.uint64)
    out = padded[ORDER:].copy()
    for j in range(1, ORDER + 1):
        out |= padded[ORDER - j : len(padded) - j] << np.uint64(8 * j)
    return out


def buckets(windows: np.ndarray, n: int) -> np.ndarray:
    """One for all windows with the same two bytes before their last."""
    return (common.mix((windows >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(n)).astype(np.int64)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their n (of one row or several)."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(n[..., order], start, -1) if len(start) else n[..., :0]


def counted(rows: DataFrame) -> DataFrame:
    """lang, w, n: how often each window occurs in the texts of a language (rows: text, lang, neither null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: dict[str, list[np.ndarray]] = {}
        merged: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def merge() -> None:
            for lang, parts in fresh.items():
                w, n = np.unique(np.concatenate(parts), return_counts=True)
                held = merged.get(lang)
                merged[lang] = (w, n) if held is None else summed(np.concatenate([held[0], w]), np.concatenate([held[1], n]))
            fresh.clear()

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, (w, n) in merged.items():
                for a in range(0, len(w), BATCH):
                    part = slice(a, a + BATCH)
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(w[part]), np.int32))), pa.array(w[part].view(np.int64)), pa.array(n[part])], ["lang", "w", "n"])
            merged.clear()

        for b in common.slices(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fresh.setdefault(lang, []).append(windows_of(text))
                size += len(fresh[lang][-1])
                if size >= FLUSH:
                    merge()
                    size = 0
                    if sum(len(w) for w, _ in merged.values()) >= SEND:
                        yield from sent()
        merge()
        yield from sent()

    parts = rows.select("text", "lang").mapInArrow(common.forgetting(run), "lang string, w long, n long")
    return parts.groupBy("lang", "w").agg(F.sum("n").alias("n"))


def ladder(keys: np.ndarray, n: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of one order (ascending keys; n: languages x keys; below: their costs one order down): the costs of
    all windows, the contexts, ascending, and what it costs to leave each of them."""
    context = keys >> np.uint64(8)
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), context[1:] != context[:-1]]))
    at = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(keys))))
    total, kinds = np.add.reduceat(n, start, 1), np.add.reduceat((n > 0).astype(np.int64), start, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        leave = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
        own = np.log2((total + kinds)[:, at] / n)
    return np.where(n > 0, own, leave[:, at] + below), context[start], leave


class Part:
    """Costs of windows, and of leaving contexts, by order: ascending keys and a column of costs a language."""

    def __init__(self, steps: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.steps = steps

    def costs(self, windows: np.ndarray, below: "Part | None") -> np.ndarray:
        """Bits of each window (languages x windows): from the highest order that has it, else by escapes down to `below`."""
        out, left = np.zeros((self.languages(), len(windows))), np.arange(len(windows))
        for k in sorted(self.steps, reverse=True):
            keys, cost, contexts, leave = self.steps[k]
            w = windows[left] & WINDOWS[k]
            i = np.minimum(np.searchsorted(keys, w), len(keys) - 1)
            hit = keys[i] == w
            out[:, left[hit]] += cost[:, i[hit]]
            left, context = left[~hit], w[~hit] >> np.uint64(8)
            i = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            hit = contexts[i] == context
            out[:, left[hit]] += leave[:, i[hit]]
        if len(left):
            out[:, left] += below.costs(windows[left], None) if below is not None else 8.0
        return out

    def languages(self) -> int:
        return next(iter(self.steps.values()))[1].shape[0]

    def to_bytes(self) -> Iterator[bytes]:
        yield np.array([self.languages(), len(self.steps), *(x for k, s in self.steps.items() for x in (k, len(s[0]), len(s[2])))], np.uint64).tobytes()
        for keys, cost, contexts, leave in self.steps.values():
            for x in (keys, cost.astype(np.float64), contexts, leave.astype(np.float64)):
                yield np.ascontiguousarray(x).tobytes()

    @staticmethod
    def of(data: np.ndarray) -> "Part":
        langs, n = int(data[0]), int(data[1])
        head, at, steps = data[2 : 2 + 3 * n].reshape(n, 3).astype(int), 2 + 3 * n, {}
        for k, a, b in head.tolist():
            keys, cost, contexts, leave = np.split(data[at : at + (a + b) * (1 + langs)], np.cumsum([a, a * langs, b]))
            steps[k] = keys, cost.view(np.float64).reshape(langs, a), contexts, leave.view(np.float64).reshape(langs, b)
            at += (a + b) * (1 + langs)
        return Part(steps)


def small_part(keys: np.ndarray, n: np.ndarray) -> Part:
    """The part of one context byte and none, from the sums of all pairs of bytes."""
    single, m = summed(keys & WINDOWS[0], n)
    cost0, context0, leave0 = ladder(single, m, np.full(m.shape, 8.0))
    cost1, context1, leave1 = ladder(keys, n, cost0[:, np.searchsorted(single, keys & WINDOWS[0])])
    return Part({1: (keys, cost1, context1, leave1), 0: (single, cost0, context0, leave0)})


def large_part(keys: np.ndarray, n: np.ndarray, small: Part) -> Part:
    """A bucket's part, of its windows of ORDER context bytes (ascending) and their sums in all languages."""
    orders = {ORDER: (keys, n)}
    for k in range(ORDER - 1, 1, -1):
        orders[k] = summed(keys & WINDOWS[k], n)
    steps, last = {}, None
    for k in range(2, ORDER + 1):
        own, m = orders[k]
        below = small.costs(own, None) if last is None else last[1][:, np.searchsorted(last[0], own & WINDOWS[k - 1])]
        cost, contexts, leave = ladder(own, m, below)
        last = own, cost
        steps[k] = own, cost, contexts, leave
    return Part(steps)


class Model:
    """Names of languages, the small part, and a file for each bucket."""

    def __init__(self, langs: list[str], small: Part, folder: str, names: dict[int, str], n: int) -> None:
        self.langs, self.small, self.folder, self.names, self.n = langs, small, folder, names, n
        self.held: OrderedDict[int, tuple[Part, int]] = OrderedDict()
        self.size = 0

    def part(self, bucket: int) -> Part:
        if bucket in self.held:
            self.held.move_to_end(bucket)
            return self.held[bucket][0]
        files, path = fs.FileSystem.from_uri(f"{self.folder}/{self.names[bucket]}")
        local = isinstance(files, fs.LocalFileSystem)
        data = np.memmap(path, np.uint64, "r") if local else np.frombuffer(files.open_input_file(path).read(), np.uint64)
        self.held[bucket] = Part.of(data), 0 if local else data.nbytes
        self.size += self.held[bucket][1]
        while self.size > HELD and len(self.held) > 1:
            self.size -= self.held.popitem(last=False)[1][1]
        return self.held[bucket][0]

    def _batch(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs of distinct windows, and which of them each window is."""
        uniq, at = np.unique(windows, return_inverse=True)
        bucket, out = buckets(uniq, self.n), np.zeros((len(self.langs), len(uniq)))
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(self.n + 1))
        for b in np.unique(bucket).tolist():
            own = order[ends[b] : ends[b + 1]]
            out[:, own] = self.part(b).costs(uniq[own], self.small) if b in self.names else self.small.costs(uniq[own], None)
        return out, at

    def bits(self, texts: list[str]) -> np.ndarray:
        """The code length of each text in each language (texts x languages)."""
        total, held, size = np.zeros((len(texts), len(self.langs))), [], 0

        def settle() -> None:
            if held:
                cost, at = self._batch(np.concatenate([w for _, w in held]))
                row = np.repeat([i for i, _ in held], [len(w) for _, w in held])
                for k in range(len(self.langs)):
                    total[:, k] += np.bincount(row, cost[k][at], len(texts))
            held.clear()

        for i, text in enumerate(texts):
            w = windows_of(text)
            for a in range(0, len(w), BATCH):
                held.append((i, w[a : a + BATCH]))
                size += len(held[-1][1])
                if size >= BATCH:
                    settle()
                    size = 0
        settle()
        return total


def train(rows: DataFrame) -> Model | None:
    """The model of rows (text, lang); None if there are none to learn from."""
    spark = rows.sparkSession
    table = common.written(counted(rows.where("text IS NOT NULL AND lang IS NOT NULL")), "language-windows")
    langs = sorted(r.lang for r in table.select("lang").distinct().collect())
    if not langs:
        return None
    place = {x: i for i, x in enumerate(langs)}

    def matrix(key: np.ndarray, lang: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = np.zeros((len(langs), len(key)), np.int64)
        every[[place[x] for x in lang], np.arange(len(key))] = n
        return summed(key.astype(np.uint64), every)

    pairs = table.groupBy("lang", F.col("w").bitwiseAND(0xFFFF).alias("w")).agg(F.sum("n").alias("n")).toArrow()
    small = small_part(*matrix(pairs["w"].to_numpy(), pairs["lang"].to_pylist(), pairs["n"].to_numpy()))
    n, folder = max(common.partitions(spark), table.count() // SEND), f"{common.shared_folder(spark)}/language-model-{uuid.uuid4().hex}"
    common.dropped_later(spark, folder)
    sent = spark.sparkContext.broadcast(small)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        name = uuid.uuid4().hex  # a task that runs again writes another file
        part = large_part(*matrix(pdf["w"].to_numpy(), pdf["lang"].tolist(), pdf["n"].to_numpy()), sent.value)
        with files.open_output_stream(f"{path}/{name}") as out:
            for x in part.to_bytes():
                out.write(x)
        return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "name": [name]})

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf.assign(bucket=buckets(pdf["w"].to_numpy().view(np.uint64), n))

    names = table.select("lang", "w", "n").mapInPandas(dealt, "lang string, w long, n long, bucket long").groupBy("bucket").applyInPandas(run, "bucket long, name string").collect()
    sent.destroy()
    return Model(langs, small, folder, {r["bucket"]: r["name"] for r in names}, n)


def languages(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score of every row: the language of the least code length and its share of the likelihood."""
    cast = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    if model is None:
        return cast.select("doc_id", F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            texts = b.column(1).to_pylist()
            said = np.array([any(map(str.isalpha, t or "")) for t in texts])
            bits = sent.value.bits([t if s else "" for t, s in zip(texts, said, strict=True)])
            best = bits.argmin(1)
            share = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
            names = [sent.value.langs[i] if s else NONE for i, s in zip(best, said, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.where(said, share, 0.0))], ["doc_id", "lang_pred", "score"])

    return cast.mapInArrow(common.forgetting(run), "doc_id long, lang_pred string, score double")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt outside the held-out fold."""
    docs = common.documents(spark, sf_dir)
    held = common.held_out(F.col("doc_id"), FOLDS, FOLD)
    model = train(docs.where(~held).select("text", "lang"))
    return languages(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")

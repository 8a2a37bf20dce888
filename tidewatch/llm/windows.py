"""Blocks of documents, hashes of their word windows, and exchanges of hashes between blocks.

blocks() writes the documents as rows of about BLOCK bytes of text, compressed; later passes read them without shuffling
text. A block's windows are hashed with numpy. An exchange sends each block's distinct hashes, once and sorted, to
shards by hash range, and brings back what the shards make of the merged lists, in the order in which they were sent.
However often a window occurs, it makes one entry a block, so no shard grows with a hot window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import common

BLOCK = 4 << 20
#: Bits of a block's number for its place in its partition, and of a document's number for its place in its block, which
#: holds at most BLOCK / 64 of them: numbers of documents fit 64 bits for 2**30 partitions.
PLACES, ROWS = 16, 17
#: Entries that a shard merges, about.
SHARD_ENTRIES = 4_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)
OFF = np.uint64(0xD1B54A32D192ED03)


def blocks(docs: DataFrame, name: str) -> DataFrame:
    """uid, n, body: documents (doc_id as long, text, in the rows' order) by block; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list = []
        size = 0
        press = zstandard.ZstdCompressor(level=3)

        def made() -> pa.RecordBatch:
            data = pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.large_string())], ["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, data.schema) as w:
                w.write_batch(data)
            return pa.RecordBatch.from_arrays([pa.array([(part << PLACES) | k], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([press.compress(sink.getvalue())], pa.binary())], ["uid", "n", "body"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(text or "") + 64
                if size >= BLOCK:
                    yield made()
                    ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield made()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return common.written(rows.mapInArrow(common.forgetting(run), "uid long, n long, body binary"), name)


def opened(body: bytes) -> tuple[list[int | None], list[str | None]]:
    data = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(body)).read_all()
    return data.column(0).to_pylist(), data.column(1).to_pylist()


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space; lower folds A-Z alone."""
    data = (text or "").encode()
    return (data.lower() if lower else data).split()


class Windows:
    """The windows of `width` words of a block's documents: hashes of all, and where each document's words lie."""

    def __init__(self, texts: list[str | None], width: int, lower: bool = False) -> None:
        split = [words_of(t, lower) for t in texts]
        self.width, self.counts = width, np.array([len(w) for w in split], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        #: Two independent 64-bit hashes of each word, the halves of a 128-bit one.
        self.halves = np.frombuffer(b"".join([h for w in split for h in map(xxhash.xxh3_128_digest, w)]), "<u8").reshape(-1, 2)
        self.words = self.halves[:, 0]
        own = np.maximum(self.counts - width + 1, 0)
        #: Positions in `words` at which a window starts, ascending, and the documents that these belong to.
        self.doc = np.repeat(np.arange(len(split)), own)
        self.at = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(self.starts[:-1], own)

    def hashes(self, half: int = 0) -> np.ndarray:
        """One for each window; equal windows have equal ones. Either half of the words' hashes gives independent ones."""
        n, odd = len(self.words), (ODD, OFF)[half]
        if not len(self.at):
            return np.zeros(0, np.uint64)
        back = np.multiply.accumulate(np.full(n + 1, np.uint64(pow(int(odd), -1, 1 << 64)), np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(self.halves[:, half] ^ odd) * back[:n], dtype=np.uint64)])
        forth = np.multiply.accumulate(np.full(n + 1, odd, np.uint64))
        return common.mix((sums[self.at + self.width] - sums[self.at]) * forth[self.at])


def shards(entries: int, df: DataFrame) -> int:
    return max(common.partitions(df.sparkSession), -(-entries // SHARD_ENTRIES))


def split_by(hashes: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """The non-empty ones of n even ranges of ascending hashes (n below 2**32), found without a walk over all ranges."""
    if not len(hashes):
        return []
    shard = ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    at = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
    return [(int(shard[a]), slice(a, b)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def exchange(sent: DataFrame, merge: Callable[[pd.DataFrame], list[bytes]]) -> DataFrame:
    """sent: shard, uid and blobs. merge gets a shard's rows and gives an answer for each; back: uid, answers (shard, answer)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", ignore_index=True)
        return pd.DataFrame({"uid": pdf["uid"], "shard": pdf["shard"], "answer": merge(pdf)})

    back = sent.groupBy("shard").applyInPandas(run, "uid long, shard long, answer binary")
    return back.groupBy("uid").agg(F.collect_list(F.struct("shard", "answer")).alias("answers"))


def answers_of(row: list | None) -> list[bytes]:
    """The answers in the order of the shards, which is that of the ascending hashes."""
    return [bytes(x["answer"]) for x in sorted(row, key=lambda x: x["shard"])] if row is not None else []


def bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + np.packbits(flags).tobytes()


def flags_of(answers: list[bytes]) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(a, np.uint8, offset=8), count=int.from_bytes(a[:8], "little")).astype(bool) for a in answers]
    return np.concatenate(parts) if parts else np.zeros(0, bool)

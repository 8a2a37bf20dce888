"""Packing along a space-filling curve.

Every document gets a point in DIMS dimensions: its hashed bag of tokens, weighted by the square root of the counts and
normalised, times a fixed random matrix. Points become keys of the Hilbert curve, documents are range-sorted by key, and
the tokens of neighbours along the curve are laid end to end and cut every `length` tokens. So sequences hold similar
documents, only the last one is padded, and a document is cut only where a sequence ends.

Two passes after the tokens are written: the quantiles of the keys give ranges of about RANGE_TOKENS tokens, whose sums
give each range's place in the stream; then each range is sorted and cut on its own. Keys end in bits of a hash of the
document, so that a large group of copies, which has one place on the curve, still spreads over ranges. What reaches
the driver is two numbers a range.

Defined cases: null or empty text has only the end id; a null doc_id is kept; repeated rows are packed each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common

LENGTH, END_ID = 4096, 2
DIMS, HILBERT_BITS, HASHED, TIE_BITS = 4, 12, 1024, 14
#: Tokens of a range, unless that made more than MOST_RANGES; ranges are sorted and cut in a stream, so memory does not grow with them.
RANGE_TOKENS, MOST_RANGES = 4 << 20, 1 << 16
#: Bytes that a task keeps words and their ids in, about, in either of two generations, and what an entry takes besides its own bytes.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 200


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes bytes with: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordTokens(dict):
    """The ids (little-endian, of one width) of a word, the bytes between ASCII white space, kept for the words seen of late.

    When the kept words reach CACHE_BYTES they become the older generation, from which words that come again return, so
    the common ones stay and the rare ones go.

    The tokenizer's words never cross white space, so ids of a text are those of its words. Words of plain Latin letters
    go straight to its model, which spares them the tokenizer's general normalisation; others take the whole way.
    """

    plain = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
    marks = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'")
    ended = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)").fullmatch

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.older: dict[bytes, bytes] = {}
        self.held = 0
        self.size = max(self.tokenizer.get_vocab().values(), default=0) + 1
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.packed = struct.Struct("<H" if self.kind == "<u2" else "<I").pack
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        # The short way is taken only if the tokenizer proves to treat such words so.
        tries = ["Example", "größe", "Été", "niño", "zebraword", "Àÿ", "we"]
        try:
            self.short = all(self._model(w) == self._whole(w) for w in tries) and all(self._whole(f"{a}{p}") == self._model(a) + self._whole(p) for a, p in zip(tries, (".***", ",", "!!", "?!", "|", '$&"', "[#"), strict=True))
        except Exception:  # a model of another kind
            self.short = False

    def _model(self, word: str) -> list[int]:
        return [t.id for t in self.tokenize(word.lower().encode().decode("latin-1").translate(self.letters))]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, raw: bytes) -> bytes:
        if self.held >= CACHE_BYTES:
            self.older = dict(self)
            self.clear()
            self.held = 0
        made = self.older.get(raw)
        if made is None:
            made = self._made(raw)
        self[raw] = made
        self.held += len(raw) + len(made) + ENTRY_BYTES
        return made

    def _made(self, raw: bytes) -> bytes:
        if self.short and raw.isalpha():  # ASCII letters alone are their own byte letters
            small = raw.lower()
            return self[small] if small != raw else b"".join([self.packed(t.id) for t in self.tokenize(raw.decode())])
        if self.short and (head := raw.rstrip(self.marks)).isalpha() and len(head) < len(raw):
            return self[head.lower()] + self[raw[len(head) :]]
        word = raw.decode()
        if self.short and self.plain(word):
            small = word.lower()
            return self[small.encode()] if small != word else b"".join(map(self.packed, self._model(word)))
        if self.short and (m := self.ended(word)):
            return self[m[1].lower().encode()] + self[m[2].encode()]
        return b"".join(map(self.packed, self._whole(word)))

    def forget(self) -> None:
        self.clear()
        self.older, self.held = {}, 0

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.encode().split()))


_KEPT: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One tokenizer for each worker process; its words go when a task ends."""
    if path not in _KEPT:
        _KEPT[path] = WordTokens(path)
    return _KEPT[path]


def _forget() -> None:
    for kept in _KEPT.values():
        kept.forget()


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Keys of rows of non-negative integers of `bits` bits along the Hilbert curve (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projection() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((HASHED, DIMS))


def curve_key(raw: list[bytes], kind: str, places: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The Hilbert keys of documents' ids, given as bytes; `places` holds the place of each id in a bag."""
    sizes = [len(r) // np.dtype(kind).itemsize for r in raw]
    at = places[np.frombuffer(b"".join(raw), kind)] + np.repeat(np.arange(len(raw)) * HASHED, sizes)
    bags = np.sqrt(np.bincount(at, minlength=len(raw) * HASHED)).reshape(-1, HASHED)
    points = (bags @ matrix) / np.maximum(np.sqrt(np.array(sizes)), 1e-12)[:, None]  # squared, the roots of the counts sum to the size
    side = 1 << HILBERT_BITS
    return hilbert(np.clip((points + 4) / 8 * side, 0, side - 1).astype(np.int64), HILBERT_BITS)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, key, tokens, ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, matrix = word_tokens(path), projection()
        places = (common.mix(np.arange(max(words.size, END_ID + 1), dtype=np.uint64)) & np.uint64(HASHED - 1)).astype(np.int64)
        end = np.array([END_ID], words.kind).tobytes()
        width = len(end)
        mask = (1 << TIE_BITS) - 1
        for part in common.slices(batches, 512):
            raw = [words.ids(t or "") + end for t in part.column(1).to_pylist()]
            key = (curve_key(raw, words.kind, places, matrix) << TIE_BITS) | (part.column(2).to_numpy() & mask)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(key), pa.array([len(r) // width for r in raw], pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "key", "tokens", "ids"])

    tie = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), tie).mapInArrow(common.forgetting(run, _forget), "doc_id long, key long, tokens long, ids binary")


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids of every piece."""
    rows = common.written(tokenized(docs, path or tokenizer_path()), "packing-tokens")
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    n = min(MOST_RANGES, max(1, -(-total // RANGE_TOKENS), min(common.partitions(docs.sparkSession), -(-total // (64 * length)))))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n)).first()[0] if n > 1 else []
    ranged = _ranged(rows, np.unique(np.array(cuts or [], np.int64)))
    starts, at = {}, 0
    for r, tokens in sorted(map(tuple, _ranged(rows.select("key", "tokens"), np.unique(np.array(cuts or [], np.int64))).groupBy("range").agg(F.sum("tokens")).collect())):
        starts[r], at = at, at + tokens
    laid = ranged.repartition(n, "range").sortWithinPartitions("range", "key", "doc_id", "tokens", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, at = None, None, 0
        for b in common.slices(batches):
            out: list[list] = [[] for _ in range(8)]
            for doc_id, tokens, raw, r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if r != now:
                    now, at = r, starts[r]
                kind = "<u2" if len(raw) == 2 * tokens else "<u4"
                ids, start = np.frombuffer(raw, kind), 0
                while start < tokens:
                    k = min(tokens - start, length - at % length)
                    piece = ids[start : start + k]
                    for column, value in zip(out, (doc_id, start, k, zlib.crc32(piece.astype("<u4").tobytes()), tokens, at // length, at % length, piece.astype("<u4").tobytes()), strict=True):
                        column.append(value)
                    start, at = start + k, at + k
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:7]), pa.array(out[7], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    kinds = ", ".join(f"`{c}` long" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"))
    return laid.select("doc_id", "tokens", "ids", "range").mapInArrow(common.forgetting(run), kinds + ", ids binary")


def _ranged(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    """rows with range, the number of ascending cuts that are at or below the key."""
    at = rows.columns.index("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("range", pa.array(np.searchsorted(cuts, b.column(at).to_numpy(), "right"), pa.int64()))

    kinds = ", ".join(f"{c} {k}" for c, k in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, range long")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, without their ids."""
    return pack(common.documents(spark, sf_dir)).drop("ids")

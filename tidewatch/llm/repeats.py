"""Removal of word windows that occur more than once, by a count-min prefilter.

First pass: every block of documents counts its windows and sends its sketch, as the CELL_BITS-bit keys of the windows
it holds and whether each occurs once or more; a key gives the window's cell in each of the SKETCH_ROWS rows. A shard of
the key space owns one count-min sketch of fixed width, SKETCH_ROWS x SKETCH_CELLS counters, into which it adds all
blocks' sketches; the least of a window's counters is its estimate, never below the true count, and goes back to the
blocks as a bit: once, or more. So a window estimated once is certainly unique. Sketches travel sparse, two or three
bytes a window, as dense ones of a width that fits the corpus would not fit the blocks. Second pass: blocks send
128-bit hashes of the windows estimated as repeated; shards group them exactly, up to that hash, whose halves come from
independent hashes of the words, and answer with bits again. Last pass: blocks remove the words that repeated windows
cover.

No step gathers a window's occurrences: a block sends each distinct window once, and counts its own repetitions itself.
Blocks are written once, so a lost executor costs the recomputation of single tasks.

Defined cases: null or empty text has no words and nothing removed; a text shorter than a window loses nothing; a null
doc_id is kept; repeated rows are documents of their own, so their windows are repeated; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm import windows as win

WIDTH, CELL_BITS = 35, 40
SKETCH_ROWS, SKETCH_CELLS = 4, 1 << 23
CELL = np.uint64(64 - CELL_BITS)


def estimates(keys: np.ndarray, counts: np.ndarray, rows: int = SKETCH_ROWS, cells: int = SKETCH_CELLS) -> np.ndarray:
    """For each key the least of its counters, once all counts are added to a sketch of `rows` rows of `cells` counters."""
    least = np.full(len(keys), np.iinfo(np.uint32).max, np.uint32)
    for r in range(rows):
        at = (common.mix(keys + np.uint64(r + 1) * win.ODD) % np.uint64(cells)).astype(np.int64)
        row = np.zeros(cells, np.uint32)
        np.add.at(row, at, counts)
        least = np.minimum(least, row[at])
    return least


def _merged_counts(pdf: pd.DataFrame) -> list[bytes]:
    """A bit for each key that a block sent: whether the merged sketch estimates two or more."""
    lists = [common.unpack_sorted(x) for x in pdf["cells"]]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(c)) for x, c in zip(pdf["twice"], lists, strict=True)]
    found = estimates(np.concatenate(lists), np.concatenate(twice).astype(np.uint32) + np.uint32(1)) >= 2
    ends = np.cumsum([0, *map(len, lists)])
    return [win.bits(found[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _merged_windows(pdf: pd.DataFrame) -> list[bytes]:
    """A bit for each window that a block sent: whether another block sent it too."""
    first = np.concatenate([common.unpack_sorted(x) for x in pdf["cells"]])
    second = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["rest"]])
    ends = np.cumsum([0, *(len(x) // 8 for x in pdf["rest"])])
    order = np.lexsort((second, first))
    same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
    found = np.zeros(len(first), bool)
    found[order[1:]] |= same
    found[order[:-1]] |= same
    return [win.bits(found[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _cells(w: win.Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's distinct cells (as hashes without their lower bits), where each window's is, and their counts."""
    cells = (w.hashes() >> CELL) << CELL
    return np.unique(cells, return_inverse=True, return_counts=True)


def _suspects(w: win.Windows, counted: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows (places) of repeated cells; their distinct hashes in two parts, and where each one's is."""
    _, at, _ = _cells(w)
    flags = win.flags_of(counted)
    place = np.flatnonzero(flags[at]) if len(at) else np.zeros(0, np.int64)
    first, second = w.hashes()[place], w.hashes(1)[place]
    order = np.lexsort((second, first))
    f, s = first[order], second[order]
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (s[1:] != s[:-1])]) if len(f) else np.zeros(0, bool)
    which = np.empty(len(place), np.int64)
    which[order] = np.cumsum(new) - 1
    return place, f[new], s[new], which


def _removed(w: win.Windows, counted: list[bytes], grouped: list[bytes]) -> np.ndarray:
    """Whether each word of the block is covered by a repeated window."""
    place, first, _, which = _suspects(w, counted)
    here = np.bincount(which, minlength=len(first)) > 1
    repeated = place[(here | win.flags_of(grouped))[which]] if len(place) else place
    edges = np.zeros(len(w.words) + 1, np.int64)
    np.add.at(edges, w.at[repeated], 1)
    np.add.at(edges, w.at[repeated] + w.width, -1)
    return np.cumsum(edges)[:-1] > 0


def deduplicate(docs: DataFrame, width: int = WIDTH, text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with text, kept: the words left, joined by a space."""
    blocks = win.blocks(docs, "repeat-blocks")
    letters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = win.shards(letters // 5, docs)

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for uid, body in zip(pdf["uid"], pdf["body"], strict=True):
                cells, _, counts = _cells(win.Windows(win.opened(body)[1], width))
                rows = [(s, uid, common.pack_sorted(cells[k] >> CELL), np.packbits(counts[k] > 1).tobytes()) for s, k in win.split_by(cells, n)]
                yield pd.DataFrame(rows, columns=["shard", "uid", "cells", "twice"])

    def suspects(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for uid, body, counted in zip(pdf["uid"], pdf["body"], pdf["counted"], strict=True):
                _, first, second, _ = _suspects(win.Windows(win.opened(body)[1], width), win.answers_of(counted))
                rows = [(s, uid, common.pack_sorted(first[k]), second[k].tobytes()) for s, k in win.split_by(first, n)]
                yield pd.DataFrame(rows, columns=["shard", "uid", "cells", "rest"])

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for body, counted, grouped in zip(pdf["body"], pdf["counted"], pdf["grouped"], strict=True):
                ids, texts = win.opened(body)
                w = win.Windows(texts, width)
                gone = _removed(w, win.answers_of(counted), win.answers_of(grouped))
                kept = []
                for t, a, b in zip(texts, w.starts, w.starts[1:], strict=False):
                    own = win.words_of(t)
                    kept.append(b" ".join(x for x, g in zip(own, gone[a:b].tolist(), strict=True) if not g) if gone[a:b].any() else b" ".join(own))
                out = {"doc_id": pd.array(ids, "Int64"), "n_words": w.counts, "n_removed": [int(gone[a:b].sum()) for a, b in zip(w.starts, w.starts[1:], strict=False)], "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}
                yield pd.DataFrame(out | ({"kept": [k.decode() for k in kept]} if text else {}))

    small = "shard long, uid long, cells binary, "
    counted = common.written(win.exchange(blocks.select("uid", "body").mapInPandas(common.forgetting(sketch), small + "twice binary"), _merged_counts), "repeat-counted")
    both = blocks.join(counted.withColumnRenamed("answers", "counted"), "uid", "left").select("uid", "body", "counted")
    grouped = common.written(win.exchange(both.mapInPandas(common.forgetting(suspects), small + "rest binary"), _merged_windows), "repeat-grouped")
    last = both.join(grouped.withColumnRenamed("answers", "grouped"), "uid", "left")
    return last.select("body", "counted", "grouped").mapInPandas(common.forgetting(apply), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * text)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps of its words."""
    return deduplicate(common.documents(spark, sf_dir), text=False)


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
h AS (SELECT p.r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM p JOIN d USING (r)),
t AS (SELECT r, i FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT r, i + k AS i FROM t, range(0, 35) AS s(k)),
g AS (SELECT r, list(i) AS gone FROM gone GROUP BY r),
k AS (SELECT doc_id, len(w) AS n, len(coalesce(gone, [])) AS m, w, map_from_entries(list_transform(coalesce(gone, []), lambda x: struct_pack(k := x, v := true))) AS gone FROM d LEFT JOIN g USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(m AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: m = 0 OR len(map_extract(gone, i)) = 0), ' ')) AS kept_sha256 FROM k
"""

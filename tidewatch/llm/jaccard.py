"""N-gram Jaccard join by signature trees.

Documents are sets of hashed word shingles; two link when their sets' Jaccard similarity reaches 3/4.

1. Equal sets become one class, found by a 128-bit sum of their hashes. Later steps see one member of each class.
2. A sparse count sketch (see repeats.py) gives every shingle the magnitude of the number of sets that hold it. In the
   order of (magnitude, hash), two sets that link share a shingle among the first n - ceil(3n/4) + 1 of each: the usual
   prefix filter. Shingles of one set only need no entry, so documents without near copies drop out here.
3. Sets that share such a shingle form candidate clusters: connected components of stars, one centre a shingle.
4. Each cluster is joined by signature trees: nodes hold the OR of their sets' bitmaps and the range of their sizes, and
   two nodes are opened only while the overlap that their bitmaps allow and their sizes could link a pair. The upper
   nodes of a cluster above UNIT_BYTES are the parts table: parts of at most about that size, of like sizes and like
   minimum hashes. Pairs of parts that could link are units, and only these meet the sets' bodies. Within a unit, trees
   are loaded in order of size class, then minimum hash, and traversed together; leaf pairs are verified exactly.
5. A unit gives, for each of its sets, the least set that its links reach and the number of documents it links with,
   so its output grows with its sets and not with its links; links() gives the links themselves. Components of these
   give each document the smallest doc_id that it reaches; n_links counts each document's links, those to its own
   class included.

Every step sends a block's distinct entries once, so no hot shingle or group of copies is gathered in one task.

Defined cases: a document of fewer words than a shingle is its whole sequence as one shingle; without words or text its
set is empty and it links with nothing; a null doc_id takes part and never is a component's id unless it is alone;
repeated rows are equal sets; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import common
from tidewatch.llm import windows as win
from tidewatch.llm.components import components

WIDTH, CELL = 5, np.uint64(24)
#: Bytes of sets that a part of a cluster holds, about; what a set takes besides its own; sets of a leaf.
UNIT_BYTES, SET_BYTES, LEAF = 8 << 20, 4096, 32
#: Values of a minimum hash by which parts are formed; bits of a part's bitmap; ratio of size classes, above 4/3.
CELLS, PART_BITS, RATIO = 4096, 16384, 1.34
#: Rows up to which the ids of documents to keep are broadcast.
SMALL_ROWS = 2_000_000
ROWS = win.ROWS


def sets_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all distinct shingles, by document, then hash."""
    w = win.Windows(texts, WIDTH, lower=True)
    short = np.flatnonzero((w.counts > 0) & (w.counts < WIDTH))
    whole = [np.uint64(len(x := w.words[w.starts[d] : w.starts[d + 1]])) + (common.mix(x) * np.multiply.accumulate(np.full(len(x), win.ODD))).sum(dtype=np.uint64) for d in short]
    doc = np.concatenate([w.doc, short])
    h = np.concatenate([w.hashes(), common.mix(np.array(whole, np.uint64))])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, bool)
    return doc[new], h[new]


def _sums(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
    at = np.searchsorted(doc, np.arange(n + 1))
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node, doc_id, a hash of the text, n and the two halves of the set's sum, of each document of blocks."""
    for pdf in frames:
        for uid, body in zip(pdf["uid"], pdf["body"], strict=True):
            ids, texts = win.opened(body)
            doc, h = sets_of(texts)
            n = len(ids)
            yield pd.DataFrame({"node": (uid << ROWS) + np.arange(n), "doc_id": pd.array(ids, "Int64"), "tag": np.array([xxhash.xxh64_intdigest(t or "", 42) for t in texts], np.uint64).view(np.int64), "n": np.bincount(doc, minlength=n), "f1": _sums(doc, common.mix(h), n), "f2": _sums(doc, common.mix(h ^ win.OFF), n)})


def _chosen(pdf: pd.DataFrame) -> pd.DataFrame:
    at = np.zeros(int(pdf["place"].max()) + 1, bool)
    at[pdf["place"]] = True
    return pd.DataFrame({"uid": pdf["uid"].iloc[:1], "chosen": [win.bits(at)]})


def _block_sets(body: bytes, chosen: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a block's class members only."""
    texts = win.opened(body)[1]
    take = win.flags_of([chosen])
    return sets_of([t if i < len(take) and take[i] else None for i, t in enumerate(texts)])


def _magnitudes(pdf: pd.DataFrame) -> list[bytes]:
    """For each cell that a block sent, the whole part of the binary logarithm of its merged count."""
    lists = [common.unpack_sorted(x) for x in pdf["cells"]]
    counts = np.concatenate([np.frombuffer(x, np.uint8) for x in pdf["counts"]])
    cells, at = np.unique(np.concatenate(lists), return_inverse=True)
    size = np.log2(np.bincount(at, counts)).astype(np.uint8)[at]
    ends = np.cumsum([0, *map(len, lists)])
    return [zlib.compress(size[a:b].tobytes(), 1) for a, b in zip(ends, ends[1:], strict=False)]


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique((h >> CELL) << CELL, return_inverse=True, return_counts=True)


def _stars(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links from each set that a shard's shingle sends to the least of them."""
    h = np.concatenate([common.unpack_sorted(x) for x in pdf["a"]])
    node = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["b"]])
    order = np.lexsort((node, h))
    h, node = h[order], node[order]
    first = np.concatenate([[True], h[1:] != h[:-1]])
    centre = node[first][np.cumsum(first) - 1]
    pairs = np.unique(np.column_stack([centre, node])[centre != node], axis=0)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), width // 64), np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    bit = np.concatenate(sets) % np.uint64(width)
    np.bitwise_or.at(out, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
    return out


def may_link(a: tuple[np.ndarray, int, int, int], b: tuple[np.ndarray, int, int, int]) -> bool:
    """Whether sets below two nodes could link; a node: OR of bitmaps, least and largest size, most shingles of a set beyond the first of their bit."""
    if 4 * a[2] < 3 * b[1] or 4 * b[2] < 3 * a[1]:
        return False
    most = min(int(np.bitwise_count(a[0] & b[0]).sum()) + min(a[3], b[3]), a[2], b[2])
    return 7 * most >= 3 * (a[1] + b[1])


class Tree:
    """Sets in their order, their bitmaps, and nodes over halves of the order."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sets, self.sizes = sets, np.array([len(s) for s in sets])
        width = 512
        while width < 8 * np.median(self.sizes) and width < 16384:
            width *= 2
        self.bitmaps = _bitmaps(sets, width)
        self.doubled = self.sizes - np.bitwise_count(self.bitmaps).sum(1)  # shingles beyond the first of their bit
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, int, int, int]] = {}
        self._node(0, len(sets))

    def _node(self, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= LEAF:
            bits = np.bitwise_or.reduce(self.bitmaps[lo:hi], axis=0)
        else:
            mid = (lo + hi) // 2
            bits = self._node(lo, mid) | self._node(mid, hi)
        self.nodes[lo, hi] = bits, int(self.sizes[lo:hi].min()), int(self.sizes[lo:hi].max()), int(self.doubled[lo:hi].max())
        return bits

    def may_link(self, p: tuple[int, int], q: tuple[int, int]) -> bool:
        return may_link(self.nodes[p], self.nodes[q])


def size_class(n: np.ndarray) -> np.ndarray:
    """Two sets that link are of one class or of neighbouring ones."""
    return np.floor(np.log(n) / np.log(RATIO)).astype(np.int64)


def join_sets(sets: list[np.ndarray], side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers i < j of all pairs of sets (ascending hashes) that link; with `side`, of those whose sides differ."""
    order = np.lexsort((np.array([s[0] for s in sets]), size_class(np.array([len(s) for s in sets]))))
    tree = Tree([sets[i] for i in order])
    side = np.arange(len(sets)) if side is None else side[order]
    ids = np.unique(np.concatenate(tree.sets), return_inverse=True)[1]
    starts, mark = np.concatenate([[0], np.cumsum(tree.sizes)]), np.zeros(ids.max() + 1, np.uint8)
    found, stack = [np.zeros((0, 2), np.int64)], [((0, len(sets)), (0, len(sets)))]
    while stack:
        p, q = stack.pop()
        if not tree.may_link(p, q):
            continue
        halves = [[x] if x[1] - x[0] <= LEAF else [(x[0], (x[0] + x[1]) // 2), ((x[0] + x[1]) // 2, x[1])] for x in (p, q)]
        if len(halves[0]) + len(halves[1]) > 2:
            stack += [(x, y) for x in halves[0] for y in halves[1] if x <= y]
            continue
        for i in range(*p):
            js = np.arange(max(q[0], i + 1), q[1])
            js = js[side[js] != side[i]]
            if not len(js):
                continue
            most = np.bitwise_count(tree.bitmaps[i] & tree.bitmaps[js]).sum(1) + np.minimum(tree.doubled[i], tree.doubled[js])
            need = 3 * (tree.sizes[i] + tree.sizes[js])
            may = 7 * np.minimum(most, np.minimum(tree.sizes[i], tree.sizes[js])) >= need
            js, need = js[may], need[may]
            if len(js) > 4:
                own, lo, hi = ids[starts[i] : starts[i + 1]], js[0], js[-1] + 1
                mark[own] = 1
                both = np.add.reduceat(mark[ids[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)[js - lo]
                mark[own] = 0
            else:
                both = np.array([_overlap(tree.sets[i], tree.sets[j]) for j in js], np.int64)
            js = js[7 * both >= need]
            found.append(np.column_stack([np.full(len(js), order[i]), order[js]]))
    pairs = np.concatenate(found)
    return pairs.min(1), pairs.max(1)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _stars_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least number that each of n nodes reaches by the links i, j."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _joined(pairs: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Rows of three kinds for the units of a bin: 0, a link (a < b), if pairs are wanted; 1, a node and the least one that
    the unit's links reach from it; 2, a node and the number of documents that the unit links it with."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"kind": pd.array([], "int32"), "a": pd.array([], "int64"), "b": pd.array([], "int64")})]
        for _, unit in pdf.groupby(["cluster", "p", "q"], sort=True):
            unit = unit.sort_values("node")
            node, part, copies = (unit[c].to_numpy() for c in ("node", "part", "copies"))
            i, j = join_sets([np.frombuffer(x, np.uint64) for x in unit["body"]], part if unit["p"].iloc[0] != unit["q"].iloc[0] else None)
            least = _stars_of(len(node), i, j)
            to = np.bincount(i, copies[j], len(node)) + np.bincount(j, copies[i], len(node))
            for kind, a, b in [(0, node[i], node[j])] * pairs + [(1, node, node[least]), (2, node, to.astype(np.int64))]:
                rows = slice(None) if kind == 0 else to > 0
                out.append(pd.DataFrame({"kind": np.full(len(a[rows]), kind, np.int32), "a": a[rows], "b": b[rows]}))
        common.give_back()
        return pd.concat(out)

    return run


def _part_node(pdf: pd.DataFrame) -> pd.DataFrame:
    """The node of one part."""
    sets = [np.frombuffer(x, np.uint64) for x in pdf["body"]]
    maps, sizes = _bitmaps(sets, PART_BITS), np.array([len(x) for x in sets])
    twice = sizes - np.bitwise_count(maps).sum(1)
    return pd.DataFrame({"cluster": pdf["cluster"].iloc[:1], "g": pdf["g"].iloc[:1], "part": pdf["part"].iloc[:1], "bits": [np.bitwise_or.reduce(maps, axis=0).tobytes()], "least": [int(sizes.min())], "most": [int(sizes.max())], "twice": [int(twice.max())]})


def _live(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of parts (cluster, p, q) that could link."""
    for pdf in frames:
        nodes = [[(np.frombuffer(r[0], np.uint64), *r[1:]) for r in zip(*(pdf[f"{c}_{x}"] for c in ("bits", "least", "most", "twice")), strict=True)] for x in "pq"]
        keep = np.array([p == q or may_link(a, b) for p, q, a, b in zip(pdf["p"], pdf["q"], *nodes, strict=True)], bool)
        yield pdf.loc[keep, ["cluster", "p", "q"]]


def _found(docs: DataFrame, pairs: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """keys of all documents, rows of _joined, classes."""
    blocks = win.blocks(docs, "jaccard-blocks")
    keys = common.written(blocks.select("uid", "body").mapInPandas(common.forgetting(_keys), "node long, doc_id long, tag long, n long, f1 long, f2 long"), "jaccard-keys")
    classes = common.written(keys.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("node").alias("rep"), F.min("doc_id").alias("class_id"), F.count("*").alias("copies")), "jaccard-classes")
    n = win.shards(classes.agg(F.sum("n")).first()[0] or 0, docs)
    mask = (1 << ROWS) - 1
    chosen = classes.select(F.shiftright("rep", ROWS).alias("uid"), F.col("rep").bitwiseAND(F.lit(mask)).alias("place"))
    chosen = common.written(chosen.groupBy("uid").applyInPandas(_chosen, "uid long, chosen binary"), "jaccard-chosen")
    some = blocks.join(chosen, "uid").select("uid", "body", "chosen")

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for uid, body, take in zip(pdf["uid"], pdf["body"], pdf["chosen"], strict=True):
                cells, _, counts = _cells(_block_sets(body, take)[1])
                rows = [(s, uid, common.pack_sorted(cells[k] >> CELL), np.minimum(counts[k], 255).astype(np.uint8).tobytes()) for s, k in win.split_by(cells, n)]
                yield pd.DataFrame(rows, columns=["shard", "uid", "cells", "counts"])

    sized = common.written(win.exchange(some.mapInPandas(common.forgetting(sketch), "shard long, uid long, cells binary, counts binary"), _magnitudes), "jaccard-magnitudes")

    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for uid, body, take, answers in zip(pdf["uid"], pdf["body"], pdf["chosen"], pdf["answers"], strict=True):
                yield _prefixes(uid, *_block_sets(body, take), win.answers_of(answers), n)

    found = some.join(sized, "uid").mapInPandas(common.forgetting(prefixes), "kind int, key long, a binary, b binary")
    found = common.written(found, "jaccard-prefixes")
    near = found.where("kind = 2").select(F.col("key").alias("a"), F.col("b")).mapInPandas(_unpacked, "a long, b long")
    stars = found.where("kind = 0").groupBy("key").applyInPandas(_stars, "a long, b long")
    clusters = components(near.union(stars))
    items = found.where("kind = 1").select(F.col("key").alias("node"), F.col("a").alias("body"), F.conv(F.hex("b"), 16, 10).cast("int").alias("cell"))
    return keys, _cluster_links(items, clusters, classes, pairs), classes


def classes_and_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (the smallest doc_id of an equal set), component_id, n_links (the documents that it
    links with); also component (a number, null for empty sets), node (the row's number) and tag (xxhash64 of the text,
    null as empty)."""
    keys, found, classes = _found(docs)
    labels = components(found.where("kind = 1").select("a", "b"))
    to = found.where("kind = 2").groupBy(F.col("a").alias("at")).agg(F.sum("b").alias("to"))
    own = classes.join(labels, classes.rep == labels.node, "left").join(to, F.col("rep") == F.col("at"), "left")
    own = own.select("n", "f1", "f2", "class_id", F.coalesce("label", "rep").alias("component"), (F.coalesce("to", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    own = common.written(own, "jaccard-components")
    least = own.groupBy("component").agg(F.min("class_id").alias("component_id"))
    own = own.join(least, "component")
    keyed = keys.join(own, ["n", "f1", "f2"], "left")
    return keyed.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "component", "node", "tag")


def _prefixes(uid: int, doc: np.ndarray, h: np.ndarray, answers: list[bytes], n: int) -> pd.DataFrame:
    """Rows of three kinds: 0, a shard's shingles with the block's least set of each; 1, a set; 2, a set and others to link."""
    size = np.concatenate([np.frombuffer(zlib.decompress(a), np.uint8) for a in answers] or [np.zeros(0, np.uint8)])
    magnitude = size[_cells(h)[1]] if len(h) else size
    order = np.lexsort((h, magnitude, doc))
    docs, starts, counts = np.unique(doc, return_index=True, return_counts=True)
    rank = np.arange(len(doc)) - np.repeat(starts, counts)
    most = np.repeat(counts - (3 * counts + 3) // 4 + 1, counts)
    take = order[(rank < most) & (magnitude[order] > 0)]
    t, d = h[take], doc[take]
    by = np.lexsort((d, t))
    t, d = t[by], d[by]
    first = np.concatenate([[True], t[1:] != t[:-1]]) if len(t) else np.zeros(0, bool)
    head = d[first][np.cumsum(first) - 1] if len(t) else d
    base = uid << ROWS
    rows: list[tuple] = [(0, s, common.pack_sorted(t[first][k]), (base + d[first][k]).astype(np.int64).tobytes()) for s, k in win.split_by(t[first], n)]
    rows += [(1, base + int(docs[i]), h[starts[i] : starts[i] + counts[i]].tobytes(), int(h[starts[i]] % np.uint64(CELLS)).to_bytes(2, "big")) for i in np.flatnonzero(np.isin(docs, d))]
    pairs = np.unique(np.column_stack([head, d])[head != d], axis=0)
    rows += [(2, base + int(a), b"", (base + pairs[pairs[:, 0] == a, 1]).astype(np.int64).tobytes()) for a in np.unique(pairs[:, 0])]
    return pd.DataFrame(rows, columns=["kind", "key", "a", "b"])


def _unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for a, b in zip(pdf["a"], pdf["b"], strict=True):
            x = np.frombuffer(b, np.int64)
            yield pd.DataFrame({"a": np.full(len(x), a), "b": x})


def _cluster_links(items: DataFrame, clusters: DataFrame, classes: DataFrame, pairs: bool) -> DataFrame:
    """Rows of _joined for all links."""
    members = clusters.select("node", F.col("label").alias("cluster")).join(classes.select(F.col("rep").alias("node"), "copies", "n"), "node")
    weight = (F.col("n") * 8 + SET_BYTES).alias("weight")
    members = members.join(items, "node").select("node", "cluster", "copies", "body", "cell", weight, F.floor(F.log(F.col("n").cast("double")) / float(np.log(RATIO))).alias("g"))
    members = common.written(members, "jaccard-members")
    total = members.groupBy("cluster").agg(F.sum("weight").alias("total"))
    bins = max(common.partitions(items.sparkSession), (total.agg(F.sum("total")).first()[0] or 0) // UNIT_BYTES + 1)
    held = "bin", "cluster", "p", "q", "part", "node", "copies", "body"
    none = [F.lit(0).cast("long").alias(x) for x in ("p", "q", "part")]
    small = members.join(total.where(F.col("total") <= UNIT_BYTES), "cluster").select(F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("bin"), "cluster", *none, "node", "copies", "body")
    done = common.written(small.select(*held).groupBy("bin").applyInPandas(_joined(pairs), "kind int, a long, b long"), "jaccard-links")
    large = members.join(total.where(F.col("total") > UNIT_BYTES).select("cluster"), "cluster")
    if large.isEmpty():
        return done
    # Cells of minimum hashes are laid together up to a part's size; a cell above it is dealt over several parts.
    cells = large.groupBy("cluster", "g", "cell").agg(F.sum("weight").alias("w"))
    before = F.coalesce(F.sum(F.when(F.col("w") <= UNIT_BYTES, F.col("w"))).over(Window.partitionBy("cluster", "g").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("slot", F.when(F.col("w") <= UNIT_BYTES, F.floor(before / UNIT_BYTES)).otherwise(-1 - F.col("cell"))).withColumn("deal", F.ceil(F.col("w") / UNIT_BYTES))
    part = F.xxhash64("g", "slot", F.when(F.col("slot") < 0, F.pmod(F.xxhash64("node"), F.col("deal"))))
    parted = common.written(large.join(cells, ["cluster", "g", "cell"]).select("cluster", "g", part.alias("part"), "node", "copies", "body"), "jaccard-parted")
    nodes = common.written(parted.groupBy("cluster", "g", "part").applyInPandas(_part_node, "cluster long, g long, part long, bits binary, least long, most long, twice long"), "jaccard-nodes")
    figures = ("part", "bits", "least", "most", "twice")
    one = nodes.select("cluster", F.col("g").alias("own"), F.explode(F.array(F.col("g"), F.col("g") + 1)).alias("g"), *(F.col(c).alias(f"{c}_p") for c in figures))
    other = nodes.select("cluster", "g", *(F.col(c).alias(f"{c}_q") for c in figures))
    # Parts of one class meet once, those of neighbouring classes in the order of these.
    met = one.join(other, ["cluster", "g"]).withColumnsRenamed({"part_p": "p", "part_q": "q"}).where((F.col("own") != F.col("g")) | (F.col("p") <= F.col("q")))
    live = common.written(met.mapInPandas(_live, "cluster long, p long, q long"), "jaccard-pairs")
    units = live.withColumn("part", F.explode(F.array_distinct(F.array("p", "q"))))
    placed = units.join(parted, ["cluster", "part"]).withColumn("bin", F.xxhash64("cluster", "p", "q")).select(*held)
    return done.union(common.written(placed.groupBy("bin").applyInPandas(_joined(pairs), "kind int, a long, b long"), "jaccard-links"))


def links(docs: DataFrame) -> DataFrame:
    """a, b, class_a, class_b: every link between different sets, by the numbers and the smallest doc_ids of their classes.

    With class_id of classes_and_components, it gives all links of documents: those of a class link with one another."""
    _, found, classes = _found(docs, pairs=True)
    own = [classes.select(F.col("rep").alias(x), F.col("class_id").alias(f"class_{x}")) for x in "ab"]
    return found.where("kind = 0").select("a", "b").join(own[0], "a").join(own[1], "b").select("a", "b", "class_a", "class_b")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, that have the smallest doc_id of their component (a null one only if
    there is no other), one each; all rows without words."""
    found = common.written(classes_and_components(docs).where("component IS NOT NULL"), "jaccard-found")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "node", "tag")).alias("x"))
    first = common.written(first.select(F.col("x.doc_id").alias("its_id"), F.col("x.tag").alias("its_tag")), "jaccard-first")
    first = F.broadcast(first) if first.count() <= SMALL_ROWS else first
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).withColumns({"tag": F.xxhash64(text), "id": F.col("row.doc_id").cast("long"), "some": text.rlike(r"[^\x20\x09-\x0D]")})
    kept = rows.where("some").join(first, F.col("id").eqNullSafe(F.col("its_id")) & (F.col("tag") == F.col("its_tag")), "left_semi")
    if not found.groupBy("doc_id", "tag").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "tag"])
    return kept.union(rows.where("NOT some")).select("row.*")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document, its class of equal sets and the number of its links."""
    return classes_and_components(common.documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, h FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS h FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT doc_id, md5(string_agg(h, chr(10) ORDER BY h)) AS k FROM s GROUP BY doc_id),
m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS class_id FROM k)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(class_id, w.doc_id) AS class_id, (SELECT count(*) FROM e WHERE e.a = w.doc_id) AS n_links
FROM w JOIN c ON c.a = w.doc_id LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

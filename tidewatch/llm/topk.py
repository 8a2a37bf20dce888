"""Exact top-k inner products by best-first search of M-trees.

Vectors go to shards around pivots (a bounded sample of the vectors); a pivot near which there are too many is dealt out
over several shards by a hash, so one common vector fills no shard. Each shard bulk-loads an M-tree: paged nodes with a
routing vector, a covering radius, and every entry's distance to its parent. By the Cauchy-Schwarz inequality no vector
below a node scores above <q, o> + |q| r; by the triangle inequality no entry scores above <q, p> + |q| (d + r) with
its parent p at the stored distance d, which spares most products. Pages are taken best bound first.

A query first searches the shard that it lies in; its k-th best score then rules out whole shards by their radii, and
the remaining shards search with that bound from the start. Queries go in blocks of neighbouring home shards, and a shard
is sent only to the blocks that need it. The last step keeps k rows a query.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an id, take no part; rows
that share an id are rows of their own, as candidates and as queries; a shorter vector counts as filled up with zeros;
equal scores go to the smaller id; other columns are ignored; an empty table gives an empty result. Scores are 64-bit
integers: components of which products leave that range (above some 2**28 for a thousand of them) have no defined score.

At scale: what the driver and each task hold are the pivots (PIVOTS at most) and a row for each shard, its centre and
radius; a table of 10**9 vectors has some 250,000 shards. Beyond that the directory should be a tree itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import common

K, EVERY, SCALE = 20, 20, 64.0
#: Vectors of a shard, pivots at most, entries of a page, queries of a block.
SHARD, PIVOTS, PAGE, BLOCK = 4096, 1024, 128, 8192


def scaled(rows: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, v: the vectors that take part, as integers; to be written before use, as numbers are made anew else."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    return out.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.transform(wide, lambda x: F.floor(x * SCALE).cast("long")).alias("v"))


def matrix(column: pd.Series, dims: int, wide: bool) -> np.ndarray:
    """Rows as float64 where all products of the table are exact in it, else (wide) as 64-bit integers."""
    out = np.zeros((len(column), dims), np.int64)
    for row, v in zip(out, column, strict=True):
        row[: len(v)] = v
    return out if wide else out.astype(np.float64)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.astype(np.float64) ** 2).sum(-1)) * (1 + 1e-9) + 1e-6


@dataclass
class Node:
    """A page: of its entries the vectors (routing ones above leaves), radii, distances to its own routing vector."""

    entries: np.ndarray
    radii: np.ndarray
    to_parent: np.ndarray
    children: list[int]
    ids: np.ndarray
    rows: np.ndarray


NONE = np.zeros(0, np.int64)


class MTree:
    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.vectors, self.nodes = vectors, []
        self.root_vector = vectors[0]
        self._page(rows, ids, vectors, self.root_vector)

    def _page(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, parent: np.ndarray) -> int:
        """The number of the page that holds these vectors, its pages below included."""
        distances, number = _norms(v - parent), len(self.nodes)
        if len(v) <= PAGE or float(distances.max()) < 1e-5:
            self.nodes.append(Node(v, np.zeros(len(v)), distances, [], ids, rows))
            return number
        self.nodes.append(Node(v[:0], NONE, NONE, [], NONE, NONE))
        near, picks = self._spread(v)
        entries, radii, children = [], [], []
        for k in range(len(picks)):
            own = near == k
            if own.any():
                entries.append(v[picks[k]])
                radii.append(float(_norms(v[own] - v[picks[k]]).max()))
                children.append(self._page(rows[own], ids[own], v[own], v[picks[k]]))
        e = np.array(entries)
        self.nodes[number] = Node(e, np.array(radii), _norms(e - parent), children, NONE, NONE)
        return number

    @staticmethod
    def _spread(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Routing vectors, each far from those before, and the nearest of them for every vector."""
        picks = [0]
        best = _norms(v - v[0])
        near = np.zeros(len(v), np.int64)
        while len(picks) < min(16, -(-len(v) // PAGE) + 1) and best.max() > 1e-5:
            picks.append(int(best.argmax()))
            d = _norms(v - v[picks[-1]])
            near[d < best] = len(picks) - 1
            best = np.minimum(best, d)
        return near, np.array(picks)

    def search(self, q: np.ndarray, own: np.ndarray, names: np.ndarray, k: int, floor: np.ndarray) -> pd.DataFrame:
        """q, query_id, vec_id, score: for each row of q the k best other vectors whose score is at least its `floor`.

        Best first: each query opens, of all pages that it has reached, inner ones and leaves, the one of the highest
        bound, until none is above its k-th best score. Queries that are at one page share its product. Bounds from the
        stored distances leave out entries, and with them products, that no query of a page can use.
        """
        length, bar = _norms(q), np.nextafter(floor.astype(np.float64), -np.inf)
        bound, above = np.full((len(q), len(self.nodes)), -np.inf), np.zeros((len(q), len(self.nodes)))
        bound[:, 0], above[:, 0] = np.inf, q @ self.root_vector
        best, every = _Best(len(q), k, self.vectors.dtype), np.arange(len(q))
        while True:
            page = bound.argmax(1)
            top = bound[every, page]
            active = np.flatnonzero((top >= bar) & (top > -np.inf))
            if not len(active):
                return best.rows(own, names)
            active = active[np.argsort(page[active], kind="stable")]
            found = []
            for rows in np.split(active, np.flatnonzero(np.diff(page[active])) + 1):
                at = int(page[rows[0]])
                node, at_parent = self.nodes[at], above[rows, at]
                bound[rows, at] = -np.inf
                if node.children:
                    self._open(node, rows, q, at_parent, length, bar, bound, above)
                else:
                    found.append(self._visit(node, rows, q, own, at_parent, length, bar))
            if found:
                best.add(*(np.concatenate(x) for x in zip(*found, strict=True)), bar)

    @staticmethod
    def _open(node: Node, rows: np.ndarray, q: np.ndarray, at_parent: np.ndarray, length: np.ndarray, bar: np.ndarray, bound: np.ndarray, above: np.ndarray) -> None:
        """Gives the rows their bounds of the pages below."""
        live = at_parent[:, None] + length[rows, None] * (node.to_parent + node.radii) >= bar[rows, None]
        need = np.flatnonzero(live.any(axis=0))
        products = (q[rows] @ node.entries[need].T).astype(np.float64)
        tight = products + length[rows, None] * node.radii[need]
        for j, i in enumerate(need.tolist()):
            go = np.flatnonzero(live[:, i] & (tight[:, j] >= bar[rows]))
            bound[rows[go], node.children[i]], above[rows[go], node.children[i]] = tight[go, j], products[go, j]

    @staticmethod
    def _visit(node: Node, rows: np.ndarray, q: np.ndarray, own: np.ndarray, at_parent: np.ndarray, length: np.ndarray, bar: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, id) of a page's vectors that reach the bars of the rows."""
        # The least that any of the rows asks for rules out entries by their distance to the routing vector.
        need = np.flatnonzero(node.to_parent >= float(np.min((bar[rows] - at_parent) / length[rows])))
        products = q[rows] @ node.entries[need].T
        r, e = np.nonzero((products >= bar[rows, None]) & (node.rows[need][None, :] != own[rows, None]))
        return rows[r], products[r, e], node.ids[need][e]


class _Best:
    """The k best (score, id) of each query, as flat columns."""

    def __init__(self, n: int, k: int, kind: np.dtype) -> None:
        self.n, self.k = n, k
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, kind), np.zeros(0, np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray, bar: np.ndarray) -> None:
        """Takes candidates in and raises the bars of queries that then have k."""
        if not len(row):
            return
        hit = np.zeros(self.n, bool)
        hit[row] = True
        stay = ~hit[self.row]
        r, s, i = (np.concatenate([a[~stay], b]) for a, b in ((self.row, row), (self.score, score), (self.id, ids)))
        by = np.lexsort((i, -s, r))
        r, s, i = r[by], s[by], i[by]
        first = np.concatenate([[True], r[1:] != r[:-1]])
        rank = np.arange(len(r)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        last = rank == self.k - 1
        bar[r[last]] = np.maximum(bar[r[last]], np.nextafter(s[last].astype(np.float64), -np.inf))
        keep = rank < self.k
        self.row, self.score, self.id = (np.concatenate([a[stay], b[keep]]) for a, b in ((self.row, r), (self.score, s), (self.id, i)))

    def rows(self, own: np.ndarray, names: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"q": own[self.row].astype(np.int64), "query_id": names[self.row].astype(np.int64), "vec_id": self.id, "score": self.score.astype(np.int64)})


def _none() -> pd.DataFrame:
    return pd.DataFrame({"q": pd.array([], "int64"), "query_id": pd.array([], "int64"), "vec_id": pd.array([], "int64"), "score": pd.array([], "int64")})


def top_k(rows: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, the rows whose id is divisible by `every`."""
    found = "q long, query_id long, vec_id long, score long"
    all_rows = common.written(scaled(rows), "topk-vectors")
    size = all_rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).first()
    n, dims, parts = size.n, size.dims or 0, common.partitions(rows.sparkSession)
    if not n:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    wide = float(size.top or 0) ** 2 * max(dims, 1) >= 2**52
    wanted = max(1, min(PIVOTS, max(-(-n // SHARD), min(parts, n // 512))))
    picked = all_rows.orderBy(F.xxhash64("vec_id"), "row").limit(wanted).toPandas()
    pivots = matrix(picked["v"], dims, wide).astype(np.float64)
    # In the order of their widest direction, so that shards of near numbers are near one another.
    pivots = pivots[np.argsort(pivots @ np.linalg.svd(pivots - pivots.mean(0), full_matrices=False)[2][0], kind="stable")] if dims else pivots

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            v = matrix(pdf["v"], dims, wide).astype(np.float64)
            pivot = ((pivots**2).sum(1) - 2 * (v @ pivots.T)).argmin(1)
            yield pdf.assign(pivot=pivot, distance=_norms(v - pivots[pivot]))

    placed = common.written(all_rows.mapInPandas(near, "row long, vec_id long, v array<bigint>, pivot long, distance double"), "topk-placed")
    counts = placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()  # PIVOTS rows at most
    many = {r.pivot: max(1, -(-r.n // (2 * SHARD))) for r in counts}
    base, at = {}, 0
    for p in sorted(many):
        base[p], at = at, at + many[p]
    lookup = F.create_map(*(x for p in sorted(many) for x in (F.lit(p), F.struct(F.lit(base[p]).cast("long").alias("base"), F.lit(many[p]).cast("long").alias("many")))))
    own = F.element_at(lookup, F.col("pivot"))
    asks = F.col("vec_id") % every == 0
    placed = placed.withColumn("shard", own.base + F.pmod(F.xxhash64("row"), own.many))
    # A directory of shards: the pivot, the radius around it, and the block of its queries.
    held = {r.shard: r for r in placed.groupBy("shard").agg(F.max("distance").alias("radius"), F.count_if(asks).alias("queries")).collect()}
    pivot_of = {base[p] + i: p for p in many for i in range(many[p])}
    names = np.array(sorted(held))
    centres, radii = pivots[[pivot_of[s] for s in names]], np.array([held[s].radius for s in names])
    block_of = dict(zip(names.tolist(), (np.cumsum([held[s].queries for s in names]) // BLOCK).tolist(), strict=True))

    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "row"], ignore_index=True)
        v, ids, number = matrix(pdf["v"], dims, wide), pdf["vec_id"].to_numpy(), pdf["row"].to_numpy()
        q = ids % every == 0
        if not q.any():
            return _none()
        return MTree(number, ids, v).search(v[q], number[q], ids[q], k, np.full(q.sum(), -np.inf))

    first = common.written(placed.groupBy("shard").applyInPandas(home, found), "topk-home")
    bars = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("bar"))
    queries = placed.where(asks).select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), "v", "shard").join(bars, "q", "left")

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            v, home_of = matrix(pdf["v"], dims, wide).astype(np.float64), pdf["shard"].to_numpy()
            bar = pdf["bar"].astype("float64").fillna(-np.inf).to_numpy()
            bound = v @ centres.T + _norms(v)[:, None] * (radii + 1e-6)
            q, s = np.nonzero((bound >= bar[:, None]) & (names[None, :] != home_of[:, None]))
            yield pd.DataFrame({"shard": names[s], "block": [block_of[x] for x in home_of[q].tolist()], "q": pdf["q"].to_numpy()[q], "query_id": pdf["query_id"].to_numpy()[q], "v": pdf["v"].to_numpy()[q], "bar": bar[q]})

    sent = common.written(queries.mapInPandas(routed, "shard long, block long, q long, query_id long, v array<bigint>, bar double"), "topk-sent")

    def away(key: tuple, vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(asked):
            return _none()
        tree = MTree(vectors["row"].to_numpy(), vectors["vec_id"].to_numpy(), matrix(vectors["v"], dims, wide))
        asked = asked.sort_values("q", ignore_index=True)
        return tree.search(matrix(asked["v"], dims, wide), asked["q"].to_numpy(), asked["query_id"].to_numpy(), k, asked["bar"].to_numpy())

    # A shard meets the blocks of queries of which one may need it, and no others.
    pairs = sent.select(F.col("shard").alias("to"), F.col("block").alias("asker")).distinct()
    spread = placed.join(pairs, F.col("shard") == F.col("to")).select("shard", F.col("asker").alias("block"), "row", "vec_id", "v")
    second = spread.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInPandas(away, found)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    both = first.union(common.written(second, "topk-away"))
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every twentieth."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.r <> c.r)
SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

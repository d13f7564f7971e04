"""Operator 10, approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

Fit.  The tree has a leaf for about `leaf` rows of the table, so leaves grow in number with it and not in size, up to `most_leaves`
(a tree of that size, some 10 MB, is what a task holds); beyond that they grow in size.  It is fitted on a sample of `per_leaf` vectors
a leaf (those with the smallest hash of id; per_leaf * most_leaves = 262,144 at most); a node is split `branch` ways until its share
of the sample is at most per_leaf vectors.  Every row is then sent down the tree to a leaf.

Search.  A query goes down the tree with a priority queue of open nodes, best first by the inner product with the node's
centre plus its spread along the query; leaves come out in that order.  How many leaves to visit is calibrated: for
some queries (`calibration`, by hash of id) the exact neighbours among all rows are found in blocks, and the number of
leaves is widened until they hold `recall` of them on average.  A query goes on beyond that number until its leaves
hold k rows besides those with its own id.

Work is dealt in cells: leaves that lie together in the tree, of about `cell` rows together.  A leaf that is larger (one
vector repeated very often) is split over several cells by hash of id.  A query goes only to the cells that hold a leaf which it
visits.  The queries of a cell are dealt in blocks of about `block`, and a cell's rows are copied once for each of its own blocks, which
is once as a rule; so no task holds more than one cell and one block, and what is shuffled grows with the table.  A cell gives each query its
best k; the best k of those are the answer.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take no part.  Ties go
to the smaller id; a row isn't its own neighbour (rows that share the query's id are left out).  With fewer candidates
than k, all are returned.  Empty tables give an empty result.  Only the two named columns are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

RESULT = "query_id long, rank int, vec_id long, score double"


class Tree:
    """Nodes in depth-first order: centre, spread (root mean square distance per direction), children (with their centres as one
    matrix) or leaf number."""

    def __init__(self, sample: np.ndarray, branch: int, leaf: int, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.branch, self.leaf_size = branch, leaf
        self.centres: list[np.ndarray] = []
        self.spread: list[float] = []
        self.children: list[list[int]] = []
        self.leaves: list[int] = []  # node of each leaf
        self.leaf_of: dict[int, int] = {}
        self._grow(sample)
        self.below = {i: np.array([self.centres[c] for c in kids]) for i, kids in enumerate(self.children) if kids}
        self.reach = {i: np.array([self.spread[c] for c in kids]) for i, kids in enumerate(self.children) if kids}
        self.centres, self.spread = [], []

    def _grow(self, x: np.ndarray) -> int:
        me = len(self.centres)
        centre = x.mean(axis=0)
        self.centres.append(centre)
        self.spread.append(float(np.sqrt(((x - centre) ** 2).mean())))
        self.children.append([])
        groups = self._split(x) if len(x) > self.leaf_size else [x]
        if len(groups) < 2:
            self.leaf_of[me] = len(self.leaves)
            self.leaves.append(me)
        else:
            self.children[me] = [self._grow(g) for g in groups]
        return me

    def _split(self, x: np.ndarray) -> list[np.ndarray]:
        k = min(self.branch, max(2, len(x) // self.leaf_size))
        centres = x[self.rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            near = _nearest(x, centres)
            centres = np.array([x[near == j].mean(axis=0) if (near == j).any() else x[self.rng.integers(len(x))] for j in range(k)])
        near = _nearest(x, centres)
        return [g for j in range(k) if len(g := x[near == j])]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each vector, by the nearest centre at every split."""
        out = np.zeros(len(x), dtype=np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf_of[node]
                continue
            near = _nearest(x[rows], self.below[node])
            todo += [(c, rows[near == j]) for j, c in enumerate(kids) if (near == j).any()]
        return out

    def best_bins(self, q: np.ndarray, visits: int, sizes: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """Leaf numbers, best first: `visits` of them, and more until they hold `least` rows by `sizes`."""
        sizes, held = sizes or {}, 0
        reach = 2.0 * float(np.linalg.norm(q))
        queue, out = [(0.0, 0)], []
        while queue and (len(out) < visits or held < least):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf_of[node])
                held += sizes.get(out[-1], 0)
                continue
            for rank, c in zip((-(self.below[node] @ q) - reach * self.reach[node]).tolist(), kids, strict=True):
                heapq.heappush(queue, (rank, c))
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad: Column = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.filter(F.size("v") == (usual[0]["d"] if usual else 0))


def _top(scores: np.ndarray, ids: np.ndarray, x: np.ndarray, q_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k largest scores, ties to the smaller id, without the query's own id.

    The given scores come from a matrix product, whose order of summation may differ between equal vectors; rows
    within rounding of the k-th are summed again in one order, so that equal vectors get equal scores."""
    ok = np.flatnonzero(ids != q_id)
    if len(ok) > k:
        cut = np.partition(scores[ok], len(ok) - k)[len(ok) - k]
        ok = ok[scores[ok] >= cut - 1e-12 * (1.0 + float(np.abs(scores[ok]).max()))]
    exact = (x[ok] * q).sum(axis=1)
    order = np.lexsort((ids[ok], -exact))[:k]
    return ids[ok][order], exact[order]


def _best_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, visited=None) -> pd.DataFrame:
    """Each query's best k of one cell; visited(i) gives the places that query i looks at, None all."""
    parts = []
    for i in range(0, len(q), 256):
        scores = q[i : i + 256] @ x.T
        for j, row in enumerate(scores, start=i):
            at = slice(None) if visited is None else visited(j)
            top, exact = _top(row[at], ids[at], x[at], q_ids[j], q[j], k)
            parts.append((np.full(len(top), q_ids[j]), top, exact))
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[], [], []]
    return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})


def _matrix(col) -> np.ndarray:
    return np.array([np.asarray(x, dtype=np.float64) for x in col])


def _rank(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_neighbours(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Brute force for a bounded query set (it is broadcast): blocks of rows against all queries."""
    got = queries.toPandas().sort_values("vec_id")
    q_ids, q = got["vec_id"].to_numpy(), _matrix(got["v"])

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 4096):
                part = pdf.iloc[i : i + 4096]
                yield _best_of(q_ids, q, part["vec_id"].to_numpy(), _matrix(part["v"]), k)

    return _rank(rows.mapInPandas(block, "query_id long, vec_id long, score double"), k)


def calibrate(tree: Tree, rows: DataFrame, leaf_rows: DataFrame, queries: DataFrame, k: int, recall: float, calibration: int) -> int:
    """Leaves to visit so that `recall` of the calibration queries' exact neighbours lie in them."""
    chosen = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(calibration)
    chosen = chosen.select("vec_id", "v")
    exact = exact_neighbours(chosen, rows, k)
    truth = exact.join(leaf_rows.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toPandas()
    vectors = {r["vec_id"]: np.array(r["v"]) for r in chosen.collect()}
    at = []
    for q, leaves in truth.groupby("query_id")["leaf"]:
        place = {leaf: i for i, leaf in enumerate(tree.best_bins(vectors[q], len(tree.leaves)))}
        at += [place[x] for x in leaves]
    if not at:
        return len(tree.leaves)
    return min(len(tree.leaves), int(np.sort(at)[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1)


def nearest(
    df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = 0.96,
    leaf: int = 128, most_leaves: int = 16384, per_leaf: int = 16, branch: int = 16, cell: int = 4096, block: int = 2048, calibration: int = 200,
) -> DataFrame:
    """The k rows of largest inner product for every query row: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    asked = is_query.alias("is_query")
    rows = written(valid_vectors(df, id_col, vector_col), "ann-vectors")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], RESULT)
    sample = per_leaf * min(most_leaves, max(1, -(-total // leaf)))
    share = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 30)) <= int(min(1.0, sample / total) * (1 << 30))
    fitted = rows.filter(share).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(sample).select("v").toPandas()
    if fitted.empty:
        fitted = rows.orderBy("vec_id").limit(sample).select("v").toPandas()
    tree = Tree(_matrix(fitted["v"]), branch, per_leaf)
    shared = spark.sparkContext.broadcast(tree)  # bounded by most_leaves

    def to_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(leaf=shared.value.assign(_matrix(pdf["v"])) if len(pdf) else [])

    placed = written(rows.mapInPandas(to_leaf, "vec_id long, v array<double>, leaf long"), "ann-leaves")
    queries = placed.filter(asked)
    if queries.isEmpty():
        return spark.createDataFrame([], RESULT)
    visits = calibrate(tree, rows, placed, queries, k, recall, calibration)
    dropped(rows)

    # cells: leaves in tree order, filled up to `cell` rows; a larger leaf gets cells of its own
    sizes = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # one row a leaf
    first, parts, at, filled = {}, {}, 0, 0
    for x in range(len(tree.leaves)):
        n = sizes.get(x, 0)
        if filled and filled + n > cell:
            at, filled = at + 1, 0
        first[x], parts[x] = at, max(1, -(-n // cell))
        filled += n
        if parts[x] > 1:
            at, filled = at + parts[x], 0
    table = spark.createDataFrame([(x, first[x], parts[x]) for x in first], "leaf long, first int, parts int")
    salt = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("parts")).cast("int")
    dealt = placed.join(F.broadcast(table), "leaf").select("vec_id", "v", "leaf", (F.col("first") + salt).alias("cell"))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q_id, v, own in zip(pdf["vec_id"], pdf["v"], pdf["own"], strict=True):
                by_cell: dict[int, list[int]] = {}
                for x in shared.value.best_bins(np.asarray(v, dtype=np.float64), visits, sizes, k + own):
                    for p in range(parts[x]):
                        by_cell.setdefault(first[x] + p, []).append(x)
                out += [(q_id, v, c, leaves) for c, leaves in by_cell.items()]
            yield pd.DataFrame(out, columns=["vec_id", "v", "cell", "leaves"])

    repeated = placed.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own")).filter("own > 1")
    counted = queries.join(repeated, "vec_id", "left").select("vec_id", "v", F.coalesce("own", F.lit(1).cast("long")).alias("own"))
    counted = counted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    planned = written(counted.mapInPandas(plan, "vec_id long, v array<double>, cell int, leaves array<long>"), "ann-visits")
    blocks = written(planned.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "ann-blocks")
    mine = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("blocks")).cast("int")
    visiting = planned.join(blocks, "cell").select("vec_id", "v", "cell", "leaves", mine.alias("block"))
    data = dealt.join(blocks, "cell").select("vec_id", "v", "leaf", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def search(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        if q.empty or d.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        d = d.sort_values("leaf")
        leaves, ids = d["leaf"].to_numpy(), d["vec_id"].to_numpy()
        asked_leaves = [np.asarray(x) for x in q["leaves"]]

        def visited(i: int) -> np.ndarray:
            lo, hi = np.searchsorted(leaves, asked_leaves[i], "left"), np.searchsorted(leaves, asked_leaves[i], "right")
            return np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])

        return _best_of(q["vec_id"].to_numpy(), _matrix(q["v"]), ids, _matrix(d["v"]), k, visited)

    found = visiting.groupBy("cell", "block").cogroup(data.groupBy("cell", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    return _rank(found, k)

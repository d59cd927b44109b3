"""Exact top-k inner products by best-first search in M-trees.

Vectors of one tree get one more component that brings them to equal length; then the order by inner
product is the order by Euclidean distance, a metric. A node is a page of routing vectors, each with the
covering radius of its subtree and its distance to the node's own routing vector. The search takes the
nearest open page first, for all queries that have it open, and leaves out by the triangle inequality, before computing any distance, what
the stored distances show to be too far.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage

#: Entries of a page, branches of a split and rows of a tree.
PAGE = 64
BRANCHES = 16
TREE_ROWS = 8192
#: Queries that pass through a tree together.
ASKED = 1024

#: The score of a missing result; all scores are higher.
NONE = -(1 << 62)

FOUND_DDL = "query_id long, vec_id long, score long"


class Page(NamedTuple):
    """Distances of the entries to the page's own routing vector; a leaf lists rows, others children."""

    to_parent: np.ndarray
    rows: np.ndarray | None
    centres: np.ndarray | None
    radius: np.ndarray | None
    children: list[int] | None


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


class MTree:
    """Bulk-loaded tree over integer vectors (rows of ``vectors``) with their ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, branches: int = BRANCHES):
        self.ids, self.vectors = ids, vectors.astype(np.float64)
        squares = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.top = float(squares.max(initial=0.0))
        self.points = np.column_stack([self.vectors, np.sqrt(self.top - squares)])
        self.page, self.branches = page, branches
        self.rng = np.random.default_rng(len(ids))
        self.pages: list[Page] = []
        self.root_centre = self.points.mean(0) if len(ids) else np.zeros(self.points.shape[1])
        self.root = self._load(np.arange(len(ids)), self.root_centre)
        # rounding of distances must never leave out a row
        self.slack = 1e-9 * (1 + np.sqrt(self.top))

    def _load(self, rows: np.ndarray, centre: np.ndarray) -> int:
        to_parent = _norms(self.points[rows] - centre)
        if len(rows) <= self.page:
            self.pages.append(Page(to_parent, rows, None, None, None))
            return len(self.pages) - 1
        picked = self.points[self.rng.choice(rows, min(self.branches, len(rows)), replace=False)]
        cross = self.points[rows] @ picked.T
        nearest = np.argmin(np.einsum("ij,ij->i", picked, picked) - 2 * cross, axis=1)
        groups = [np.flatnonzero(nearest == g) for g in range(len(picked))]
        if max(map(len, groups)) == len(rows):
            # all the same: any split will do
            groups = np.array_split(np.arange(len(rows)), len(picked))
        centres, radius, children = [], [], []
        for g, own in enumerate(groups):
            if len(own):
                centres.append(picked[g])
                radius.append(_norms(self.points[rows[own]] - picked[g]).max())
                children.append(self._load(rows[own], picked[g]))
        centres = np.array(centres)
        self.pages.append(Page(_norms(centres - centre), None, centres, np.array(radius), children))
        return len(self.pages) - 1

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, id) of the ``k`` best rows other than the query's own; ties to the smaller id."""
        score, ids = self.search_all(np.array([query_id]), query[None], k)
        return [(s, i) for s, i in zip(score[0].tolist(), ids[0].tolist(), strict=True) if s > NONE]

    def search_all(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(score, id) rows of the ``k`` best of each query, best first; ``NONE`` where there are fewer.

        All queries that have a page open meet it at once, so that a page is read once and its distances are one matrix
        product. The page nearest to any of them comes first; a query leaves a page when its bound has passed it by.
        """
        n = len(query_ids)
        queries = queries.astype(np.float64)
        points = np.column_stack([queries, np.zeros(n)])
        square = np.einsum("ij,ij->i", queries, queries)
        slack = self.slack + 1e-9 * np.sqrt(square)
        score, found = np.full((n, k), NONE), np.full((n, k), -1, np.int64)
        bound = np.full(n, np.inf)
        everyone = np.arange(n)
        open_ = [(0.0, self.root, everyone, _norms(points - self.root_centre), np.zeros(n))] if n else []
        while open_:
            _, number, own, from_parent, least = heapq.heappop(open_)
            still = least <= bound[own] + slack[own]
            if not still.any():
                continue
            own, from_parent = own[still], from_parent[still]
            page = self.pages[number]
            reach = bound[own] + slack[own]
            away = np.abs(from_parent[:, None] - page.to_parent)
            if page.rows is not None:
                some = (away <= reach[:, None]).any(0)
                rows = page.rows[some]
                got = (queries[own] @ self.vectors[rows].T).astype(np.int64)
                got[query_ids[own][:, None] == self.ids[rows]] = NONE
                better = np.flatnonzero((got >= score[own, -1][:, None]).any(1))
                if not len(better):
                    continue
                own = own[better]
                every = np.column_stack([score[own], got[better]])
                ids = np.column_stack([found[own], np.broadcast_to(self.ids[rows], (len(own), len(rows)))])
                order = np.lexsort((ids, -every), axis=1)[:, :k]
                score[own], found[own] = np.take_along_axis(every, order, 1), np.take_along_axis(ids, order, 1)
                full = own[score[own, -1] > NONE]
                bound[full] = np.sqrt(np.maximum(square[full] + self.top - 2.0 * score[full, -1], 0.0))
            else:
                near = away - page.radius <= reach[:, None]
                for at in np.flatnonzero(near.any(0)).tolist():
                    who = np.flatnonzero(near[:, at])
                    distance = _norms(points[own[who]] - page.centres[at])
                    low = np.maximum(distance - page.radius[at], 0.0)
                    kept = low <= reach[who]
                    if kept.any():
                        low = low[kept]
                        heapq.heappush(open_, (float(low.min()), page.children[at], own[who[kept]], distance[kept], low))
        return score, found


def integer_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector of floor(256 * x)); rows without id, with null or with non-finite components go.

    Of rows that share an id the one with the smallest vector counts.
    """
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        table.where(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & whole)
        .select(
            F.col("vec_id").cast("long"),
            F.transform(vector, lambda x: F.floor(F.lit(256) * x.cast("double")).cast("long")).alias("vector"),
        )
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )


def top_k(table: DataFrame, every: int = 50, k: int = 5, tree_rows: int = TREE_ROWS, page: int = PAGE) -> DataFrame:
    """For each vector whose id is divisible by ``every`` its ``k`` best inner products among all others.

    Every tree of about ``tree_rows`` rows answers all queries, so the work is the query set against all rows in
    blocks; a task holds one tree at a time and queries pass through it in batches. Shorter vectors count as
    padded with zeros. An empty table, or one without queries, gives no rows. Scores must stay below 2^53.
    """
    vectors = stage(integer_vectors(table)).df
    trees = max(1, -(-vectors.count() // tree_rows))
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tree = F.pmod(F.xxhash64("vec_id"), F.lit(trees)).cast("int")
    stored = vectors.select(tree.alias("tree"), F.lit(0).alias("query"), "vec_id", "vector")
    asked = vectors.where(F.col("vec_id") % every == 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).alias("query"), "vec_id", "vector"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: MTree | None = None
        number, ids, rows = None, [], []

        def matrix(lists: list[np.ndarray], width: int) -> np.ndarray:
            out = np.zeros((len(lists), width), np.int64)
            for i, v in enumerate(lists):
                out[i, : len(v)] = v
            return out

        for batch in batches:
            found = []
            flat = batch.column(3).values.to_numpy()
            at = batch.column(3).offsets.to_numpy()
            numbers, asking, keys = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.flatnonzero((numbers[1:] != numbers[:-1]) | (asking[1:] != asking[:-1])) + 1
            for part in np.split(np.arange(len(keys)), cuts):
                if not len(part):
                    continue
                if numbers[part[0]] != number:
                    number, ids, rows, built = numbers[part[0]], [], [], None
                values = [flat[at[i] : at[i + 1]] for i in part.tolist()]
                if not asking[part[0]]:
                    ids += keys[part].tolist()
                    rows += [v.copy() for v in values]
                    continue
                if built is None:
                    built = MTree(np.array(ids, np.int64), matrix(rows, max(map(len, rows), default=0)), page)
                    rows = []
                # components beyond all stored vectors meet zeros only
                width = built.vectors.shape[1]
                for lo in range(0, len(part), ASKED):
                    some = part[lo : lo + ASKED]
                    score, other = built.search_all(keys[some], matrix([v[:width] for v in values[lo : lo + ASKED]], width), k)
                    who, place = np.nonzero(score > NONE)
                    found.append((keys[some][who], other[who, place], score[who, place]))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"]
                )

    # trees have a partition each up to a number of partitions; a hash would put several into one and leave others empty
    found = (
        stored.unionByName(asked)
        .repartitionById(min(trees, 4 * parts), F.pmod("tree", F.lit(min(trees, 4 * parts))))
        .sortWithinPartitions("tree", "query", "vec_id")
        .mapInArrow(run, FOUND_DDL)
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

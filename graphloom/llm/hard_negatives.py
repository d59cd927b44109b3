"""Hard negatives of anchors by exact integer scores, computed by the method of the Four Russians.

The components of an anchor are taken in groups of eight dimensions; a table holds the sums of all 256 subsets of a
group. The components of a candidate are two's-complement numbers; the bits of one place, packed eight
dimensions to a byte, select one subset sum of each group, and the sums of all places are shifted and added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import release, stage

#: Candidates and anchors that meet in one cell, and anchors whose tables are held at once.
SLICE = 2048
ANCHORS = 8192
AT_ONCE = 64


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): sums of all subsets of each eight components of the rows of ``anchors``."""
    n, width = anchors.shape
    groups = -(-width // 8)
    parts = np.zeros((groups * 8, n), np.int64)
    parts[:width] = anchors.T
    parts = parts.reshape(groups, 8, n)
    tables = np.zeros((groups, 256, n), np.int64)
    for d in range(8):
        tables[:, 1 << d : 2 << d] = tables[:, : 1 << d] + parts[:, d : d + 1]
    # a sum over all groups is at most the sum of the absolute components
    fits = n == 0 or np.abs(anchors).sum(1).max(initial=0) < 2**31
    return tables.astype(np.int32) if fits else tables


def bit_planes(candidates: np.ndarray) -> np.ndarray:
    """(places, candidates, groups) bytes: the bits of each place of two's-complement components, eight to a byte."""
    n, width = candidates.shape
    low, high = int(candidates.min(initial=0)), int(candidates.max(initial=0))
    places = max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
    return np.stack([np.packbits(((candidates >> p) & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(places)])


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(candidates, anchors) exact inner products; the highest place has the negative weight."""
    places, n, groups = planes.shape
    total = np.zeros((n, tables.shape[2]), np.int64)
    for p in range(places):
        plane = np.zeros((n, tables.shape[2]), tables.dtype)
        for g in range(groups):
            plane += tables[g].take(planes[p, :, g], axis=0)
        shifted = plane.astype(np.int64) << p
        total = total - shifted if p == places - 1 else total + shifted
    return total


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, the highest first, ties in the given order."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.argsort(-score[some], kind="stable")[:k]]


def labelled_vectors(table: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, vector of floor(256 * x)) of the rows that take part; of rows sharing an id the smallest counts."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    vector = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")).cast("long"))
    return (
        table.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(label.cast("long").alias("label"), vector.alias("vector")).alias("_row"))
        .groupBy("vec_id")
        .agg(F.min("_row").alias("_row"))
        .select("vec_id", "_row.label", "_row.vector")
    )


def _matrix(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    """The lists of ``rows`` as a matrix; entries beyond ``width`` meet zeros only, missing ones are zero."""
    at = column.offsets.to_numpy()
    flat = column.values.to_numpy()
    size = np.minimum(np.diff(at)[rows], width)
    out = np.zeros((len(rows), width), np.int64)
    here = np.arange(width) < size[:, None]
    out[here] = flat[(at[:-1][rows][:, None] + np.arange(width))[here]]
    return out


Pick = Callable[[np.ndarray, np.ndarray, int, list, list], Iterator[tuple]]


def scored(vectors: DataFrame, anchors: DataFrame, pick: Pick, ddl: str, slice_rows: int, anchor_rows: int) -> DataFrame:
    """Rows that ``pick`` makes of the scores of every anchor with the candidates of a slice, all slices.

    A cell is a slice of candidates and a block of anchors; it is built once and its anchors pass through it in batches.
    ``pick`` gets the candidates' ids (ascending) and scores, and of the anchor its id, and ids and scores of its positives.
    """
    spark = vectors.sparkSession
    n, a = vectors.count(), anchors.count()
    slices, blocks = max(1, -(-n // slice_rows)), max(1, -(-a // anchor_rows))
    cells = slices * blocks
    parts = min(cells, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    none = F.lit(None).cast("array<long>")

    def numbers(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    own = F.pmod(F.xxhash64("vec_id"), F.lit(slices))
    stored = vectors.select("*", own.alias("_slice"), numbers(blocks).alias("_block")).select(
        (F.col("_slice") * blocks + F.col("_block")).alias("cell"), F.lit(0).alias("asks"), "vec_id", "label", "vector", none.alias("ids"), none.alias("scores")
    )
    own = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks))
    asked = anchors.select("*", own.alias("_block"), numbers(slices).alias("_slice")).select(
        (F.col("_slice") * blocks + F.col("_block")).alias("cell"), F.lit(1).alias("asks"), "vec_id", "label", "vector", "ids", "scores"
    )
    names = [part.split()[0] for part in ddl.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = planes = None
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def build():
            nonlocal planes, held, ids, labels, width
            width = max((int(np.diff(v.offsets.to_numpy()).max(initial=0)) for _, _, v in held), default=0)
            ids = np.concatenate([h[0] for h in held]) if held else np.zeros(0, np.int64)
            labels = np.concatenate([h[1] for h in held]) if held else np.zeros(0, np.int64)
            whole = [_matrix(v, np.arange(len(v)), width) for _, _, v in held]
            planes = bit_planes(np.concatenate(whole) if whole else np.zeros((0, width), np.int64))
            held = []

        ids = labels = width = None
        for batch in batches:
            cell, asks, key, label = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (asks[1:] != asks[:-1])) + 1
            rows = []
            for part in np.split(np.arange(len(cell)), cuts):
                if not len(part):
                    continue
                if cell[part[0]] != number:
                    number, planes, held = cell[part[0]], None, []
                if not asks[part[0]]:
                    held.append((key[part], label[part], batch.column(4).slice(part[0], len(part))))
                    continue
                if planes is None:
                    build()
                # anchors of one label leave out the same candidates
                part = part[np.argsort(label[part], kind="stable")]
                for lo in range(0, len(part), AT_ONCE):
                    some = part[lo : lo + AT_ONCE]
                    for same in np.unique(label[some]):
                        of = some[label[some] == same]
                        right = pick.candidates(labels, same)
                        got = scores(planes[:, right], subset_sums(_matrix(batch.column(4), of, width)))
                        for c, at in enumerate(of.tolist()):
                            rows += pick(ids[right], got[:, c], int(key[at]), batch.column(5)[at].as_py(), batch.column(6)[at].as_py())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    dealt = stored.unionByName(asked).repartitionById(parts, F.pmod("cell", F.lit(parts)).cast("int"))
    return dealt.sortWithinPartitions("cell", "asks", "vec_id").mapInArrow(run, ddl)


class Positives:
    """The best rows of the anchor's label."""

    def __init__(self, k: int):
        self.k = k

    def candidates(self, labels: np.ndarray, label: int) -> np.ndarray:
        return np.flatnonzero(labels == label)

    def __call__(self, ids, score, anchor, positive_ids, positive_scores):
        other = ids != anchor
        ids, score = ids[other], score[other]
        for i in best(score, self.k).tolist():
            yield anchor, int(ids[i]), int(score[i])


class Negatives:
    """For each positive the best rows of other labels within a share of its score."""

    def __init__(self, k: int, percent: int):
        self.k, self.percent = k, percent

    def candidates(self, labels: np.ndarray, label: int) -> np.ndarray:
        return np.flatnonzero(labels != label)

    def __call__(self, ids, score, anchor, positive_ids, positive_scores):
        found: dict[int, list[tuple[int, int]]] = {}
        for positive, top in zip(positive_ids, positive_scores):
            if top not in found:
                some = np.flatnonzero((score <= top) & (100 * score >= self.percent * top))
                found[top] = [(int(ids[some[i]]), int(score[some[i]])) for i in best(score[some], self.k).tolist()]
            for negative, value in found[top]:
                yield anchor, positive, top, negative, value


def hard_negatives(
    table: DataFrame, label: Column, every: int = 100, k: int = 5, percent: int = 80, slice_rows: int = SLICE, anchor_rows: int = ANCHORS
) -> DataFrame:
    """For each anchor (ids divisible by ``every``) and each of its ``k`` best rows of the same ``label``, the first ``k``
    rows of other labels that score at least ``percent`` of the positive and no more than it.

    Higher scores come first, ties to the smaller id. Rows whose id, label, vector or a component is null, or that have a
    component that is not finite, take no part. Of rows that share an id the one with the smallest (label, vector) counts.
    Shorter vectors count as padded with zeros, an empty one scores 0. An anchor without positives, or a positive
    without negatives, gives no rows, nor does an empty table. Components must stay below 2^31, scores below 2^56.
    """
    spark = table.sparkSession
    vectors = stage(labelled_vectors(table, label))
    none = F.lit(None).cast("array<long>")
    anchors = vectors.df.where(F.col("vec_id") % every == 0)
    first = scored(
        vectors.df, anchors.select("*", none.alias("ids"), none.alias("scores")), Positives(k), "anchor_id long, positive_id long, score long", slice_rows, anchor_rows
    )
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    positives = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    listed = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("p"))
    listed = stage(listed.select(F.col("anchor_id").alias("vec_id"), F.col("p.positive_id").alias("ids"), F.col("p.score").alias("scores")))
    known = stage(anchors.join(listed.df, "vec_id"))
    second = scored(
        vectors.df,
        known.df,
        Negatives(k, percent),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
        slice_rows,
        anchor_rows,
    )
    release(spark, listed)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = second.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

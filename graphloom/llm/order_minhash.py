"""Near-duplicate classes by order MinHash, verified by banded alignment.

A document is the sequence of its shingles of five words; each shingle carries the number of its
earlier occurrences, so that the labelled shingles of a document are distinct. A sketch takes the few labelled
shingles with the smallest hashes under its own seed, keeps them in text order and hashes the
sequence: two documents agree in it with a chance that falls with their edit distance. Documents
that share a sketch are candidates; a banded alignment of their shingle sequences decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..staging import release, stage
from .ngram_join import BLOCK, heads, meeting, products
from .text import mix, shingles, slices, words

SHINGLE = 5
SKETCHES = 16
PICKED = 3
SIMILARITY = 0.8

_OCCURRENCE = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = [np.uint64(x) for x in np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64).tolist()]
_ORDER = [np.uint64(x | 1) for x in np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64).tolist()]


def labelled(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that tell repeated shingles of a row apart by the number of their occurrence."""
    order = np.lexsort((value, row))
    new = np.ones(len(order), bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (row[order][1:] != row[order][:-1])
    run = np.flatnonzero(new)
    nth = np.arange(len(order)) - np.repeat(run, np.diff(np.append(run, len(order))))
    out = np.empty(len(value), np.uint64)
    out[order] = mix(value[order] + nth.astype(np.uint64) * _OCCURRENCE)
    return out


def sketch(value: np.ndarray, row: np.ndarray, rows: int, sketches: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """(rows, sketches) of 64-bit order MinHashes of labelled shingles in text order."""
    n = np.bincount(row, minlength=rows)
    out = np.zeros((rows, sketches), np.uint64)
    # a cut that leaves about 24 shingles of a long text; where it leaves too few, all are taken
    share = np.minimum(1.0, (8 * picked) / np.maximum(n, 1))
    cut = np.where(share >= 1, 2.0**64 - 2048, share * 2.0**64).astype(np.uint64)[row]
    whole = n <= 8 * picked
    for s in range(sketches):
        h = mix(value ^ _SEEDS[s])
        at = np.flatnonzero((h <= cut) | whole[row])
        short = np.bincount(row[at], minlength=rows) < np.minimum(n, picked)
        if short.any():
            at = np.flatnonzero((h <= cut) | whole[row] | short[row])
        at = at[np.lexsort((h[at], row[at]))]
        own = row[at]
        start = np.searchsorted(own, np.arange(rows))
        at = at[np.arange(len(at)) - start[own] < picked]
        at.sort()
        own = row[at]
        nth = np.arange(len(at)) - np.searchsorted(own, np.arange(rows))[own]
        total = np.zeros(rows, np.uint64)
        for j in range(picked):
            here = nth == j
            total[own[here]] += value[at[here]] * _ORDER[j]
        out[:, s] = mix(total ^ _SEEDS[255 - s])
    return out


def sketch_table(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, sketch) of (doc_id, text); no sketch for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                value, row, _ = shingles(words(batch.column(1).slice(lo, hi - lo)), SHINGLE)
                rows = hi - lo
                keys = sketch(labelled(value, row), row, rows).view(np.int64)
                some = np.bincount(row, minlength=rows) > 0
                size = np.where(some, keys.shape[1], 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, rows),
                        batch.column(2).slice(lo, rows),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(keys[some].ravel())
                        ),
                    ],
                    names=["doc_id", "digest", "sketch"],
                )

    # a document without text is like no other one
    digest = F.coalesce(F.md5("text"), F.concat(F.lit("no text "), F.col("doc_id").cast("string")))
    return docs.select("doc_id", "text", digest).mapInArrow(run, "doc_id long, digest string, sketch array<long>")


def banded_matches(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """Longest common subsequence that uses only pairs of places at most ``band`` apart.

    Equal ends are cut off first; the rest is aligned row by row with one bit per place of ``y``.
    """
    m = min(len(x), len(y))
    same = x[:m] == y[:m]
    head = m if same.all() else int(np.argmin(same))
    x, y = x[head:], y[head:]
    m -= head
    same = x[::-1][:m] == y[::-1][:m]
    tail = m if same.all() else int(np.argmin(same))
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if not len(x) or not len(y):
        return head + tail
    places: dict[int, int] = {}
    for j, v in enumerate(y.tolist()):
        places[v] = places.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    window = (1 << (2 * band + 1)) - 1
    state = full
    for i, v in enumerate(x.tolist()):
        hit = places.get(v)
        if hit:
            hit &= window << (i - band) if i >= band else window >> (band - i)
            u = state & hit
            if u:
                state = ((state + u) | (state - u)) & full
    return head + tail + len(y) - state.bit_count()


def compare(
    x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY, plain: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[int, bool]:
    """Distance of the two sets of labelled shingles, and whether the aligned similarity is reached.

    Matches over the union of both sequences must reach ``similarity``; an alignment can't match more
    than the sets have in common, which settles most pairs, nor leave the band of the indels allowed.
    ``plain`` has the shingles without labels, which are what is aligned: one occurrence more or less early in a
    text shifts the labels of all later ones.
    """
    total = len(x) + len(y)
    common = len(np.intersect1d(x, y, assume_unique=True))
    if not total or common < similarity * (total - common):
        return total - 2 * common, False
    band = int(total * (1 - similarity) / (1 + similarity)) + 1
    matches = banded_matches(*(plain or (x, y)), band)
    return total - 2 * common, matches >= similarity * (total - matches)


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of each pair of nodes (a, b): shingles of both, set distance and whether it is a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(2)):
                sides, plain = [], []
                for k in (2, 3):
                    value, row, _ = shingles(words(batch.column(k).slice(lo, hi - lo)), SHINGLE)
                    cuts = np.searchsorted(row, np.arange(1, hi - lo))
                    sides.append(np.split(labelled(value, row), cuts))
                    plain.append(np.split(value, cuts))
                found = [compare(x, y, plain=(p, q)) for x, y, p, q in zip(*sides, *plain, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        *(pa.array([len(x) for x in side], pa.int64()) for side in sides),
                        pa.array([d for d, _ in found], pa.int64()),
                        pa.array([ok for _, ok in found], pa.bool_()),
                    ],
                    names=["a", "b", "n_a", "n_b", "distance", "linked"],
                )

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long, n_a long, n_b long, distance long, linked boolean")


def labelled_entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Labelled shingles and rows of a text column, sorted by both."""
    value, row, _ = shingles(words(column), SHINGLE)
    value = labelled(value, row)
    order = np.lexsort((value, row))
    return value[order], row[order]


def _classes(links: DataFrame) -> DataFrame:
    edges = links.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = connected_components(edges, key=None)
    return found.select("node", F.col("component").alias("class_id"))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row's doc_id with ``class_id``, the smallest id of its class, and ``n_links``.

    Exact copies fall together by digest and only one of them is sketched further. In each bucket of equal
    sketches all members are aligned with one centre, the member that shares the most sketches with others. Where a
    bucket still holds several classes, its members look for partners of other classes through an index of
    their rare shingles: two texts at the similarity have one of them in common early in both, and where they
    first do, what is left of both bounds what they have in common. Members of one class are never compared, so a
    large group of copies makes no pairs. Candidates that the bounds leave are aligned too.
    ``n_links`` counts the verified links of the row's text to other texts.

    Texts of fewer than five words are one shingle. Texts without words are near no other text, but empty
    ones are copies of each other; a null text is a class of its own. Rows that share an id are classed each
    by its own text; a null id has a null class. ``digest`` tells which text a row had. An empty table gives no rows; other columns are not carried.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    known = docs.where(F.col("doc_id").isNotNull())
    sketched = stage(sketch_table(known)).df
    of_text = sketched.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch"))
    reps = stage(of_text.withColumn("node", F.monotonically_increasing_id())).df
    keyed = reps.select("node", F.explode("sketch").alias("key")).distinct()
    shared = stage(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    bucketed = stage(keyed.join(shared.df, "key"))
    weight = stage(bucketed.df.groupBy("node").agg(F.sum("n").alias("weight")))
    heaviest = F.max_by("node", F.struct(F.col("weight"), -F.col("node"))).alias("centre")
    centres = stage(bucketed.df.join(weight.df, "node").groupBy("key").agg(heaviest))
    members = stage(bucketed.df.select("key", "node").join(centres.df, "key"))
    release(spark, shared, bucketed, weight, centres)
    needed = members.df.select("node").distinct().join(reps.select("node", "doc_id", "digest"), "node")
    # of rows that share an id the text with the digest is meant
    of_node = known.withColumn("digest", F.md5("text")).join(needed, ["doc_id", "digest"])
    texts = stage(of_node.groupBy("node").agg(F.min("text").alias("text")))
    stars = members.df.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    first = stage(verify(stars, texts.df))
    links = first.df
    merged = stage(_classes(first.df))
    classed = members.df.join(merged.df, "node", "left").select("key", "node", F.coalesce("class_id", "node").alias("label"))
    classed = stage(classed)
    split = classed.df.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    left_open = stage(classed.df.join(split.select("key"), "key", "left_semi").select("node", "label").distinct())
    if not left_open.df.isEmpty():
        open_texts = texts.df.join(left_open.df.select("node"), "node", "left_semi").withColumnRenamed("node", "doc_id")
        rows = stage(heads(open_texts, labelled_entries).select(F.col("doc_id").alias("node"), "n", "grams", "bits"))
        posted = rows.df.select("node", "n", F.posexplode("grams").alias("pos", "gram"))
        posted = meeting(posted.select("gram", "node", "n", (F.col("n") - F.col("pos")).alias("rest")))
        labelled = posted.df.join(left_open.df, "node").select("gram", "node", "n", "rest", "label")
        across = products(labelled, rows.df, block)
        tried = first.df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        second = stage(verify(stage(across.join(tried, ["a", "b"], "left_anti")).df, texts.df))
        links = first.df.unionByName(second.df)
        release(spark, rows, posted)
    classes = stage(_classes(links)).df
    both = links.where("linked").select("a", "b").distinct()
    degree = stage(
        both.select(F.col("a").alias("node")).unionAll(both.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    ).df
    release(spark, members, texts, merged, classed, left_open)
    named = reps.select("digest", "doc_id", "node").join(classes, "node", "left").withColumn("label", F.coalesce("class_id", "node"))
    smallest = stage(named.groupBy("label").agg(F.min("doc_id").alias("class_id"))).df
    of_text = stage(
        named.drop("class_id")
        .join(smallest, "label")
        .join(degree, "node", "left")
        .select("digest", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    ).df
    out = sketched.join(of_text, "digest").select("doc_id", "class_id", "n_links", "digest")
    none = docs.where(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long"), F.lit(0).cast("long"), F.md5("text"))
    return out.unionAll(none)


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of the smallest id of each class, repeated rows once; rows without an id stay.

    The rows travel as one column, so that no column of the table clashes with what is added here.
    """
    found = stage(near_duplicates(docs)).df
    gone = stage(found.where("doc_id <> class_id").select("doc_id", "digest").distinct()).df
    repeated = stage(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND doc_id IS NOT NULL")).df
    digest = F.md5(F.col("text").cast("string")).alias("digest")
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    left = held.join(gone, ["doc_id", "digest"], "left_anti")
    if not repeated.isEmpty():
        ids = repeated.select("doc_id")
        once = left.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "digest"])
        left = left.join(ids, "doc_id", "left_anti").unionByName(once)
    return left.select("row.*")

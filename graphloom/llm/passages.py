"""Repeated passages by collinear chaining of shared k-mer seeds.

Winnowing picks seeds so that any run of 20 equal words in two documents has one in common. A seed is
matched with its first occurrence only, in the document of the smallest id, so a passage that many documents
share gives each of them one match and never a pair of each two. The matches of two documents are
chained in order of both texts under a gap cost, with a Fenwick tree for the best predecessor; the chains
are aligned word by word, and what is long and alike enough is a passage.

An earlier document that holds a fragment of a passage takes the seeds of it. So what is not covered then is looked
up once more by whole runs of 50 words, again by their first occurrence: that one holds the run from end to end, and
every run that is repeated word for word is covered. Only runs whose seeds all have an earlier holder are looked up.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import release, stage
from .order_minhash import banded_matches, labelled
from .text import shingles, slices, words

SHINGLE = 5
WINDOW = 16
MIN_WORDS = 50
SIMILARITY = 0.8
#: A match is worth ``GAIN``; a gap costs ``GAP`` for each word on either side.
GAIN = 4.0
GAP = 0.05
#: Words beyond the outer seeds in which a passage may go on.
FLANK = 64

RUNS_DDL = "run long, doc_id long, pos int, seed long"
SEEDS_DDL = "seed long, doc_id long, pos int, first boolean"
CHAINS_DDL = "doc_id long, source long, xs array<int>, ys array<int>"
PASSAGES_DDL = (
    "doc_id long, start_word long, end_word long, source_doc_id long, "
    "source_start_word long, source_end_word long, n_matched long"
)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each ``width`` neighbours from a place on; ``width`` a power of two."""
    step = 1
    while step < width:
        x = pick(x[:-step], x[step:])
        step *= 2
    return x


def winnow(value: np.ndarray, row: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places whose hash is the smallest of some ``window`` neighbours of the same row."""
    if len(value) < window:
        return np.zeros(0, np.int64)
    value = value | np.uint64(1)
    low = _slide(value, window, np.minimum)
    low = np.where(row[: len(low)] == row[window - 1 :], low, np.uint64(0))
    edge = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([edge, low, edge]), window, np.maximum) == value)


def seed_table(docs: DataFrame) -> DataFrame:
    """Seeds of (doc_id, text) with the word they begin at, and whether it can be a source's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                w = words(batch.column(1).slice(lo, hi - lo))
                value, row, pos = shingles(w, SHINGLE)
                long = (np.diff(w.first) >= MIN_WORDS)[row]
                value, row, pos = value[long], row[long], pos[long]
                at = winnow(value, row)
                value, row, pos = value[at], row[at], pos[at]
                # a seed that the text repeats is also looked up under the number of its occurrence: in
                # periodic texts only these ascend in both
                numbered = labelled(value, row)
                order = np.lexsort((value, row))
                first = np.ones(len(at), bool)
                first[order[1:]] = (value[order][1:] != value[order][:-1]) | (row[order][1:] != row[order][:-1])
                again = ~first
                value = np.concatenate([value, numbered[again]])
                row, pos = np.concatenate([row, row[again]]), np.concatenate([pos, pos[again]])
                first = np.concatenate([first, np.ones(again.sum(), bool)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(value.view(np.int64)),
                        batch.column(0).slice(lo, hi - lo).take(pa.array(row)),
                        pa.array(pos, pa.int32()),
                        pa.array(first),
                    ],
                    names=["seed", "doc_id", "pos", "first"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SEEDS_DDL)


def chains(x: list[int], y: list[int]) -> list[list[int]]:
    """Chains of matches (x, y), sorted by x: disjoint lists of places at which both ascend.

    The best predecessor of a match is the largest ``score + GAP * (x + y)`` of those before it in both
    texts: a prefix maximum over the ranks of y, held in a Fenwick tree. Matches of one x are looked up
    before any of them is entered.
    """
    ranks = sorted(set(y))
    n = len(ranks)
    tree, holder = [float("-inf")] * (n + 1), [-1] * (n + 1)
    rank = [bisect_left(ranks, v) + 1 for v in y]
    score, back = [0.0] * len(x), [-1] * len(x)
    i = 0
    while i < len(x):
        j = i
        while j < len(x) and x[j] == x[i]:
            best, who, r = float("-inf"), -1, rank[j] - 1
            while r > 0:
                if tree[r] > best:
                    best, who = tree[r], holder[r]
                r -= r & -r
            best -= GAP * (x[j] + y[j])
            score[j] = GAIN + max(best, 0.0)
            back[j] = who if best > 0 else -1
            j += 1
        for m in range(i, j):
            key, r = score[m] + GAP * (x[m] + y[m]), rank[m]
            while r <= n:
                if key > tree[r]:
                    tree[r], holder[r] = key, m
                r += r & -r
        i = j
    used = [False] * len(x)
    out = []
    for end in sorted(range(len(x)), key=lambda m: -score[m]):
        chain = []
        while end >= 0 and not used[end]:
            used[end] = True
            chain.append(end)
            end = back[end]
        if chain:
            out.append(chain[::-1])
    return out


def chain_table(matches: DataFrame) -> DataFrame:
    """Chains of (doc_id, pos, source, source_pos) that a passage can be made of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None

        def found(groups) -> pa.RecordBatch:
            doc, source, xs, ys = [], [], [], []
            for d, s, x, y in groups:
                for chain in chains(x, y):
                    if len(chain) > 1 and x[chain[-1]] - x[chain[0]] + SHINGLE + 2 * WINDOW >= MIN_WORDS:
                        doc.append(d)
                        source.append(s)
                        xs.append([x[m] for m in chain])
                        ys.append([y[m] for m in chain])
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(doc, pa.int64()),
                    pa.array(source, pa.int64()),
                    pa.array(xs, pa.list_(pa.int32())),
                    pa.array(ys, pa.list_(pa.int32())),
                ],
                names=["doc_id", "source", "xs", "ys"],
            )

        def split(cols) -> list:
            if not len(cols[0]):
                return []
            cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            lo, hi = np.append(0, cut), np.append(cut, len(cols[0]))
            # a single match makes no chain
            return [
                (int(cols[0][a]), int(cols[1][a]), cols[2][a:b].tolist(), cols[3][a:b].tolist())
                for a, b in zip(lo.tolist(), hi.tolist(), strict=True)
                if b - a > 1
            ]

        for batch in batches:
            cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if rest is not None:
                cols = tuple(np.concatenate(pair) for pair in zip(rest, cols, strict=True))
            if not len(cols[0]):
                continue
            # the last group may go on in the next batch
            last = int(np.argmax((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])))
            rest = tuple(c[last:] for c in cols)
            yield found(split(tuple(c[:last] for c in cols)))
        if rest is not None:
            yield found(split(rest))

    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        matches.select("doc_id", "source", "pos", "source_pos")
        .repartition(parts, "doc_id", "source")
        .sortWithinPartitions("doc_id", "source", "pos", "source_pos")
        .mapInArrow(run, CHAINS_DDL)
    )


def run_table(docs: DataFrame, places: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """Runs of ``MIN_WORDS`` words of (doc_id, text) that can be repeated, with the first seed in their middle.

    The seeds in the middle of a run do not depend on the words around it: a run has the same ones wherever it
    stands. ``places`` (doc_id, at) has places of seeds. With ``covered`` (doc_id, spans) a run counts if all its
    middle seeds are among them and a word of it is in no span; without, if the first one is.
    """
    middle, after = WINDOW - 1, MIN_WORDS - SHINGLE - WINDOW + 2
    narrow = covered is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                w = words(batch.column(1).slice(lo, hi - lo))
                value, row, pos = shingles(w, SHINGLE)
                at = winnow(value, row)
                seed, where = value[at], w.first[row[at]] + pos[at]
                known = np.zeros(len(w.hash) + 1, bool)
                bare = np.ones(len(w.hash) + 1, bool)
                for k in range(lo, hi):
                    begin, end = int(w.first[k - lo]), int(w.first[k - lo + 1])
                    own = batch.column(2)[k].values.to_numpy(zero_copy_only=False)
                    known[begin + own[own < end - begin]] = True
                    if narrow:
                        for span in batch.column(3)[k].as_py() or []:
                            bare[begin + span["start_word"] : min(begin + span["end_word"], end)] = False
                value, row, pos = shingles(w, MIN_WORDS)
                whole = np.diff(w.first)[row] >= MIN_WORDS
                value, row, pos = value[whole], row[whole], pos[whole]
                place = w.first[row] + pos
                lead = np.searchsorted(where, place + middle)
                if not narrow:
                    some = known[where[lead]]
                else:
                    unknown = np.concatenate([[0], np.cumsum(~known[where])])
                    left = np.concatenate([[0], np.cumsum(bare)])
                    some = unknown[np.searchsorted(where, place + after)] == unknown[lead]
                    some &= left[place + MIN_WORDS] > left[place]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(value[some].view(np.int64)),
                        batch.column(0).slice(lo, hi - lo).take(pa.array(row[some])),
                        pa.array(pos[some], pa.int32()),
                        pa.array(seed[lead[some]].view(np.int64)),
                    ],
                    names=["run", "doc_id", "pos", "seed"],
                )

    both = docs.select("doc_id", "text").join(places, "doc_id")
    if narrow:
        both = both.join(covered, "doc_id", "left")
    return both.mapInArrow(run, RUNS_DDL)


def _cover(pos: np.ndarray, source_pos: np.ndarray) -> list[tuple[int, int, int]]:
    """Few (start, last start, start in the source) of repeated runs that cover the same words; ``pos`` ascends."""
    new = np.ones(len(pos), bool)
    new[1:] = (np.diff(pos) != 1) | (np.diff(source_pos) != 1)
    a = np.flatnonzero(new)
    pieces = list(zip(pos[a].tolist(), pos[np.append(a[1:], len(pos)) - 1].tolist(), source_pos[a].tolist(), strict=True))
    out: list[tuple[int, int, int]] = []
    for k, piece in enumerate(pieces):
        # the next one begins where this ends or before: what the last one taken leaves open tells whether this is needed
        reach = out[-1][1] + MIN_WORDS if out else -1
        if k + 1 == len(pieces) or pieces[k + 1][0] > reach or piece[1] > piece[0]:
            if piece[1] + MIN_WORDS > reach:
                out.append(piece)
    return out


def repeated_runs(left: DataFrame, runs: DataFrame) -> DataFrame:
    """Chains, as of :func:`chain_table`, from each run of ``left`` to its first occurrence among ``runs``, if a smaller id has it."""
    firsts = (
        runs.join(left.select("run").distinct(), "run", "left_semi")
        .groupBy("run")
        .agg(F.min("doc_id").alias("source"), F.min_by("pos", F.struct("doc_id", "pos")).alias("source_pos"))
    )
    matches = left.join(firsts, "run").where("doc_id <> source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def found(cols: list[np.ndarray]) -> pa.RecordBatch:
            rows = []
            cut = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(cols[0])], strict=True):
                if a < b:
                    for first, last, there in _cover(cols[2][a:b], cols[3][a:b]):
                        end = last - first + MIN_WORDS - SHINGLE
                        rows.append((int(cols[0][a]), int(cols[1][a]), [first, first + end], [there, there + end]))
            types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "source", "xs", "ys"]
            )

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(pair) for pair in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            # the last group may go on in the next batch
            last = int(np.argmax((cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])))
            rest = [c[last:] for c in cols]
            yield found([c[:last] for c in cols])
        if rest is not None:
            yield found(rest)

    parts = int(matches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        matches.select("doc_id", "source", "pos", "source_pos")
        .distinct()
        .repartition(parts, "doc_id", "source")
        .sortWithinPartitions("doc_id", "source", "pos", "source_pos")
        .mapInArrow(run, CHAINS_DDL)
    )


def _extend(x: np.ndarray, y: np.ndarray) -> int:
    """Words by which two texts go on alike: the best prefix, a difference weighing twice a match."""
    n = min(len(x), len(y))
    if not n:
        return 0
    total = np.cumsum(np.where(x[:n] == y[:n], 1, -2))
    best = int(np.argmax(total))
    return best + 1 if total[best] > 0 else 0


def align(x: np.ndarray, y: np.ndarray, xs: list[int], ys: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Passages (start, end in x, start, end in y, words matched) around a chain of seeds.

    Where the texts between the outer seeds are not alike enough, the chain is cut at its widest gap.
    """
    out = []
    todo = [(0, len(xs))]
    while todo:
        a, b = todo.pop()
        x0, x1, y0, y1 = xs[a], xs[b - 1] + SHINGLE, ys[a], ys[b - 1] + SHINGLE
        longest = max(x1 - x0, y1 - y0)
        band = abs((x1 - x0) - (y1 - y0)) + int(longest * (1 - SIMILARITY)) + 1
        matched = banded_matches(x[x0:x1], y[y0:y1], band)
        if matched >= SIMILARITY * longest:
            left, right = _extend(x[:x0][::-1], y[:y0][::-1]), _extend(x[x1:], y[y1:])
            matched += int((x[x0 - left : x0] == y[y0 - left : y0]).sum() + (x[x1 : x1 + right] == y[y1 : y1 + right]).sum())
            if x1 - x0 + left + right >= MIN_WORDS:
                out.append((x0 - left, x1 + right, y0 - left, y1 + right, matched))
        elif b - a > 2:
            gaps = [xs[m + 1] - xs[m] + ys[m + 1] - ys[m] for m in range(a, b - 1)]
            cut = a + 1 + int(np.argmax(gaps))
            todo += [(a, cut), (cut, b)]
    return out


def _span(text: str, places: str) -> tuple[Column, Column]:
    """The words from ``FLANK`` before the first place to ``FLANK`` after the last, and where they begin."""
    spaced = F.col(text)
    for c in "\t\n\x0b\f\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    begin = F.greatest(F.element_at(places, 1) - FLANK, F.lit(0))
    length = F.element_at(places, -1) + SHINGLE + FLANK - begin
    return F.array_join(F.slice(F.array_remove(F.split(spaced, " "), ""), begin + 1, length), " "), begin


def passages(docs: DataFrame) -> DataFrame:
    """Passages of 50 words or more that a document repeats from one of a smaller id, with the places in both.

    Places count words (``start_word`` from 0, ``end_word`` excluded). Edits inside a passage are allowed to
    a fifth of its words. The document that holds a seed first is its source and reports no passage for it.
    Every 50 words that an earlier document has word for word are covered, whoever else holds parts of them.
    A document can have several rows, which may overlap.

    Null and empty texts, texts of fewer than 50 words and rows with a null id have no passages. Rows that
    share an id count as one document, whose text is the smallest of theirs. An empty table gives no rows;
    other columns are not carried.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL")
    spark = docs.sparkSession
    sown = stage(seed_table(docs))
    seeds = sown.df
    own = F.when(F.col("first"), F.col("doc_id"))
    shared = stage(
        seeds.groupBy("seed")
        .agg(F.min(own).alias("source"), F.min_by("pos", own).alias("source_pos"), F.max("doc_id").alias("last"))
        .where("source < last")
        .drop("last")
    )
    matches = seeds.join(shared.df, "seed").where("doc_id <> source")
    linked = stage(chain_table(matches))
    texts = stage(_needed(docs, linked.df))
    found = stage(_aligned(texts.df, linked.df)).df
    release(spark, linked, texts)
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))
    left = stage(run_table(docs, _places(matches), spans))
    release(spark, shared)
    again = seeds.join(left.df.select("seed").distinct(), "seed", "left_semi")
    runs = stage(run_table(docs, _places(again)))
    release(spark, sown)
    whole = stage(repeated_runs(left.df, runs.df)).df
    release(spark, left, runs)
    return found.unionByName(_aligned(stage(_needed(docs, whole)).df, whole))


def _places(seeds: DataFrame) -> DataFrame:
    return seeds.groupBy("doc_id").agg(F.collect_set("pos").alias("at"))


def _needed(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """The texts (doc_id, text) of both ends of the chains ``linked``."""
    needed = linked.select(F.explode(F.array("doc_id", "source")).alias("doc_id")).distinct()
    return docs.join(needed, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))


def _aligned(texts: DataFrame, linked: DataFrame) -> DataFrame:
    """Passages of the chains ``linked`` between ``texts``."""
    x, x_begin = _span("text", "xs")
    y, y_begin = _span("text", "ys")
    both = (
        linked.join(texts, "doc_id")
        .withColumns({"x": x, "x_begin": x_begin})
        .drop("text")
        .join(texts.withColumnRenamed("doc_id", "source"), "source")
        .withColumns({"y": y, "y_begin": y_begin})
        .select("doc_id", "source", "xs", "ys", "x_begin", "y_begin", "x", "y")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lo, hi in slices(batch.column(6)):
                part = batch.slice(lo, hi - lo)
                sides = []
                for k in (6, 7):
                    w = words(part.column(k))
                    sides.append(np.split(w.hash, w.first[1:-1]))
                plain = [part.column(k).to_pylist() for k in range(6)]
                for doc, source, xs, ys, xb, yb, wx, wy in zip(*plain, *sides, strict=True):
                    for a, b, c, d, n in align(wx, wy, [v - xb for v in xs], [v - yb for v in ys]):
                        rows.append((doc, a + xb, b + xb, source, c + yb, d + yb, n))
            names = [c.split()[0] for c in PASSAGES_DDL.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=names
            )

    return both.mapInArrow(run, PASSAGES_DDL)


def without_passages(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """The documents without the words of their passages; what is left keeps its white space.

    A document of whose words none is left goes; all others keep their columns.
    """
    # a name that no column of the table has
    own = "_spans"
    while own in docs.columns:
        own += "_"
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("start_word", "end_word")).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, keep = [], []
            at = batch.schema.get_field_index(text)
            for value, spans_here in zip(batch.column(at), batch.column(len(docs_schema)).to_pylist(), strict=True):
                if spans_here is None:
                    cut.append(value.as_py())
                    keep.append(True)
                    continue
                raw = value.as_py()
                w = words(pa.array([raw]), hashes=False)
                gone = np.zeros(len(w.start), bool)
                for s in spans_here:
                    gone[s["start_word"] : s["end_word"]] = True
                data = w.data.tobytes()
                # a removed word takes the white space behind it along
                ends = np.append(w.start[1:], len(data))
                edges = np.flatnonzero(np.diff(np.concatenate([[False], ~gone, [False]]).astype(np.int8)))
                kept = [data[w.start[a] : ends[b - 1]] for a, b in edges.reshape(-1, 2).tolist()]
                cut.append(b"".join(kept).decode().rstrip() if gone.any() else raw)
                keep.append(not gone.all() or not len(gone))
            columns = [pa.array(cut, pa.string()) if k == at else c for k, c in enumerate(batch.columns)][:-1]
            yield pa.RecordBatch.from_arrays(columns, names=docs_schema.names).filter(pa.array(keep, pa.bool_()))

    docs_schema = docs.schema
    return docs.join(stage(spans).df, "doc_id", "left").select(*docs.columns, own).mapInArrow(run, docs_schema)

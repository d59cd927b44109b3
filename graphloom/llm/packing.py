"""Best-fit packing by minimum bin slack.

Each bin is filled by a subset-sum over the lengths that are left: a bitset holds the sums that can be
reached, and the fullest feasible combination is taken out. The choice depends on lengths only, so
it is planned on the histogram of lengths, which has no more entries than a bin has tokens however many
documents there are, and a combination is repeated for as many bins as its lengths last. Pieces
then find their bin by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .text import slices
from .tokens import word_tokenizer

CAPACITY = 2048
RANK_BITS = 44

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids and a closing 0, cut after each ``capacity`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokenizer(tokenizer)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                ids, at = encoder.encode(batch.column(1).slice(lo, hi - lo))
                docs_here = np.arange(hi - lo)
                n = np.diff(at) + 1
                begin = at[:-1] + docs_here
                closed = np.zeros(len(ids) + hi - lo, "<u4")
                keep = np.ones(len(closed), bool)
                keep[begin + n - 1] = False
                closed[keep] = ids
                count = -(-n // capacity)
                doc = np.repeat(docs_here, count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                first = (begin[doc] + start) * 4
                view = memoryview(closed.tobytes())
                crc = [zlib.crc32(view[a:b]) for a, b in zip(first.tolist(), (first + length * 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(doc)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    schema=PIECES,
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES_DDL)


def fullest(room: int, left: dict[int, int]) -> dict[int, int]:
    """The combination of the lengths left (with their counts) that fills ``room`` best.

    Long lengths are offered first, since they are the hardest to place later.
    """
    mask = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted((x for x in left if x <= room and left[x]), reverse=True):
        n, m = min(left[length], room // length), 1
        while n:
            m = min(m, n)
            steps.append((length, m, sums))
            sums |= (sums << (length * m)) & mask
            n -= m
            m *= 2
        if sums >> room:
            break
    best, used = sums.bit_length() - 1, {}
    for length, m, before in reversed(steps):
        if not before >> best & 1:
            used[length] = used.get(length, 0) + m
            best -= length * m
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a bin, number of such bins), for the whole histogram."""
    left = {x: n for x, n in histogram.items() if n}
    out = []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fullest(capacity - longest, left)
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[x] // n for x, n in used.items())
        out.append((used, times))
        for x, n in used.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return out


def intervals(bins: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """The plan as ranges of ranks: of each range its first key, pieces a bin, first bin and offset."""
    taken: dict[int, int] = {}
    rows, first_bin = [], 0
    for used, times in bins:
        offset = 0
        for length in sorted(used, reverse=True):
            lo = taken.get(length, 0)
            rows.append(((length << RANK_BITS) + lo, used[length], first_bin, offset))
            taken[length] = lo + used[length] * times
            offset += length * used[length]
        first_bin += times
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Each piece of the documents (doc_id, text) with the sequence and the place it is packed to.

    Null and empty texts are one closing token; repeated rows are packed each for itself; a null
    doc_id is carried; an empty table gives no rows. Other columns of the input are not carried.
    The driver holds the histogram of lengths (``capacity`` entries) and the plan, whose size is
    bounded by lengths as well. No window sees more than one written chunk's pieces of one length.
    """
    cut = stage(pieces(docs, tokenizer, capacity).withColumn("_chunk", F.spark_partition_id())).df
    chunks = cut.groupBy("_chunk", "length").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["length"]: r["n"] for r in chunks.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    key, per_bin, first_bin, offset = intervals(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select("_chunk", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_chunk", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        cut.withColumn("_rank", F.row_number().over(within) - 1)
        .join(offsets, ["_chunk", "length"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, (length << RANK_BITS) + rank, "right") - 1
            nth = (length << RANK_BITS) + rank - key[at]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:5],
                    pa.array(first_bin[at] + nth // per_bin[at]),
                    pa.array(offset[at] + nth % per_bin[at] * length),
                ],
                names=[*PIECES.names, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, PIECES_DDL + ", sequence_id long, offset long")

"""Alignment of the tokens that two tokenizers make of the same bytes.

Both token sequences are arrays of the byte offsets where their tokens end. Most of the time the two run in
step: token i of one ends where token i + shift of the other does. Such a stretch is jumped by comparing
slices of both arrays whose length doubles while they are equal and is halved to the first difference. Where they
differ, both sides advance until they meet again, which gives one irregular group and a new shift.

Texts are cut into units where neither tokenizer merges anything, before a space that follows a
character other than white space, and each worker keeps the ids of the units it has met.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import release, stage
from .text import Words, hash_ranges, slices, string_buffers
from .tokens import PART_CACHE, CachedIds, _byte_letters

#: Pairs of ids whose counts the tasks hold; all other pairs are joined.
HELD_PAIRS = 1 << 18

# Fixed value: the split pattern of the byte-level file.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# Plain Latin units are split here; all others go through the whole tokenizer.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]+")

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14), *range(28, 32)]] = True
_WIDE_BLANK_END = np.zeros(256, bool)
_WIDE_BLANK_END[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def units(column: pa.Array) -> Words:
    """Units of " " + text for each row; an empty text has none.

    No cut is made after white space of any kind, since a run of it is split as a whole.
    """
    column = column.cast(pa.large_string())
    space, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    column = pc.if_else(pc.equal(pc.binary_length(column), 0), none, pc.binary_join_element_wise(space, column, none))
    offsets, data = string_buffers(column.fill_null(""))
    data = data[int(offsets[0]) : int(offsets[-1])] if len(offsets) else data
    offsets = offsets - offsets[0]
    before = [np.concatenate([np.full(k, 32, np.uint8), data[:-k]])[: len(data)] for k in (1, 2, 3)]
    blank = _BLANK[before[0]]
    blank |= (before[1] == 0xC2) & ((before[0] == 0x85) | (before[0] == 0xA0))
    blank |= (before[2] >= 0xE1) & (before[2] <= 0xE3) & _WIDE_BLANK_END[before[0]]
    cut = (data == 32) & ~blank
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data))[: len(start)]
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    return Words(start, end, row, first, hash_ranges(data, start, end), data)


class ByteLevelIds(CachedIds):
    """Ids of units by a byte-level BPE file; special tokens in a text are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        letter_byte = {x: b for b, x in enumerate(self.letters)}
        self.n_ids = self.tokenizer.get_vocab_size()
        self.entries = [b""] * self.n_ids
        for entry, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.entries[i] = bytes(letter_byte[x] for x in entry)

    def cut(self, column: Words) -> Words:
        return column

    def unit_ids(self, unit: str) -> bytes:
        if not _PLAIN.fullmatch(unit):
            return array("i", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
        out = b""
        for part in _PARTS.findall(unit):
            ids = self.parts.get(part)
            if ids is None:
                if len(self.parts) >= PART_CACHE:
                    self.parts.clear()
                shown = "".join(self.letters[b] for b in part.encode())
                ids = self.parts[part] = array("i", [t.id for t in self.model.tokenize(shown)]).tobytes()
            out += ids
        return out

    def compute(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.unit_ids(u.decode()) for u in new]
        return np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), np.int32)


class PieceIds(CachedIds):
    """Ids of units by a piece model that puts a space before its text."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.n_ids = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.n_ids)]
        self.entries = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.space = [self.model.piece_to_id("▁")]

    def cut(self, column: Words) -> Words:
        return column

    def compute(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode([u[1:].decode() for u in new], num_threads=1)
        ids = [x if len(u) > 1 else self.space for x, u in zip(ids, new, strict=True)]
        flat = np.fromiter((i for x in ids for i in x), np.int32)
        return np.fromiter(map(len, ids), np.int64, len(ids)), flat


class Vocabulary(NamedTuple):
    """Byte length of each id, its bytes one after the other, and where they begin."""

    length: np.ndarray
    data: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, entries: list[bytes]) -> Vocabulary:
        length = np.fromiter(map(len, entries), np.int64, len(entries))
        return cls(length, np.frombuffer(b"".join(entries), np.uint8), np.cumsum(length) - length)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        end = np.cumsum(size)
        return self.data[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self.at[ids] - end + size, size)]


class Pair(NamedTuple):
    a: ByteLevelIds
    b: PieceIds
    words_a: Vocabulary
    words_b: Vocabulary


@lru_cache(maxsize=1)
def tokenizers(path_a: str, path_b: str) -> Pair:
    a, b = ByteLevelIds(path_a), PieceIds(path_b)
    return Pair(a, b, Vocabulary.of(a.entries), Vocabulary.of(b.entries))


def group_sizes(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens of both sides in each group between two offsets where both have an end.

    Both arrays ascend strictly and have the same last entry.
    """
    n, m = len(ends_a), len(ends_b)
    x, y = ends_a.astype("<i8").tobytes(), ends_b.astype("<i8").tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    one, other, times = [], [], []
    i = j = 0
    while i < n:
        run, step, growing = 0, 1, True
        while step:
            step = min(step, n - i - run, m - j - run)
            p, q = 8 * (i + run), 8 * (j + run)
            if x[p : p + 8 * step] == y[q : q + 8 * step]:
                run += step
                step = step * 2 if growing else step // 2
            else:
                growing = False
                step //= 2
        if run:
            one.append(1)
            other.append(1)
            times.append(run)
            i += run
            j += run
            if i == n:
                break
        p, q = i, j
        end_a, end_b = list_a[i], list_b[j]
        while end_a != end_b:
            if end_a < end_b:
                i += 1
                end_a = list_a[i]
            else:
                j += 1
                end_b = list_b[j]
        i += 1
        j += 1
        one.append(i - p)
        other.append(j - q)
        times.append(1)
    times = np.array(times, np.int64)
    return np.repeat(np.array(one, np.int64), times), np.repeat(np.array(other, np.int64), times)


def links(ends_a: np.ndarray, ends_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs of tokens whose bytes overlap, given the sizes of the groups."""
    single = (in_a == 1) & (in_b == 1)
    start_a, start_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    odd_a, odd_b = np.flatnonzero(np.repeat(~single, in_a)), np.flatnonzero(np.repeat(~single, in_b))
    # inside an irregular group every end of either side closes one overlap
    close = np.union1d(ends_a[odd_a], ends_b[odd_b])
    x = odd_a[np.searchsorted(ends_a[odd_a], close)]
    y = odd_b[np.searchsorted(ends_b[odd_b], close)]
    return np.concatenate([start_a[single], x]), np.concatenate([start_b[single], y])


def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to n - 1 as rows of bytes with room for a separator, and their number."""
    text = [str(i).encode() for i in range(n)]
    width = len(text[-1]) + 1
    return np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(n, width), np.array([len(t) for t in text])


class Written(NamedTuple):
    data: bytes
    end: np.ndarray


def written(ids_a: np.ndarray, ids_b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, digits: np.ndarray, width: np.ndarray) -> Written:
    """All groups as a1,a2|b1;a3|b2,b3; and where each group's part ends."""
    groups = len(in_a)
    both = in_a + in_b
    start = np.cumsum(both) - both
    ids = np.empty(int(both.sum()), np.int64)
    sep = np.full(len(ids), ord(","), np.uint8)
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    ids[np.arange(len(ids_a)) + np.repeat(start - before_a, in_a)] = ids_a
    ids[np.arange(len(ids_b)) + np.repeat(start + in_a - before_b, in_b)] = ids_b
    sep[start + in_a - 1] = ord("|")
    sep[start + both - 1] = ord(";")
    rows = digits[ids]
    size = width[ids]
    rows[np.arange(len(ids)), size] = sep
    data = rows[np.arange(rows.shape[1]) <= size[:, None]].tobytes()
    return Written(data, np.cumsum(size + 1)[start + both - 1] if groups else np.zeros(0, np.int64))


ALIGNED_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of (doc_id, text) the figures of its alignment, its distinct linked pairs of ids and how often each is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two = tokenizers(path_a, path_b)
        digits, width = _decimals(max(two.a.n_ids, two.b.n_ids))
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                rows = hi - lo
                w = units(batch.column(1).slice(lo, rows))
                ids, at, ends = [], [], []
                fails = np.zeros(rows, bool)
                edge = np.append(w.start, len(w.data))[w.first]
                for enc, vocabulary in ((two.a, two.words_a), (two.b, two.words_b)):
                    x, first = enc.encode(w)
                    size = np.concatenate([[0], np.cumsum(vocabulary.length[x])])
                    got = vocabulary.joined(x)
                    if not np.array_equal(got, w.data):
                        # rows whose tokens do not give back their bytes have none
                        for r in range(rows):
                            part = got[size[first[r]] : size[first[r + 1]]]
                            fails[r] |= not np.array_equal(part, w.data[edge[r] : edge[r + 1]])
                    ids.append(x)
                    at.append(first)
                    ends.append(size)
                for side in (0, 1):
                    count = np.diff(at[side])
                    row = np.repeat(np.arange(rows), count)
                    # offsets within the slice, by the bytes of the texts
                    end = ends[side][1:] - np.repeat(ends[side][at[side][:-1]] - edge[:-1], count)
                    keep = ~fails[row]
                    ids[side], ends[side] = ids[side][keep].astype(np.int64), end[keep]
                    at[side] = np.concatenate([[0], np.cumsum(np.where(fails, 0, count))])
                in_a, in_b = group_sizes(*ends)
                group_row = np.searchsorted(at[0], np.cumsum(in_a) - in_a, "right") - 1
                n_groups = np.bincount(group_row, minlength=rows)
                x, y = links(*ends, in_a, in_b)
                link_row = np.searchsorted(at[0], x, "right") - 1
                pair = ids[0][x] * two.b.n_ids + ids[1][y]
                order = np.lexsort((pair, link_row))
                pair, link_row = pair[order], link_row[order]
                new = np.ones(len(pair), bool)
                new[1:] = (pair[1:] != pair[:-1]) | (link_row[1:] != link_row[:-1])
                new = np.flatnonzero(new)
                times = np.diff(np.append(new, len(pair)))
                cuts = pa.array(np.searchsorted(link_row[new], np.arange(rows + 1)), pa.int32())
                text = written(ids[0], ids[1], in_a, in_b, digits, width)
                last = np.concatenate([[0], text.end])[np.concatenate([[0], np.cumsum(n_groups)])].tolist()
                view = memoryview(text.data)
                sha = [hashlib.sha256(view[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(last, last[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, rows),
                        pa.array(np.diff(at[0])),
                        pa.array(np.diff(at[1])),
                        pa.array(n_groups),
                        pa.array(np.bincount(link_row, minlength=rows)),
                        pa.array(sha, pa.string()),
                        pa.ListArray.from_arrays(cuts, pa.array(pair[new])),
                        pa.ListArray.from_arrays(cuts, pa.array(times)),
                    ],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, ALIGNED_DDL)


def weighed(rows: DataFrame, held: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """Sums over the links whose pairs are ``held`` (pair, count, whether it is its A id's best), and the pairs left."""
    known, count, best = held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            at = column.offsets.to_numpy()
            pair, times = column.values.to_numpy()[at[0] : at[-1]], batch.column(2).flatten().to_numpy()
            at = at - at[0]
            row = np.repeat(np.arange(len(column)), np.diff(at))
            slot = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
            hit = known[slot] == pair if len(known) else np.zeros(len(pair), bool)
            n = len(column)
            total, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(total, row[hit], times[hit] * count[slot[hit]])
            np.add.at(top, row[hit], times[hit] * best[slot[hit]])
            left = pa.array(np.searchsorted(row[~hit], np.arange(n + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(total),
                    pa.array(top),
                    pa.ListArray.from_arrays(left, pa.array(pair[~hit])),
                    pa.ListArray.from_arrays(left, pa.array(times[~hit])),
                ],
                names=["row", "total", "top", "pairs", "times"],
            )

    return rows.select("row", "pairs", "times").mapInArrow(run, "row long, total long, top long, pairs array<long>, times array<long>")


def align_tokens(docs: DataFrame, path_a: str, path_b: str, held_pairs: int = HELD_PAIRS) -> DataFrame:
    """Per row n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of the alignment of its A and B tokens.

    A is a byte-level BPE file on " " + text, B a piece model on the text. A pair's count is the number of rows, corpus-wide,
    that hold it linked; repeated rows count each. The counts of the ``held_pairs`` most frequent pairs go to the tasks,
    a table of bounded size; all others are joined, so every link is weighed.

    Texts that are null or empty, or whose A or B tokens do not give back their bytes (those with U+2581), have no
    tokens: zeros and ''. Ids may be null or repeat. An empty table gives no rows; other columns are not carried.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    found = stage(aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id())).df
    # the number of B ids as the operator's tasks know it
    n_b = tokenizers(path_a, path_b).b.n_ids
    counts = stage(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))).df
    best = stage(counts.groupBy(F.floor(F.col("pair") / n_b).alias("a")).agg(F.max("n").alias("best"))).df
    judged = stage(
        counts.withColumn("a", F.floor(F.col("pair") / n_b)).join(best, "a").select("pair", "n", (F.col("n") == F.col("best")).cast("long").alias("best"))
    )
    most = judged.df.orderBy(F.desc("n"), "pair").limit(held_pairs).toArrow()
    pair, n, top = (most[c].to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    sums = stage(weighed(found, (pair[order], n[order], top[order]))).df
    rest = sums.where(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "times")).alias("_l"))
    rest = rest.select("row", F.col("_l.pairs").alias("pair"), F.col("_l.times").alias("times")).join(judged.df, "pair")
    rest = stage(rest.groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.col("times") * F.col("best")).alias("more_top")))
    out = found.drop("pairs", "times").join(sums.select("row", "total", "top"), "row").join(rest.df, "row", "left")
    release(spark, judged)
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("top") + F.coalesce("more_top", zero)).alias("n_best"),
        (F.col("total") + F.coalesce("more", zero)).alias("count_sum"),
        "groups_sha256",
    )

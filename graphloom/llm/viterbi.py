"""SentencePiece encoding and decoding by a batched Viterbi search.

The text is cut where no piece can reach across; distinct cuts of equal length advance together, one
character a step. Every substring that ends at the step is looked up by its hash among the sorted keys of
the pieces; the best of the sums is kept with its start. The result is the segmentation of the whole text
with the highest sum of the file's scores, as a unigram model defines it; of equal ones the one with the longest
last piece. (A BPE file's scores are its merge ranks, negated: its own merges can give other ids.)
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .text import Words, hash_ranges, slices, string_buffers
from .tokens import CachedIds

SPACE = "▁"
#: What a character without a piece costs below the lowest score, as in SentencePiece.
UNKNOWN = 10.0
#: Longer words are cut between characters that stand together in no piece.
LONG = 48
GROUP_CHARS = 1 << 19

_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_LENGTH = np.uint64(0x165667B19E3779F9)
_SPREAD = np.uint64(0x9FB21C651E98DF25)
FIRST_BITS = 20


class Pieces(CachedIds):
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        model = SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        barred = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in every]
        ids = [i for i in every if not barred[i]]
        texts = [model.id_to_piece(i) for i in ids]
        score = np.array([model.get_score(i) for i in ids])
        if any(c != SPACE and d == SPACE for t in texts for c, d in zip(t, t[1:], strict=False)):
            raise ValueError("pieces that hold a space behind other characters are not supported")
        self.longest = max(map(len, texts))
        keys = np.array([self._key(t) for t in texts], np.uint64)
        order = np.argsort(keys)
        self.piece_keys, self.piece_ids, self.piece_scores = keys[order], np.array(ids)[order], score[order]
        if (self.piece_keys[1:] == self.piece_keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        # most substrings are no piece: their first bits tell
        self.some = np.zeros(1 << FIRST_BITS, bool)
        self.some[(self.piece_keys >> np.uint64(64 - FIRST_BITS)).astype(np.int64)] = True
        self.lines_apart = not any("\n" in t for t in texts)
        self.unknown = float(score.min() - UNKNOWN)
        self.together = {t[i : i + 2] for t in texts for i in range(len(t) - 1)}
        self.bytes = {i: bytes([int(model.id_to_piece(i)[3:5], 16)]) for i in every if model.is_byte(i)}
        by_byte = {v[0]: k for k, v in self.bytes.items()}
        self.byte_ids = [by_byte.get(b, model.unk_id()) for b in range(256)]
        surface = [self.bytes.get(i, b"" if barred[i] else model.id_to_piece(i).replace(SPACE, " ").encode()) for i in every]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array(list(map(len, surface)))
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size

    def _key(self, text: str) -> int:
        total = np.zeros(1, np.uint64)
        for c in text:
            total = total * _BASE + np.uint64(ord(c))
        return int(((total + np.array([len(text)], np.uint64) * _LENGTH) * _SPREAD)[0])

    def cut(self, column: pa.Array) -> Words:
        """Words that begin with their spaces; a text that isn't empty begins with one more."""
        offsets, data = string_buffers(with_first_space(column))
        base = int(offsets[0])
        offsets, data = offsets - base, data[base : int(offsets[-1])]
        space = data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        filled = offsets[:-1][np.diff(offsets) > 0]
        begins[filled] = True
        if self.lines_apart:
            line = data == 10
            begins |= line
            begins[1:] |= line[:-1]
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(data))
        first = np.searchsorted(start, offsets)
        return Words(start, end, None, first, hash_ranges(data, start, end), data)

    def _split(self, word: str) -> list[str]:
        if len(word) <= LONG:
            return [word]
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.together]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def compute(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts, owner = [], []
        for i, raw in enumerate(new):
            for part in self._split(raw.decode("utf-8", "replace").replace(" ", SPACE)):
                parts.append(part)
                owner.append(i)
        by_length = defaultdict(list)
        for i, part in enumerate(parts):
            by_length[len(part)].append(i)
        rows, sizes, flats = [], [], []
        for length, group in by_length.items():
            step = max(1, GROUP_CHARS // length)
            for lo in range(0, len(group), step):
                some = group[lo : lo + step]
                chars = np.frombuffer("".join([parts[i] for i in some]).encode("utf-32-le", "surrogatepass"), "<u4")
                size, flat = self.search(chars.reshape(len(some), length))
                rows.append(np.array(some))
                sizes.append(size)
                flats.append(flat)
        if not rows:
            return np.zeros(len(new), np.int64), np.zeros(0, np.int32)
        row, size, flat = np.concatenate(rows), np.concatenate(sizes), np.concatenate(flats)
        at = np.cumsum(size) - size
        order = np.argsort(row)
        size, at = size[order], at[order]
        begin = np.cumsum(size) - size
        flat = flat[np.repeat(at - begin, size) + np.arange(size.sum())]
        return np.bincount(owner, size, minlength=len(new)).astype(np.int64), flat.astype(np.int32)

    def search(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each row of characters, and all ids; of equal sums the one with the longest last piece."""
        n, length = chars.shape
        prefix = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _BASE + chars[:, j]
        power = [np.uint64(pow(int(_BASE), m, 1 << 64)) for m in range(self.longest + 1)]
        salt = np.arange(self.longest + 1, dtype=np.uint64) * _LENGTH
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((length + 1, n), np.int32)
        piece = np.full((length + 1, n), -1, np.int32)

        def offer(i: int, j: int, at: np.ndarray, total: np.ndarray, ids) -> None:
            better = total > best[j, at]
            at = at[better]
            best[j, at], back[j, at] = total[better], i
            piece[j, at] = ids if np.isscalar(ids) else ids[better]

        for j in range(1, length + 1):
            for i in range(max(0, j - self.longest), j):
                key = (prefix[j] - prefix[i] * power[j - i] + salt[j - i]) * _SPREAD
                at = np.flatnonzero(self.some[(key >> np.uint64(64 - FIRST_BITS)).astype(np.int64)])
                slot = np.minimum(np.searchsorted(self.piece_keys, key[at]), len(self.piece_keys) - 1)
                hit = self.piece_keys[slot] == key[at]
                at, slot = at[hit], slot[hit]
                offer(i, j, at, best[i, at] + self.piece_scores[slot], self.piece_ids[slot])
                if i == j - 1:
                    none = np.ones(n, bool)
                    none[at] = False
                    at = np.flatnonzero(none)
                    offer(i, j, at, best[i, at] + self.unknown, -1)
        at = np.full(n, length)
        steps = []
        rows = np.arange(n)
        while at.any():
            steps.append(np.where(at > 0, piece[at, rows], -2))
            at = np.where(at > 0, back[at, rows], 0)
        taken = np.array(steps[::-1]).T
        size, flat = (taken != -2).sum(1), taken[taken != -2]
        odd = np.flatnonzero((taken == -1).any(1))
        if len(odd):
            parts = np.split(flat, np.cumsum(size)[:-1])
            for row in odd.tolist():
                parts[row] = self._fall_back(parts[row], chars[row])
            size, flat = np.array(list(map(len, parts))), np.concatenate(parts)
        return size, flat

    def _fall_back(self, ids: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Put the bytes of a character in place of an unknown piece."""
        out, at = [], 0
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
                at += len(self.text_of(i))
            else:
                out += [self.byte_ids[b] for b in chr(chars[at]).encode("utf-8", "replace")]
                at += 1
        return np.array(out)

    def text_of(self, i: int) -> str:
        a = self.surface_at[i]
        return self.surface[a : a + self.surface_size[i]].tobytes().decode()

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and where each begins, without the first space of a row."""
        size = self.surface_size[ids]
        total = np.concatenate([[0], np.cumsum(size)])
        data = self.surface[np.repeat(self.surface_at[ids] - total[:-1], size) + np.arange(total[-1])]
        begin = total[at]
        filled = np.flatnonzero(np.diff(begin) > 0)
        drop = begin[:-1][filled][data[begin[:-1][filled]] == 32]
        keep = np.ones(len(data), bool)
        keep[drop] = False
        less = np.concatenate([[0], np.cumsum(~keep)])
        return data[keep], begin - less[begin]


def with_first_space(column: pa.Array) -> pa.Array:
    """SentencePiece's form of a text: its space sign counts as a space, and one goes before all others."""
    column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), SPACE, " ")
    empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    return pc.if_else(pc.equal(column, empty), empty, pc.binary_join_element_wise(space, column, empty))


@lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, model: str, keep_text: bool = False) -> DataFrame:
    """(doc_id, ids, ids_crc32) of (doc_id, text), with the text too if asked for.

    Null and empty texts have no ids. Repeated rows are taken each for itself, a null doc_id is carried, other
    columns are not; an empty table gives no rows. ``ids_crc32`` is that of the ids as little-endian unsigned
    32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                text = batch.column(1).slice(lo, hi - lo)
                ids, at = pieces.encode(text)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                columns = [batch.column(0).slice(lo, hi - lo), lists, pa.array(crc, pa.int64())] + [text] * keep_text
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "ids_crc32"] + ["text"] * keep_text)

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text").mapInArrow(
        run, "doc_id long, ids array<int>, ids_crc32 long" + ", text string" * keep_text
    )


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Digests of what :func:`encode` and :func:`decode` give for each row, without moving ids or texts.

    ``restored`` tells whether the ids spell the text again, a space for each space sign; ``decoded_md5`` is that of the
    text they spell. Rows are as in :func:`encode`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                text = batch.column(1).slice(lo, hi - lo)
                ids, at = pieces.encode(text)
                data, begin = pieces.decode(ids.astype(np.int64), at)
                offsets, given = string_buffers(pc.replace_substring(text.cast(pa.large_string()), SPACE, " "))
                raw, spelt, given = (memoryview(x.tobytes()) for x in (ids.astype("<u4"), data, given))
                rows = zip(at[:-1].tolist(), at[1:].tolist(), begin[:-1].tolist(), begin[1:].tolist(), offsets.tolist(), offsets[1:].tolist(), strict=False)
                crc, md5, same = [], [], []
                for a, b, c, d, e, f in rows:
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                    md5.append(hashlib.md5(spelt[c:d]).hexdigest())
                    same.append(spelt[c:d] == given[e:f])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array(md5, pa.string()),
                        pa.array(same, pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "ids_crc32", "decoded_md5", "restored"],
                )

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text").mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, decoded_md5 string, restored boolean"
    )


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Put ``decoded``, the text of the ids, in the place of ``ids``; null ids are an empty text."""
    at_ids = encoded.columns.index("ids")
    rest = [c for c in encoded.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for batch in batches:
            lists = batch.column(at_ids)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            data, begin = pieces.decode(
                lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
            )
            text = data.tobytes()
            texts = [text[a:b].decode("utf-8", "replace") for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            kept = [c for k, c in enumerate(batch.columns) if k != at_ids]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=[*rest, "decoded"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema if f.name != "ids")
    return encoded.mapInArrow(run, f"{schema}, decoded string")

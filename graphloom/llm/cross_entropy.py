"""Cross-entropy difference of each document under two matched n-gram models.

A target and a background bigram model share vocabulary, smoothing and cut-offs and differ in their counts only:
those of the target documents and those of all documents. A token's loss is the negative logarithm of its
probability after the word before it; the mean difference of the two losses scores the document, low where it is
more like the target than like the rest (Moore and Lewis, 2010).

Counting combines in the tasks and then by key, over all documents. Words and word pairs that make up a millionth
of the target's or of the background's tokens are broadcast with their counts, at most two million of each however large the
corpus. The occurrences of all others are sent to where their word or pair is counted, and what they add
to their document's losses comes back. So every word and every pair counts for what it is in both models.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from .text import Words, mix, slices, words

#: Least share of a model's tokens of what is broadcast, and the weight of the single-word model in that of pairs.
SHARE = 1e-6
PRIOR = 50.0
#: Keys that a task gathers before it hands on its counts.
BUFFER = 1_000_000
#: Tokens of a task that travel together, and tokens that one bucket counts at a time.
GROUP = 1 << 21
BUCKET = 1 << 22

_BEFORE = np.uint64(0xD6E8FEB86659FD93)

COUNTS_DDL = "key long, target long, background long"
SCORES_DDL = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"


class Tally:
    """Counts by key of one task, handed on whenever they reach the buffer's size."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray, target: bool) -> pa.RecordBatch | None:
        key, n = np.unique(keys, return_counts=True)
        counts = np.zeros((len(key), 2), np.int64)
        counts[:, 0 if target else 1] = n
        self.keys.append(key)
        self.counts.append(counts)
        self.held += len(key)
        if self.held >= BUFFER:
            self._combine()
            if self.held >= BUFFER // 2:
                return self.drain()
        return None

    def _combine(self) -> None:
        keys = np.concatenate(self.keys) if self.keys else np.zeros(0, np.int64)
        counts = np.concatenate(self.counts) if self.counts else np.zeros((0, 2), np.int64)
        key, back = np.unique(keys, return_inverse=True)
        total = np.zeros((len(key), 2), np.int64)
        np.add.at(total, back, counts)
        self.keys, self.counts, self.held = [key], [total], len(key)

    def drain(self) -> pa.RecordBatch:
        self._combine()
        key, counts = self.keys[0], self.counts[0]
        self.__init__()
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["key", "target", "background"]
        )


class Models(NamedTuple):
    """Frequent words and pairs of them, sorted, with the counts of both models.

    ``log_p`` has the logs of both probabilities of each word, ``context`` the count of its places as the word before (text
    begin last), ``size`` the number of all words and an unknown one, ``totals`` that of all tokens.
    """

    words: np.ndarray
    log_p: np.ndarray
    context: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    totals: np.ndarray
    size: int


def word_numbers(w: Words, vocabulary: np.ndarray) -> np.ndarray:
    """Place of each word in the vocabulary, its size for another one."""
    key = w.hash.view(np.int64)
    if not len(vocabulary):
        return np.zeros(len(key), np.int64)
    slot = np.minimum(np.searchsorted(vocabulary, key), len(vocabulary) - 1)
    return np.where(vocabulary[slot] == key, slot, len(vocabulary))


def pair_keys(w: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair key, number of the word before, number of the word) of every token; a key is -1 if a word is not in the vocabulary."""
    size = len(vocabulary)
    own = word_numbers(w, vocabulary)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[begins(w)] = size + 1
    return np.where((own < size) & (before != size), before * (size + 1) + own, -1), before, own


def begins(w: Words) -> np.ndarray:
    return w.first[:-1][np.diff(w.first) > 0]


def ends(w: Words) -> np.ndarray:
    return w.first[1:][np.diff(w.first) > 0] - 1


def pair_hashes(w: Words) -> np.ndarray:
    """64-bit hashes of every token and the word before it."""
    before = np.empty_like(w.hash)
    before[1:] = w.hash[:-1]
    before[begins(w)] = 0
    return mix(before * _BEFORE + w.hash)


def _count(docs: DataFrame, target: DataFrame, keys) -> DataFrame:
    """Summed counts of what ``keys`` gives for each slice, over both tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            is_target = batch.column(1).to_numpy(zero_copy_only=False)
            for flag in (False, True):
                text = batch.column(0).filter(pa.array(is_target == flag))
                for lo, hi in slices(text):
                    full = tally.add(keys(words(text.slice(lo, hi - lo))), flag)
                    if full is not None:
                        yield full
        yield tally.drain()

    both = docs.select("text", F.lit(False).alias("target")).unionAll(target.select("text", F.lit(True).alias("target")))
    return both.mapInArrow(run, COUNTS_DDL).groupBy("key").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))


def _totals(counted: DataFrame) -> np.ndarray:
    total = counted.agg(F.sum("target").alias("t"), F.sum("background").alias("b")).first()
    return np.array([total["t"] or 0, total["b"] or 0])


def _often(totals: np.ndarray, share: float) -> Column:
    """Whether a key reaches the share of the tokens in either model."""
    t, b = map(int, totals)
    return ((F.col("target") >= share * t) & (F.col("target") > 0)) | (F.col("background") >= share * b)


def _collected(kept: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and their counts."""
    rows = kept.toArrow()
    key = rows["key"].to_numpy()
    order = np.argsort(key)
    counts = np.column_stack([rows["target"].to_numpy(), rows["background"].to_numpy()])
    return key[order], counts[order]


def train(docs: DataFrame, target: DataFrame, share: float = SHARE) -> Models:
    """The frequent part of both models, counted over all words of ``target`` and of ``docs`` (tables with a ``text``)."""
    counted = stage(_count(docs, target, lambda w: w.hash.view(np.int64))).df
    totals = _totals(counted)
    size = counted.count() + 1
    vocabulary, counts = _collected(counted.where(_often(totals, share)))
    log_p = np.log((counts + 1) / (totals + size))

    def keys(w: Words) -> np.ndarray:
        """Pairs of frequent words, and below zero the last words of the texts."""
        pair, _, own = pair_keys(w, vocabulary)
        return np.concatenate([pair[pair >= 0], -1 - own[ends(w)]])

    pairs, pair_counts = _collected(_count(docs, target, keys).where((F.col("key") < 0) | _often(totals, share)))
    split = int(np.searchsorted(pairs, 0))
    last = np.zeros((len(vocabulary) + 1, 2))
    last[-1 - pairs[:split]] = pair_counts[:split]
    # a text ends once and begins once
    context = np.vstack([counts - last[:-1], np.zeros((1, 2)), last.sum(0)])
    return Models(vocabulary, log_p, context, pairs[split:], pair_counts[split:].astype(np.float64), totals, size)


def known_losses(w: Words, models: Models) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the broadcast counts give of each token's two losses, whether its pair is missing, its pair key and number."""
    key, before, own = pair_keys(w, models.words)
    loss = np.where((before != len(models.words))[:, None], np.log(models.context[before] + PRIOR), 0.0)
    hit = np.zeros(len(key), bool)
    if len(models.pairs):
        slot = np.minimum(np.searchsorted(models.pairs, key), len(models.pairs) - 1)
        hit = models.pairs[slot] == key
        loss[hit] -= np.log(models.pair_counts[slot[hit]] + PRIOR * np.exp(models.log_p[own[hit]]))
    return loss, ~hit, key, own


def _planes(values: np.ndarray) -> bytes:
    """Bytes of the values, first those of one place, then of the next: zeros and repeats stand together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(planes: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


#: What travels: pairs of frequent words by key; pairs with a rare word before by hash, with the word's number; rare words by
#: hash, with the pair's hash; and of each group of documents ids, sizes and the part of the losses known at once.
KNOWN, AFTER_RARE, RARE, DOCUMENTS = range(4)
SENT_DDL = "bucket int, group long, kind int, target boolean, doc binary, a binary, b binary"
ANSWER_DDL = "group long, bucket int, kind int, doc binary, a binary, b binary"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], names=["bucket", "group", "kind", "target", "doc", "a", "b"]
    )


class Group:
    """Documents of a task whose occurrences travel together."""

    def __init__(self):
        self.tokens = self.docs = 0
        self.parts: dict[int, list] = {KNOWN: [], AFTER_RARE: [], RARE: [], DOCUMENTS: []}

    def add(self, ids: pa.Array, w: Words, models: Models) -> None:
        loss, missing, key, own = known_losses(w, models)
        n = np.diff(w.first)
        total = np.concatenate([np.zeros((1, 2)), np.cumsum(loss, axis=0)])
        valid = ids.is_valid().to_numpy(zero_copy_only=False)
        self.parts[DOCUMENTS].append((ids.fill_null(0).to_numpy(), valid, n, total[w.first[1:]] - total[w.first[:-1]]))
        # the place of a document is doubled to tell the last word of a text
        doc = (w.row + self.docs) * 2
        doc[ends(w)] += 1
        hashes = pair_hashes(w)
        rare = own == len(models.words)
        for kind, at, a, b in (
            (KNOWN, missing & (key >= 0), key, key),
            (AFTER_RARE, missing & (key < 0) & ~rare, hashes.view(np.int64), own),
            # 48 bits tell the pairs of one rare word apart
            (RARE, rare, w.hash.view(np.int64), (hashes >> np.uint64(16)).view(np.int64)),
        ):
            self.parts[kind].append((doc[at].astype(np.int32), a[at], b[at]))
        self.tokens += len(own)
        self.docs += len(n)

    def drain(self, group: int, target: bool, buckets: int) -> Iterator[pa.RecordBatch]:
        rows = []
        for kind in (KNOWN, AFTER_RARE, RARE):
            doc, a, b = (np.concatenate(c) for c in zip(*self.parts[kind]))
            bucket = (mix(a.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cut)).tolist():
                at = order[cut[k] : cut[k + 1]]
                more = {KNOWN: b"", AFTER_RARE: _planes(b[at].astype(np.int32)), RARE: _planes(b[at])}[kind]
                rows.append((k, group, kind, target, _planes(np.diff(doc[at], prepend=np.int32(0))), _planes(a[at]), more))
        if not target:
            ids, valid, n, known = (np.concatenate(c) for c in zip(*self.parts[DOCUMENTS]))
            rows.append((group % buckets, group, DOCUMENTS, target, known.tobytes(), ids.tobytes(), np.where(valid, n, -1 - n).astype(np.int64).tobytes()))
        for lo in range(0, len(rows), 256):
            yield _sent(rows[lo : lo + 256])
        self.__init__()


def _send(both: DataFrame, models, buckets: int) -> DataFrame:
    """The occurrences that the broadcast counts leave open, of (doc_id, text, target), by the bucket that counts them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held = {False: Group(), True: Group()}
        for batch in batches:
            is_target = batch.column(2).to_numpy(zero_copy_only=False)
            for flag, group in held.items():
                rows = batch.filter(pa.array(is_target == flag))
                for lo, hi in slices(rows.column(1)):
                    group.add(rows.column(0).slice(lo, hi - lo), words(rows.column(1).slice(lo, hi - lo)), models.value)
                    if group.tokens >= GROUP or group.docs >= GROUP:
                        yield from group.drain(base + made, flag, buckets)
                        made += 1
        for flag, group in held.items():
            if group.docs:
                yield from group.drain(base + made, flag, buckets)
                made += 1

    return both.mapInArrow(run, SENT_DDL)


def _counts(key: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each key in both models, for every occurrence, and the place of its key."""
    found, place = np.unique(key, return_inverse=True)
    counts = np.column_stack([np.bincount(place[at], minlength=len(found)) for at in (target, ~target)])
    return counts[place], place


def _bucket_losses(kind: int, a: np.ndarray, b: np.ndarray, target: np.ndarray, last: np.ndarray, models: Models) -> np.ndarray:
    """What each occurrence of a bucket adds to the two losses of its document."""
    if kind != RARE:
        number = a % (len(models.words) + 1) if kind == KNOWN else b
        return -np.log(_counts(a, target)[0] + PRIOR * np.exp(models.log_p[number]))
    n, place = _counts(a, target)
    p = (n + 1) / (models.totals + models.size)
    before = np.column_stack([np.bincount(place, weights=at & ~last) for at in (target, ~target)])[place]
    context = np.where(last[:, None], 0.0, np.log(before + PRIOR))
    pair = mix(a.view(np.uint64) * _BEFORE + b.view(np.uint64))
    return context - np.log(_counts(pair, target)[0] + PRIOR * p)


def _answer(sent: DataFrame, models, buckets: int, parts: int) -> DataFrame:
    """The sums by document of what the occurrences of each bucket add, and the documents as they were sent."""

    def settle(bucket: int, rows: dict[int, list[tuple]]) -> Iterator[tuple]:
        sums: dict[int, list] = {}
        for kind, of_kind in rows.items():
            size = [len(a) // 8 for _, _, _, a, _ in of_kind]
            target = np.repeat([t for _, t, *_ in of_kind], size)
            doc = [np.cumsum(_values(d, np.int32)) for _, _, d, _, _ in of_kind]
            a = np.concatenate([_values(x, np.int64) for *_, x, _ in of_kind])
            wide = np.int64 if kind == RARE else np.int32
            b = np.concatenate([_values(x, wide) for *_, x in of_kind]) if kind != KNOWN else a
            last = (np.concatenate(doc) & 1).astype(bool)
            loss = _bucket_losses(kind, a, b, target, last, models.value)
            cut = np.cumsum([0, *size])
            for (group, is_target, *_), d, lo, hi in zip(of_kind, doc, cut[:-1], cut[1:], strict=True):
                if not is_target:
                    sums.setdefault(group, []).append((d >> 1, loss[lo:hi]))
        for group, found in sums.items():
            doc, place = np.unique(np.concatenate([d for d, _ in found]), return_inverse=True)
            loss = np.concatenate([x for _, x in found])
            total = np.concatenate([np.bincount(place, weights=loss[:, m]) for m in (0, 1)])
            yield group, bucket, KNOWN, _planes(np.diff(doc.astype(np.int32), prepend=np.int32(0))), total.tobytes(), b""

    def answers(rows: Iterator[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        names = ["group", "bucket", "kind", "doc", "a", "b"]
        columns = list(zip(*rows)) or [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = -1, {}
        for batch in batches:
            for bucket, group, kind, target, doc, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    yield answers(settle(at, held))
                    at, held = bucket, {}
                if kind == DOCUMENTS:
                    yield answers(iter([(group, -1, kind, doc, a, b)]))
                else:
                    held.setdefault(kind, []).append((group, target, doc, a, b))
        yield answers(settle(at, held))

    dealt = sent.repartitionById(parts, F.col("bucket") % parts)
    return dealt.sortWithinPartitions("bucket", "kind", "group").mapInArrow(run, ANSWER_DDL)


def _scores(answers: DataFrame, parts: int) -> DataFrame:
    """The scores of each group's documents from the known part of their losses and all answers."""

    def scored(sizes: np.ndarray, ids: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        n = np.where(sizes < 0, -1 - sizes, sizes)
        empty = n == 0
        mean = total / np.maximum(n, 1)[:, None]
        columns = [mean[:, 0], mean[:, 1], mean[:, 0] - mean[:, 1]]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=sizes < 0), pa.array(n), *(pa.array(c, mask=empty) for c in columns)],
            names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            # the documents of a group come first, in bucket -1
            for kind, doc, a, b in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True):
                if kind == DOCUMENTS:
                    if held is not None:
                        yield scored(*held)
                    held = np.frombuffer(b, np.int64), np.frombuffer(a, np.int64), np.frombuffer(doc, np.float64).reshape(-1, 2).copy()
                else:
                    held[2][np.cumsum(_values(doc, np.int32))] += np.frombuffer(a, np.float64).reshape(2, -1).T
        if held is not None:
            yield scored(*held)

    return answers.repartition(parts, "group").sortWithinPartitions("group", "bucket").mapInArrow(run, SCORES_DDL)


def score_documents(docs: DataFrame, target_ids: DataFrame, share: float = SHARE) -> DataFrame:
    """Mean losses of every (doc_id, text) row under both models and their difference as ``score``.

    ``target_ids`` (doc_id) names the documents of the target; ``share`` only steers what is broadcast. A null, empty or blank text has no tokens and null
    losses. Repeated rows are counted and scored each for itself; a null doc_id is carried and never in the target;
    without a target document its model is uniform. An empty table gives no rows; other columns are not carried.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # the ids grow with the corpus: the same join at every size
    target = stage(docs.join(target_ids.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")).df
    spark = docs.sparkSession
    trained = train(docs, target, share)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * -(-int(trained.totals.sum()) // (BUCKET * parts)) or parts
    models = spark.sparkContext.broadcast(trained)
    both = docs.withColumn("target", F.lit(False)).unionAll(target.select(*docs.columns, F.lit(True)))
    return _scores(_answer(_send(both, models, buckets), models, buckets, parts), parts)

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from graphloom.llm.packing import fullest, intervals, pack, plan
from graphloom.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "",
    "  ",
    "Don't stop<|endoftext|>now ÀÉ é é ſ ŉ ΣΑΣ ΣΑΣ.",
    "日本語 テスト １２ ½ x²",
    "a b c \x1c z\x85q",
    "🎉🎉 'S 'LL we'Re",
    "<|startoftext|> x <|nope|>",
    "İstanbul ªº Ǆ",
]


def test_ids_against_the_tokenizer():
    library = Tokenizer.from_file(PATH)
    flat, at = WordTokenizer(PATH).encode(pa.array(ODD))
    for i, e in enumerate(library.encode_batch(ODD, add_special_tokens=False)):
        assert flat[at[i] : at[i + 1]].tolist() == e.ids, ODD[i]


def test_fullest_combination_against_all():
    rng = random.Random(1)
    for _ in range(100):
        room = rng.randrange(1, 40)
        left = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(rng.randrange(0, 6))}
        sums = {0}
        for length, n in left.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
        used = fullest(room, left)
        assert sum(x * n for x, n in used.items()) == max(sums)
        assert all(n <= left[x] for x, n in used.items())


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    histogram = {rng.randrange(1, 65): rng.randrange(1, 50) for _ in range(30)}
    bins = plan(histogram, 64)
    placed = {}
    for used, times in bins:
        assert sum(x * n for x, n in used.items()) <= 64
        for x, n in used.items():
            placed[x] = placed.get(x, 0) + n * times
    assert placed == histogram
    room = []
    for x in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):  # first fit decreasing
        at = next((i for i, r in enumerate(room) if r >= x), None)
        if at is None:
            room.append(64 - x)
        else:
            room[at] -= x
    assert sum(t for _, t in bins) <= len(room)
    key, per_bin, first, offset = intervals(bins)
    assert (np.diff(key) > 0).all() and (per_bin > 0).all() and (offset < 64).all()


def test_sequences_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None), (900_002, ""), (None, "Null id"), (900_003, "Same"), (900_003, "Same"), (900_004, "wide " * 9_000)], "doc_id long, text string")
    df = docs.select("doc_id", "text").unionAll(extra).selectExpr("*", "1 AS length", "'x' AS piece")
    rows = pack(df, PATH).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for r in df.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want.append((r.doc_id or -1, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert pack(df.limit(0), PATH).collect() == []

import hashlib

import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from graphloom.llm.viterbi import decode, encode, pieces_of, round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello world, tokenization of words.",
    "  two  spaces   and\nlines\t tabs ",
    "",
    " ",
    "x▁y",
    "日本語のテキスト 😀 é́ ﬁ \u0000 ​",
    "a" * 300 + " " + "ab" * 200 + " " + "漢字" * 100,
    "Ciónie que Écho éçà über straße",
]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def best_total(text, score, unknown, longest=16):
    best = [0.0] + [float("-inf")] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - longest), j):
            s = score.get(text[i:j], unknown if j - i == 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def check(library, text, got):
    """The ids spell the text, and no segmentation has a higher total."""
    pieces = pieces_of(PATH)
    ids = pieces.piece_ids.tolist()
    score = dict(zip(map(library.id_to_piece, ids), pieces.piece_scores.tolist(), strict=True))
    own = dict(zip(ids, pieces.piece_scores.tolist(), strict=True))
    assert library.decode(got) == text.replace("\u2581", " ")
    spaced = "\u2581" + text.replace(" ", "\u2581") if text else ""
    unknown = sum(c not in score for c in spaced)
    assert sum(own.get(i, 0) for i in got) + unknown * pieces.unknown == best_total(spaced, score, pieces.unknown)


def test_documents_against_brute_force(library, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 1500").select("doc_id", "text")
    rows = encode(docs, PATH, keep_text=True).collect()
    assert len(rows) > 30
    for r in rows:
        check(library, r.text, list(r.ids))


def test_odd_texts_against_brute_force(library):
    flat, at = pieces_of(PATH).encode(pa.array(TEXTS))
    for i, text in enumerate(TEXTS):
        check(library, text, flat[at[i] : at[i + 1]].tolist())


def test_round_trip_and_edge_cases(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, "x"), (3, "same", "x"), (3, "same", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode(encode(df, PATH, keep_text=True), PATH).collect()
    assert len(got) == len(rows)
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in got)
    assert encode(df.limit(0), PATH).collect() == [] == round_trip(df.limit(0), PATH).collect()
    ids = {str(r.doc_id): r for r in encode(df, PATH).collect()}
    spelt = {str(r.doc_id): r.decoded for r in got}
    for r in round_trip(df, PATH).collect():
        own = ids[str(r.doc_id)]
        assert (r.n_pieces, r.ids_crc32, r.restored) == (len(own.ids), own.ids_crc32, True) or r.doc_id == 3
        assert r.decoded_md5 == hashlib.md5(spelt[str(r.doc_id)].encode()).hexdigest() or r.doc_id == 3

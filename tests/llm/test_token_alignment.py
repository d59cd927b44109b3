import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from graphloom.llm.token_alignment import align_tokens, group_sizes, links, tokenizers, units
from graphloom.llm.tokens import _byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello world, tokenization of words isn't hard: we'll see.",
    "  two  spaces   and\nlines\t tabs \r\n  end  ",
    "", None, " ", "   ", "\n", "\n \n", "x ", "x▁y is not given back", "▁",
    "日本語のテキスト 😀 é́ ﬁ \u0000 ​ ok", "a  b  c 　 d e \x1c f \x85 g allé là",
    "a" * 300 + " " + "ab" * 200 + " " + "漢字" * 100,
    "<|endoftext|> and <s> </s> <0x0A> <unk>", "1234 5678,90 (x){y}\r\n};\r\n",
    "Ciónie que Écho éçà über straße", "Hello world, tokenization of words isn't hard: we'll see.",
]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """Ids and bytes of both sides by the libraries on the whole text."""
    a, b = libraries
    letters = {x: i for i, x in enumerate(_byte_letters())}
    x = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in x.ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    return left, right


def spans(side):
    out, at = [], 0
    for i, data in side:
        out.append((at, at + len(data), i))
        at += len(data)
    return out


def by_force(libraries, rows):
    out, pairs = [], []
    for key, text in rows:
        left, right = tokens(libraries, text) if text else ([], [])
        want = (" " + (text or "")).encode()
        if b"".join(d for _, d in left) != want or b"".join(d for _, d in right) != want:
            out.append([key, 0, 0, 0, 0, ""])
            pairs.append([])
            continue
        x, y = spans(left), spans(right)
        ends = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups, start = [], 0
        for end in ends:
            inside = [",".join(str(i) for p, q, i in s if start <= p and q <= end) for s in (x, y)]
            groups.append("|".join(inside))
            start = end
        found = [(i, j) for p, q, i in x for r, s, j in y if p < s and r < q]
        out.append([key, len(x), len(y), len(groups), len(found), hashlib.sha256(";".join(groups).encode()).hexdigest()])
        pairs.append(found)
    count = Counter(p for found in pairs for p in set(found))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(n, best.get(i, 0))
    for row, found in zip(out, pairs):
        row[5:5] = [sum(count[p] == best[p[0]] for p in found), sum(count[p] for p in found)]
    return sorted((tuple(r) for r in out), key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(t, 1, d, "x") for d, t in rows], "text string, row long, doc_id long, pairs string")
    return sorted((tuple(r) for r in align_tokens(df, A, B, **how).collect()), key=repr)


@pytest.fixture(scope="module")
def rows(sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).slice(0, 60)
    real = [(r["doc_id"], r["text"] and r["text"][:900]) for r in table.to_pylist()]
    return real + [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(1000, "again"), (None, "no id")] + real[:2]


def test_alignment_against_all_pairs(spark, libraries, rows):
    want = by_force(libraries, rows)
    assert run(spark, rows) == want
    # counts of all but a few pairs are joined
    assert run(spark, rows, held_pairs=7) == want
    assert run(spark, rows, held_pairs=0) == want


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_units_give_the_ids_of_whole_texts(libraries, sf_dir):
    a, b = libraries
    two = tokenizers(A, B)
    texts = pq.read_table(f"{sf_dir}/documents.parquet")["text"].to_pylist() + TEXTS
    texts.append("word " * 50_000 + "\n".join(f"line {i} é" for i in range(20_000)))
    column = pa.array(texts, pa.string())
    w = units(column)
    for enc, whole in ((two.a, lambda t: a.encode(" " + t, add_special_tokens=False).ids), (two.b, b.encode)):
        ids, at = enc.encode(w)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == (whole(t) if t else []), t


def test_run_skipping_against_common_ends():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 900):
        for share in (0.0, 0.05, 0.5, 1.0):
            ends = np.arange(1, n + 1)
            x, y = (np.append(ends[:-1][rng.random(n - 1) >= share * rng.random()], n) for _ in range(2))
            in_a, in_b = group_sizes(x, y)
            common = np.intersect1d(x, y)
            assert (np.cumsum(in_a) == np.searchsorted(x, common) + 1).all()
            assert (np.cumsum(in_b) == np.searchsorted(y, common) + 1).all()
            i, j = links(x, y, in_a, in_b)
            begin = [np.concatenate([[0], e[:-1]]) for e in (x, y)]
            want = {(p, q) for p in range(len(x)) for q in range(len(y)) if begin[0][p] < y[q] and begin[1][q] < x[p]} if n < 100 else None
            assert len(i) == (in_a + in_b - 1).sum() and (want is None or set(zip(i.tolist(), j.tolist())) == want)
    assert [len(s) for s in group_sizes(np.zeros(0, int), np.zeros(0, int))] == [0, 0]

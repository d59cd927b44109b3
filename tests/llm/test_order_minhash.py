import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from graphloom.llm.order_minhash import SIMILARITY, banded_matches, compare, labelled, near_duplicates, without_near_duplicates
from graphloom.llm.text import shingles, words


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def grams(text, k=5):
    w = tokens(text)
    out = [tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))] if w else []
    seen = Counter()
    labelled_grams = []
    for g in out:
        labelled_grams.append((g, seen[g]))
        seen[g] += 1
    return labelled_grams


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y):
            last, row[j + 1] = row[j + 1], last + 1 if a == b else max(row[j + 1], row[j])
    return row[-1]


def classes(texts):
    """Brute force over all pairs of different texts: {id: smallest id of its class}."""
    ids = sorted(texts)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    g = {i: grams(texts[i]) for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = g[i], g[j]
            if texts[i] is None or texts[j] is None:
                continue
            total = len(a) + len(b)
            linked = texts[i] == texts[j]
            if not linked and a and b and len(set(a) & set(b)) >= 0.8 * (total - len(set(a) & set(b))):
                m = lcs([x for x, _ in a], [x for x, _ in b])
                linked = m >= 0.8 * (total - m)
            if linked:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_words_and_shingles():
    texts = ["a b  c\td e f", "", None, " x ", "é ü é ü é ü é", "long" * 3000 + " z"]
    w = words(pa.array(texts))
    found = [tokens(t) for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in found]
    flat = [x for t in found for x in t]
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == flat
    assert len(set(w.hash.tolist())) == len(set(flat))
    value, row, at = shingles(w, 5)
    assert [r for t, x in enumerate(found) for r in [t] * (max(len(x) - 4, 1) if x else 0)] == row.tolist()
    assert at.tolist()[:2] == [0, 1]
    assert len(set(labelled(value, row)[row == 4].tolist())) == 3


def test_banded_matches_against_plain_dynamic_programming():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint64)
        y = rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint64)
        assert banded_matches(x, y, 60) == lcs(x.tolist(), y.tolist())
    distance, linked = compare(np.arange(100, dtype=np.uint64), np.arange(5, 100, dtype=np.uint64))
    assert (distance, linked) == (5, True)


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(60):
        texts[i] = " ".join(rng.choice(vocabulary, rng.integers(3, 300)))
    for i in range(60, 120):  # copies with a few words changed each, many of one text
        base = tokens(texts[7 if i % 2 else i - 60])
        for _ in range(int(rng.integers(0, 5))):
            base[int(rng.integers(0, len(base)))] = str(rng.choice(vocabulary))
        texts[i] = " ".join(base)
    texts |= {200: None, 201: None, 202: "", 203: "", 204: "  \n", 205: "one two", 206: "one two"}
    return texts


def test_near_duplicates_against_brute_force(spark, planted):
    df = spark.createDataFrame([Row(doc_id=i, text=t, class_id="x") for i, t in planted.items()], "doc_id long, text string, class_id string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert got == classes(planted)


def test_near_duplicates_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).collect() == []
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (4, text), (4, text), (9, text), (11, "other words here")]
    got = sorted(
        ((r.doc_id, r.class_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()),
        key=str,
    )
    assert got == sorted([(None, None), (4, 4), (4, 4), (9, 4), (11, 11)], key=str)


def test_repeated_lines_do_not_shift_the_alignment(spark):
    """A near copy without the first of many equal lines: its plain shingles align, though all later labels differ."""
    line = [f"form{i}" for i in range(10)]
    whole = [w for k in range(30) for w in [*line, *(f"own{k}x{i}" for i in range(10))]]
    texts = {1: " ".join(whole), 2: " ".join(whole[10:]), 3: " ".join(f"other{i}" for i in range(300))}
    x, y = ([g for g, _ in grams(texts[i])] for i in (1, 2))
    m = lcs(x, y)
    assert m >= 0.8 * (len(x) + len(y) - m)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_pairs_at_exactly_the_similarity():
    assert SIMILARITY == 0.8
    for c, n in [(28, 63), (56, 126), (92, 207), (112, 252)]:
        x, y = np.arange(c, dtype=np.uint64), np.arange(n - c, dtype=np.uint64)
        assert compare(x, y) == (n - 2 * c, True)


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    x, y = (" ".join(f"{p}{i}" for i in range(60)) for p in "xy")
    rows = [(5, "zz " + x), (5, "aa " + y), (7, x + " end"), (8, "y")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(5, 5), (5, 5), (7, 5), (8, 8)]


def test_a_group_of_near_copies_at_the_threshold(spark):
    """Members not linked to the centre find partners of other classes, in blocks."""
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(100)]
    texts = {}
    for i in range(160):
        w = list(base)
        for at in rng.choice(20 if i % 2 else 100, rng.integers(1, 5), replace=False):
            w[at] = f"own{rng.integers(3)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for block in (8, 8192):
        assert {r.doc_id: r.class_id for r in near_duplicates(df, block=block).collect()} == classes(texts)


def test_clashing_columns_and_a_long_text(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, long, "a", "d"), (2, long + " end", "b", "e"), (3, None, "c", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _digest string, digest string")
    assert sorted(tuple(r) for r in without_near_duplicates(df).collect()) == [rows[0], rows[2]]

import math
from collections import Counter

import numpy as np
from pyspark.sql import Row

from graphloom.llm import cross_entropy
from graphloom.llm.cross_entropy import PRIOR, score_documents
from graphloom.llm.mtree import MTree, top_k


def best(ids, vectors, query_id, query, k):
    rows = sorted((-int(v @ query), int(i)) for i, v in zip(ids, vectors) if i != query_id)
    return [(-s, i) for s, i in rows[:k]]


def test_tree_against_all_vectors():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 64, 700):
        vectors = rng.integers(-20, 20, (n, 6))
        vectors[n // 2 :] = vectors[: n - n // 2]  # many equal ones
        ids = rng.permutation(n * 3)[:n]
        tree = MTree(ids, vectors, page=8, branches=4)
        for q in range(min(n, 40)):
            assert tree.search(int(ids[q]), vectors[q], 5) == best(ids, vectors, ids[q], vectors[q], 5)
    same = np.ones((500, 3), np.int64)
    assert MTree(np.arange(500), same, 8, 4).search(3, same[0], 4) == [(3, 0), (3, 1), (3, 2), (3, 4)]


def test_search_leaves_out_what_the_distances_exclude():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 300, (40, 8))
    vectors = np.floor(np.repeat(centres, 50, 0) + rng.normal(0, 2, (2000, 8))).astype(np.int64)
    tree = MTree(np.arange(2000), vectors, 32, 8)
    seen = []
    pages = tree.pages
    tree.pages = type("Watched", (), {"__getitem__": lambda self, i: (seen.append(i), pages[i])[1]})()
    far = int(np.argmax((vectors * vectors).sum(1)))
    assert tree.search(far, vectors[far], 3) == best(np.arange(2000), vectors, far, vectors[far], 3)
    assert len(seen) < len(pages) / 3


def test_top_k_of_a_table(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 1, 5)], "x") for i in range(0, 400)]
    rows += [(400, None, "x"), (450, [1.0, None, 0.0, 0.0, 0.0], "x"), (500, [float("nan")] * 5, "x"), (550, [float("inf")] * 5, "x"), (None, [1.0] * 5, "x"), (600, [], "x")]
    rows.append(rows[50])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = {}
    for r in top_k(df, tree_rows=70, page=8).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    data = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows if i is not None and i < 400}
    data[600] = np.zeros(5, int)
    want = {q: dict(enumerate(best(data, data.values(), q, data[q], 5), 1)) for q in data if q % 50 == 0}
    assert got == want
    assert top_k(df.limit(0)).collect() == []


def test_scores_against_plain_counts(spark):
    rng = np.random.default_rng(4)
    texts = {i: " ".join(rng.choice(["a", "b", "c", "dd", "é"], rng.integers(1, 40))) for i in range(30)}
    rows = [Row(doc_id=i, text=t, score="x") for i, t in texts.items()]
    rows += [Row(doc_id=90, text=None, score="x"), Row(doc_id=91, text=" \n", score="x"), Row(doc_id=None, text="a b", score="x"), Row(doc_id=5, text=texts[5], score="x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    target_ids = spark.createDataFrame([(i,) for i in range(10)] + [(None,), (5,)], "doc_id long")
    every = [r.text or "" for r in rows]
    target = [r.text for r in rows if r.doc_id is not None and r.doc_id < 10]

    def model(docs):
        words, pairs, context = Counter(), Counter(), Counter()
        for d in docs:
            before = None
            for w in d.split():
                words[w] += 1
                pairs[before, w] += 1
                context[before] += 1
                before = w
        total = sum(words.values())
        return lambda h, w: (pairs[h, w] + PRIOR * (words[w] + 1) / (total + size)) / (context[h] + PRIOR)

    size = len({w for d in every for w in d.split()}) + 1
    p_target, p_all = model(target), model(every)
    got = score_documents(df, target_ids).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts.get(r.doc_id, "a b" if r.doc_id is None else "")
        w = text.split()
        assert r.n_tokens == len(w)
        if not w:
            assert r.score is None and r.target_loss is None
            continue
        for p, loss in ((p_target, r.target_loss), (p_all, r.background_loss)):
            assert math.isclose(loss, -sum(math.log(p(h, x)) for h, x in zip([None, *w], w)) / len(w), rel_tol=1e-9)
        assert math.isclose(r.score, r.target_loss - r.background_loss, abs_tol=1e-9)
    assert score_documents(df.limit(0), target_ids).collect() == []
    assert all(r.score is not None for r in score_documents(df.where("doc_id < 3"), target_ids.limit(0)).collect())


def test_rare_words_and_pairs_count(spark, monkeypatch):
    """What is below the share of the tokens counts as exactly as what is broadcast."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, rng.integers(1, 60)) % 90) for _ in range(40)] + ["only here", "only here", "", None, "only"]
    ids = [*range(len(texts) - 1), None]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(3)
    target_ids = spark.createDataFrame([(i,) for i in (*range(0, 40, 3), 41)], "doc_id long")
    whole = {r.doc_id: r for r in score_documents(df, target_ids, 0.0).collect()}
    docs = [(t or "").split() for t in texts]
    vocabulary = len({w for d in docs for w in d}) + 1
    for i, losses in ((k, [whole[k].target_loss, whole[k].background_loss]) for k in (0, 7, 40, None)):
        own = docs[-1] if i is None else docs[i]
        for model, loss in zip(([d for k, d in zip(ids, docs) if k in {*range(0, 40, 3), 41}], docs), losses, strict=True):
            word = Counter(w for d in model for w in d)
            pair = Counter(p for d in model for p in zip([None, *d], d))
            context = Counter(h for d in model for h in [None, *d][: len(d)])
            total = sum(word.values())
            p = [(pair[h, w] + PRIOR * (word[w] + 1) / (total + vocabulary)) / (context[h] + PRIOR) for h, w in zip([None, *own], own)]
            assert math.isclose(loss, -sum(map(math.log, p)) / len(own), rel_tol=1e-9)
    for share, group in ((0.004, 1 << 22), (0.02, 50), (0.2, 300), (2.0, 50)):
        monkeypatch.setattr(cross_entropy, "BUCKET", group)
        got = score_documents(df, target_ids, share).collect()
        assert len(got) == len(texts)
        for r in got:
            want = whole[r.doc_id]
            assert r.n_tokens == want.n_tokens
            if r.n_tokens:
                assert math.isclose(r.target_loss, want.target_loss, rel_tol=1e-9)
                assert math.isclose(r.background_loss, want.background_loss, rel_tol=1e-9)
            else:
                assert r.score is None

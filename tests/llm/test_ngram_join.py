import re

import numpy as np

from graphloom.llm import ngram_join
from graphloom.llm.ngram_join import BEFORE, bitmaps, block_products, may_overlap, ngram_components


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def by_force(rows):
    """(doc_id, size, component) of every row, all pairs compared."""
    sets = [shingle_set(t) for _, t in rows]
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                at[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[root(i)] = min(d, best.get(root(i), d))
    out = [(d, len(s), best.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    return sorted(out, key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(t, "a", d, "x") for d, t in rows], "text string, node string, doc_id long, gram string")
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(df, **how).collect()), key=repr)


def edited(rng, words, edits, kind):
    words = list(words)
    for at in rng.choice(len(words), edits, replace=False).tolist():
        if kind == 0:
            words[at] = f"new{rng.integers(1 << 30)}"
        elif kind == 1:
            words[at] = "same"
        else:
            words[at] += " more"
    return " ".join(words)


def corpus(seed=1):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    # near copies around the threshold of one text, without and with the text itself, beside unlike texts
    for group in range(3):
        base = rng.choice(vocabulary, [100, 60, 240][group])
        if group:
            rows.append(" ".join(base))
        rows += [edited(rng, base, rng.integers(0, 6), k) for k in range(3) for _ in range(25)]
    common = " ".join(rng.choice(vocabulary, 40))
    rows += [common + " " + " ".join(rng.choice(vocabulary, rng.integers(1, 60))) for _ in range(60)]
    rows += [" ".join(rng.choice(vocabulary[:3], rng.integers(1, 9))) for _ in range(60)]
    rows += ["line of words again\n" * int(n) for n in rng.integers(1, 30, 20)]
    rows += ["Short text", "short TEXT", "É É", "é é", "", None, "  \n", "one", "one", "a b c d e", "A B C D E"]
    rows += [" ".join(rng.choice(vocabulary, 30000))] * 2
    ids = rng.permutation(len(rows) * 2)[: len(rows)].tolist()
    rows = list(zip(ids, rows))
    return rows + rows[:3] + [(rows[0][0], rows[-1][1]), (rows[5][0], "other text"), (None, rows[3][1]), (None, "no id here"), (None, None)]


def test_components_against_all_pairs(spark):
    rows = corpus()
    assert run(spark, rows) == by_force(rows)


def test_blocks_of_large_columns(spark, monkeypatch):
    rows = corpus(2)
    monkeypatch.setattr(ngram_join, "PRODUCTS", 50)
    assert run(spark, rows, block=8) == by_force(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_exact_threshold(spark):
    # 36 of 45 shingles in common is exactly 0.8; one less is not
    def text(own, n):
        return " ".join([f"s{i}" for i in range(40 if n else 39)] + [f"{own}{i}" for i in range(4 if own == "a" else 5)])

    for n in (True, False):
        rows = [(1, text("a", n)), (2, text("b", n))]
        assert run(spark, rows) == by_force(rows)
        assert (by_force(rows)[1][2] == 1) is n


def test_products_leave_out_one_class():
    rng = np.random.default_rng(3)
    for _ in range(50):
        m = int(rng.integers(1, 60))
        n = rng.integers(5, 40, m)
        rest = np.maximum(n - rng.integers(0, 4, m), 1)
        label = rng.integers(0, 3, m)
        got = {p for a, b in block_products(np.arange(m), n, rest, label) for p in zip(a.tolist(), b.tolist())}
        want = {
            (i, j)
            for i in range(m)
            for j in range(i + 1, m)
            if label[i] != label[j] and 9 * min(rest[i], rest[j]) >= 4 * (n[i] + n[j])
        }
        assert got == want


def test_a_pair_is_made_where_it_first_meets():
    rng = np.random.default_rng(5)
    heads = [sorted(rng.choice(60, int(rng.integers(1, 30)), replace=False).tolist()) for _ in range(80)]
    made = {}
    for gram in range(60):
        rows = np.array([i for i, h in enumerate(heads) if gram in h], int)
        lists = [heads[i][: heads[i].index(gram)][-BEFORE:] for i in rows]
        before = np.array([h + [~i] * (BEFORE - len(h)) for i, h in zip(rows, lists)]).reshape(-1, BEFORE)
        n = np.full(len(rows), 100)
        for a, b in block_products(rows, n, n, rows, None, before):
            for pair in zip(a.tolist(), b.tolist()):
                made.setdefault(pair, []).append(gram)
    common = {(i, j): [g for g in heads[i] if g in heads[j]] for i in range(80) for j in range(i + 1, 80)}
    common = {pair: grams for pair, grams in common.items() if grams}
    assert made.keys() == common.keys()
    assert all(made[pair][0] == grams[0] for pair, grams in common.items())
    assert sum(map(len, made.values())) - len(common) < 0.4 * (sum(map(len, common.values())) - len(common))


def test_bitmaps_never_exclude_a_link():
    rng = np.random.default_rng(11)
    told = 0
    for _ in range(600):
        n = int(rng.integers(1, 700))
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        other = base.copy()
        swap = rng.random(n) < rng.random() * 0.4
        other[swap] = rng.integers(0, 2**64, int(swap.sum()), dtype=np.uint64)
        bits = [np.frombuffer(bitmaps(v, np.zeros(n, np.int64), 1)[0], np.uint64)[None] for v in (base, other)]
        near = bool(may_overlap(bits[0], bits[1], np.array([n]), np.array([n]))[0])
        both = len(np.intersect1d(base, other))
        assert near or 100 * both < 80 * (2 * n - both)
        told += not near
    assert told > 100

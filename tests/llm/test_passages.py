import random
from pyspark.sql import Row

import numpy as np

from graphloom.llm.passages import GAIN, GAP, chains, passages, winnow, without_passages


def brute_chain_score(x, y):
    best = []
    for i in range(len(x)):
        before = [best[j] - GAP * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
        best.append(GAIN + max([0.0, *before]))
    return max(best)


def test_best_chain_against_all_predecessors():
    rng = random.Random(4)
    for _ in range(100):
        n = rng.randrange(1, 40)
        x = sorted(rng.randrange(0, 300) for _ in range(n))
        y = [rng.randrange(0, 300) for _ in range(n)]
        found = chains(x, y)
        assert sorted(m for c in found for m in c) == list(range(n))
        top = found[0]
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(top, top[1:]))
        score = GAIN * len(top) - GAP * (x[top[-1]] - x[top[0]] + y[top[-1]] - y[top[0]])
        assert abs(score - brute_chain_score(x, y)) < 1e-9


def test_winnowing_against_windows():
    rng = np.random.default_rng(2)
    value = rng.integers(1, 50, 300).astype(np.uint64)
    row = np.repeat([0, 1, 2], [100, 5, 195])
    odd = value | np.uint64(1)
    want = set()
    for i in range(len(value) - 15):
        if row[i] == row[i + 15]:
            low = odd[i : i + 16].min()
            want |= {j for j in range(i, i + 16) if odd[j] == low}
    assert winnow(value, row).tolist() == sorted(want)


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_passages_and_removal(spark):
    rng = random.Random(9)
    shared, other = prose(rng, 80), prose(rng, 120)
    fuzzy = list(other)
    for i in (20, 50, 90):
        fuzzy[i] = "changed"
    del fuzzy[70]
    texts = {
        1: prose(rng, 60) + shared + prose(rng, 60),
        2: shared + prose(rng, 100),
        3: prose(rng, 30) + shared,
        4: prose(rng, 40) + other + prose(rng, 10),
        5: prose(rng, 15) + fuzzy + prose(rng, 70),
        6: prose(rng, 200),
        7: prose(rng, 10) + shared[:40] + prose(rng, 50),
        8: prose(rng, 10) * 30,
    }
    rows = [Row(doc_id=i, text=" ".join(t), source="s") for i, t in texts.items()]
    rows += [Row(doc_id=20, text=None, source="s"), Row(doc_id=21, text="", source=None), Row(doc_id=None, text=" ".join(shared), source="s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {(r.doc_id, r.source_doc_id): r for r in passages(df).collect()}
    assert set(found) == {(2, 1), (3, 1), (5, 4)}
    assert (found[2, 1].start_word, found[2, 1].end_word, found[2, 1].source_start_word, found[2, 1].n_matched) == (0, 80, 60, 80)
    assert (found[3, 1].start_word, found[3, 1].end_word) == (30, 110)
    assert abs(found[5, 4].start_word - 15) <= 2 and abs(found[5, 4].end_word - 134) <= 2
    left = {r.doc_id: r.text for r in without_passages(df, passages(df)).collect()}
    assert left[1] == " ".join(texts[1]) and left[2] == " ".join(texts[2][80:]) and left[3] == " ".join(texts[3][:30])
    assert left[20] is None and left[21] == "" and set(left) == {1, 2, 3, 4, 5, 6, 7, 8, 20, 21, None}


def test_whole_copies_empty_tables_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(70))
    df = spark.createDataFrame([(3, text), (3, text), (5, text), (9, text + "  ")], "doc_id long, text string")
    found = sorted((r.doc_id, r.start_word, r.end_word, r.source_doc_id) for r in passages(df).distinct().collect())
    assert found == [(5, 0, 70, 3), (9, 0, 70, 3)]
    assert sorted(r.doc_id for r in without_passages(df, passages(df)).collect()) == [3, 3]
    assert passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def covered(found, doc_id):
    return {k for r in found if r.doc_id == doc_id for k in range(r.start_word, r.end_word)}


def test_repeats_whose_seeds_earlier_documents_hold(spark):
    """Fragments and phrases of a passage in earlier documents do not hide its repeat between later ones."""
    rng = random.Random(21)
    long, short, mixed, line = prose(rng, 60), prose(rng, 55), prose(rng, 55), prose(rng, 1)
    texts = {
        1: prose(rng, 20) + long[:40] + prose(rng, 20),
        2: prose(rng, 20) + short[12:42] + prose(rng, 20),
        3: [w for k in range(0, 50, 10) for w in [*mixed[k : k + 7], *prose(rng, 9)]],
        10: prose(rng, 30) + long + prose(rng, 30) + short + prose(rng, 5),
        11: prose(rng, 10) + mixed + prose(rng, 30) + line * 200,
        20: prose(rng, 7) + short + prose(rng, 40) + long,
        21: prose(rng, 33) + mixed + prose(rng, 12) + line * 170 + prose(rng, 9),
    }
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    found = passages(df).collect()
    assert covered(found, 20) >= {*range(7, 62), *range(102, 162)}
    assert covered(found, 21) >= {*range(33, 88), *range(100, 270)}
    assert not any(covered(found, i) for i in (1, 2, 3, 10, 11))
    for r in found:
        assert r.source_doc_id < r.doc_id and r.n_matched >= 0.8 * (r.end_word - r.start_word)


def test_superseded_tables_are_released(spark, monkeypatch):
    from graphloom.llm import passages as module

    staged, released = [], []
    stage, release = module.stage, module.release
    monkeypatch.setattr(module, "stage", lambda df: (staged.append(stage(df)), staged[-1])[1])
    monkeypatch.setattr(module, "release", lambda s, *tables: (released.extend(t.path for t in tables), release(s, *tables))[1])
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([Row(doc_id=1, text=text), Row(doc_id=2, text="x " + text)])
    assert [(r.doc_id, r.start_word, r.end_word) for r in passages(docs).distinct().collect()] == [(2, 1, 81)]
    # what the result still reads: passages found, the whole runs and their texts
    assert len(staged) - len(released) == 3

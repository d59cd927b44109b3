import re
from collections import Counter

from pyspark.sql import Row

from graphloom.llm import label_model
from graphloom.llm.label_model import classify, fit_labels, good_documents
from graphloom.llm.quality_rules import passing, quality_rules

PROSE = "the road to the town and the bridge of stone is in the valley with a mill that was built for them by one"

TEXTS = {
    1: None,
    2: "",
    3: " \t\n\x0b\f\r ",
    4: "\n".join([PROSE + f" {i} {i * 7}" for i in range(9)]),
    5: "a b c " * 40,
    6: "x\ty\nx\ty\n\n \nz\r\nz\r\n",
    7: "£ é\x1cü b#c *$%&|<> " + " ".join(f"the w{i}" for i in range(60)),
    8: " ".join(f"Of{i}!!" for i in range(70)),
    9: "one two three one two three one two",
    10: "w" * 500_000 + " " + " ".join(f"the word{i}" for i in range(40_000)),
    11: "\n".join(f"the word{i} of stone{i} is there" for i in range(20)),
}


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    covered = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 3)}
    base = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        base,
    )


def test_counts_against_brute_force(spark):
    rows = [Row(doc_id=i, text=t, n_words="clash", kept=5) for i, t in TEXTS.items()] + [Row(doc_id=None, text=TEXTS[11], n_words=None, kept=None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, kept int")
    got = quality_rules(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r.doc_id] if r.doc_id else TEXTS[11]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(text), r.doc_id
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {7, 11, None}
    left = passing(df)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == kept
    assert quality_rules(df.limit(0)).collect() == []


def test_label_model_recovers_accuracies():
    import numpy as np

    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    right = [0.95, 0.9, 0.8, 0.7, 0.9, 0.6]
    votes = np.stack([np.where(rng.random(len(truth)) < p, 1, -1) * np.where(truth, 1, -1) for p in right], axis=1)
    votes[rng.random(votes.shape) < 0.2] = 0
    votes[rng.random(votes.shape) < 0.1] = label_model.SILENT
    pattern, count = np.unique(votes, axis=0, return_counts=True)
    model = fit_labels(pattern, count.astype(float))
    guess = model.posterior(votes) > 0.5
    assert (guess == truth).mean() > 0.95
    assert abs(model.prior - 0.8) < 0.02
    accuracy = model.table[1, :, 2] / (model.table[1, :, 0] + model.table[1, :, 2])
    assert np.abs(accuracy - right).max() < 0.04


def test_held_out_accuracy_and_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in classify(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert len(got) == 1000
    right = [got[i].kept == (q == 1) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.95
    clean = [got[i].kept for i, q in labels.items() if q == 1]
    assert sum(clean) / len(clean) > 0.98


def test_classifier_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (None, PROSE, "x"), (5, PROSE, None), (5, PROSE, None), (6, "word " * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = classify(df).collect()
    assert len(got) == 7 and not any(r.kept for r in got if r.doc_id in (1, 2, 3)) and all(r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert all(r.kept for r in got if r.doc_id in (5, None))
    left = good_documents(df)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.where("doc_id IS NULL OR doc_id = 5").collect()) == ["5", "5", "None"]
    assert classify(df.limit(0)).collect() == [] and good_documents(df.limit(0)).collect() == []

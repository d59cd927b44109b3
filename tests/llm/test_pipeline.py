"""The pipeline's stages on planted documents, each held against what it must do to its own input."""

import random

import corpus_pipeline
from graphloom.llm.quality_rules import quality_rules

FUNCTION_WORDS = "the of and to in that is was for with".split()


def prose(rng, n):
    """Words with a function word every third place, in lines of about twenty."""
    out = [rng.choice(FUNCTION_WORDS) if i % 3 == 0 else f"word{rng.randrange(20_000)}" for i in range(n)]
    return " ".join(w + "\n" if i % 20 == 19 else w for i, w in enumerate(out)).strip()


def planted():
    rng = random.Random(8)
    docs = {i: prose(rng, rng.randrange(120, 400)) for i in range(60)}
    copies = {100: docs[3], 101: docs[3] + " ending", 102: docs[5].replace("the", "a", 1)}
    passage = prose(rng, 90)
    shared = {200: prose(rng, 150) + "\n" + passage, 201: passage + "\n" + prose(rng, 160), 202: prose(rng, 70) + "\n" + passage + "\n" + prose(rng, 130)}
    poor = {300: "Bad!! " * 80, 301: "short text", 302: None, 303: "", 304: " ".join(f"x{i}%%%" for i in range(90))}
    return docs, copies, shared, poor, passage


def test_stages_do_their_part(spark):
    docs, copies, shared, poor, passage = planted()
    rows = [(i, t, "en", "s", len(t or "")) for i, t in {**docs, **copies, **shared, **poor}.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    start, seen = df, {}
    for name, step in corpus_pipeline.STAGES:
        before = df
        df = step(spark, df, "").cache()
        seen[name] = {r.doc_id: r for r in df.collect()}
        if name != "best_fit_packing":
            assert df.columns == before.columns, name
    kept = {r.doc_id for r in quality_rules(start).collect() if r.kept}
    assert set(seen["quality_rules"]) == kept == set(docs) | set(copies) | set(shared)
    assert set(seen["quality_classifier"]) == kept
    assert set(seen["near_duplicates"]) == set(docs) | set(shared)
    left = seen["substring_dedup"]
    assert set(left) == set(docs) | set(shared)
    flat = " ".join(passage.split())
    for i in (201, 202):
        assert flat not in " ".join(left[i].text.split()) and left[i].n_chars == len(left[i].text) > 300
    assert left[200].text == shared[200] and all(left[i].text == t for i, t in docs.items())
    packed = df.collect()
    assert {r.doc_id for r in packed} == set(left) and all(r.offset + r.length <= 2048 for r in packed)


def test_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, _spans string, _digest string, node long"
    rng = random.Random(4)
    text = prose(rng, 200)
    for rows in ([], [(1, None, None, None, None, "x", "y", None, "p", 1)], [(None, text, "en", None, 5, "x", None, "s", "d", 2), (2, text, "en", None, 5, None, "y", "s", None, 3), (2, text, "en", None, 5, None, "y", "s", None, 3)]):
        df = spark.createDataFrame(rows, schema)
        for name, step in corpus_pipeline.STAGES[:-1]:
            df = step(spark, df, "")
            assert df.columns == [c.split()[0] for c in schema.split(", ")]
        left = df.collect()
        assert sorted(str(r.doc_id) for r in left) == (["2", "None"] if len(rows) == 3 else [])
        assert len(corpus_pipeline.STAGES[-1][1](spark, df, "").collect()) == len(left)

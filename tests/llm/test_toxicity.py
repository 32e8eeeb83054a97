"""The lexicon, its matching against a brute-force scan, and held-out accuracy on the small table."""

import os
import random

import pytest

from optrail.llm.toxicity import Lexicon, Matcher, fold, learn_lexicon, score_toxicity

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("text, folded", [("An 1D10T!", " an idiot "), ("mоrоn", " moron "), ("st0p 5tupid id1ot", " stop stupid idiot "), ("in 2004, 13 days", " in 2004 13 days "), (None, ""), ("!!", ""), ("ｃｌｏｗｎ s​cum", " clown scum ")])
def test_fold(text, folded):
    assert fold(text) == folded


def test_matches_equal_a_plain_scan():
    rng = random.Random(3)
    terms = {"bad": 2.0, "worse": 1.5, "bad luck": 0.5}
    matcher = Matcher(Lexicon(terms, ("bad luck charm", "not bad")))
    for _ in range(300):
        words = [rng.choice("bad worse luck charm not so".split()) for _ in range(rng.randrange(12))]
        void = [(i, i + len(e)) for e in (["bad", "luck", "charm"], ["not", "bad"]) for i in range(len(words)) if words[i : i + len(e)] == e]
        found = [w for t, w in terms.items() for i in range(len(words)) if words[i : i + len(t.split())] == t.split() and not any(a <= i and i + len(t.split()) <= b for a, b in void)]
        total, n = matcher.hits(f" {' '.join(words)} " if words else "")
        assert (round(total, 9), n) == (round(sum(found), 9), len(found))


def test_learned_on_a_fixture(spark):
    rng = random.Random(5)
    plain = ["the", "of", "and", "house", "tree", "runs"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words.insert(rng.randrange(30), rng.choice(["m0ron", "idiot", "moron"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(i % 4 == 0)))
    labels += [(None, 1), (3, None)]
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (0, "moron", "y")], "doc_id long, text string, score string")
    lexicon = learn_lexicon(docs.where("doc_id < 300"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(lexicon.terms) == {"moron", "idiot"}
    got = score_toxicity(docs, lexicon).collect()
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got if r.doc_id < 400)
    assert len({r.score for r in got if r.doc_id >= 900}) == 1
    nothing = learn_lexicon(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.predicted == 0 for r in score_toxicity(docs, nothing).collect())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_accuracy(spark):
    from optrail.llm.queries import op4_toxicity

    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = [r for r in op4_toxicity(spark, DATA).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in got) / len(got) > 0.9

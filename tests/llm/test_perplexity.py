"""The quality rules against plain versions: counts of a text, the Kneser-Ney model, scores by either way, bands and verdicts."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from optrail.llm.perplexity import ABOVE, BELOW, ORDER, Model, count_grams, features, judge, kneser_ney
from optrail.llm.queries import QUERIES

SPACES = " \t\n\x0b\x0c\r"
DATA = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def split(text):
    return "".join(" " if c in SPACES else c for c in text or "").split(" ")


def words_of(text):
    return [w for w in split(text) if w]


class Plain:
    """Modified Kneser-Ney over bytes of words, straight from its definition."""

    def __init__(self, texts):
        self.c = [Counter() for _ in range(ORDER + 1)]
        for t in texts:
            for w in words_of(lower(t or "")):
                y = b" " + w.encode() + b" "
                for i in range(1, len(y)):
                    g = y[max(0, i + 1 - ORDER) : i + 1]
                    self.c[len(g)][g] += 1
        for k in range(ORDER - 1, 0, -1):
            self.c[k].update({g: n for g, n in Counter(x[1:] for x in self.c[k + 1]).items()})
        self.d, self.after = [None], defaultdict(Counter)
        for k in range(1, ORDER + 1):
            n = [list(self.c[k].values()).count(i) for i in range(5)]
            d = [0, 0.5, 1.0, 1.5]
            if all(n[1:]):
                y = n[1] / (n[1] + 2 * n[2])
                own = [0, *(i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3))]
                d = own if all(x > 0 for x in own[1:]) else d
            self.d.append(d)
            for g, x in self.c[k].items():
                self.after[g[:-1]][g[-1]] = x

    def p(self, context, b):
        if context not in self.after and context:
            return self.p(context[1:], b)
        below = self.p(context[1:], b) if context else 1 / 256
        own = self.after[context]
        if not own:
            return below
        d = self.d[len(context) + 1]
        cut = lambda x: d[min(x, 3)] if x else 0
        total = sum(own.values())
        return (own[b] - cut(own[b])) / total + sum(map(cut, own.values())) / total * below

    def score(self, word):
        y = b" " + word + b" "
        return sum(math.log10(self.p(y[max(0, i + 1 - ORDER) : i], y[i])) for i in range(1, len(y)))


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(60)]
    rows = [(i, rng.choice(["x", "y", None]), " ".join(rng.choices(vocabulary, k=rng.choice([3, 25, 60])))) for i in range(n)]
    return [*rows, (900, "x", None), (901, "x", ""), (902, "z", "The #quick fox Émil"), (None, "x", "ab ab"), (3, rows[3][1], rows[3][2])]


SCHEMA = "doc_id long, lang string, text string"


def test_model(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = Model.of(kneser_ney(count_grams(df)))
    for lang in ("x", "y", "", "z"):
        plain = Plain([t for _, k, t in rows if (k or "") == lang])
        known = sorted({w for _, k, t in rows if (k or "") == lang for w in words_of(lower(t or ""))})
        unseen = ["abcabcabc", "q", "éé", "aaaaaaaaaaaa", "zebra"]
        words = [w.encode() for w in known + unseen]
        assert np.allclose(model.score(lang, words), [plain.score(w) for w in words], atol=1e-4)
        for context in (b"", b" ", b" a", b"ab", b"abca"):
            assert abs(sum(plain.p(context, b) for b in range(256)) - 1) < 1e-9
    assert kneser_ney(count_grams(df.where("false"))).count() == 0


def plain_features(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = [i for i, w in enumerate(windows) if windows.count(w) > 1]
    seen, again = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len({k for i in hit for k in range(i, i + 8)})


def test_features():
    rng = random.Random(4)
    texts = ["", " \n\t", "a b c d e f g h " * 2, "one\ntwo\n\n \none \none", "é|#<>é   x"]
    for _ in range(60):
        line = " ".join(rng.choices(["a", "b", "é", "#x|"], k=rng.randint(0, 12)))
        texts.append("".join(rng.choice([line, "a b a b\n", "\n", " ", "w" + str(rng.random())]) for _ in range(rng.randint(0, 9))))
    assert features([t.encode() for t in texts]) == [plain_features(t) for t in texts]


def plain_verdicts(rows):
    models = {lang: Plain([t for _, k, t in rows if (k or "") == lang]) for lang in {k or "" for _, k, _ in rows}}
    out, levels = [], defaultdict(list)
    for doc_id, k, t in rows:
        words = [w.encode() for w in words_of(lower(t or ""))]
        f = plain_features(t)
        failed = f[0] < 20 or 100 * f[4] > 30 * f[0]
        level = -sum(map(models[k or ""].score, words)) / sum(len(w) + 1 for w in words) if words else None
        out.append((doc_id, k or "", f, failed, level))
        if not failed:
            levels[k or ""].append(math.floor(level * 1000))
    middle = lambda v: sorted(v)[(len(v) + 1) // 2 - 1]
    band = {}
    for k, v in levels.items():
        m = middle(v)
        d = max(1, middle([abs(x - m) for x in v])) * 1.4826
        band[k] = (m - d * BELOW) / 1000, (m + 1 + d * ABOVE) / 1000
    return [(i, k, *f, failed, not failed and band[k][0] <= level <= band[k][1], level) for i, k, f, failed, level in out]


def settled(rows):
    return sorted(((*r[:-1], None if r[-1] is None else round(r[-1], 3)) for r in rows), key=repr)


@pytest.mark.parametrize("most_sent", [10**6, 0])
def test_verdicts(spark, most_sent):
    """By a model that is sent to the workers, and by joins with it."""
    rows = corpus(2)
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("text", "t").selectExpr("*", "t AS text", "1 AS row", "'?' AS word").drop("t")
    got = judge(df.repartition(3), most_sent=most_sent)
    columns = ["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level"]
    assert settled(map(tuple, got.select(columns).collect())) == settled(plain_verdicts(rows))
    assert judge(df.where("false"), most_sent=most_sent).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_query_against_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang", "text").collect()]
    got = QUERIES["op11_perplexity"](spark, DATA).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level").collect()
    assert settled(map(tuple, got)) == settled(plain_verdicts(rows))


def test_texts_of_another_language_go(spark):
    rng = random.Random(7)
    make = lambda letters: ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(40)]
    own, other = make("abcdef"), make("uvwxyz")
    rows = [(i, "x", " ".join(rng.choices(own, k=80))) for i in range(100)] + [(200 + i, "x", " ".join(rng.choices(other, k=80))) for i in range(3)] + [(300, "x", "a " * 90)]
    got = {r.doc_id: r.kept for r in judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[i] for i in range(100)) >= 97 and not any(got[i] for i in (200, 201, 202, 300))


def test_very_long_texts_and_words(spark):
    rows = [(1, "x", "ab cd ef " * 300_000), (2, "x", "q" * 3_000_000), (3, "x", "é" * 500_000 + " ab " * 30), (4, None, "\n" * 1_000_000), (5, "x", " ".join(f"w{i}" for i in range(200_000)))]
    got = {r.doc_id: r for r in judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i].n_words for i in (1, 2, 3, 4, 5)] == [900_000, 1, 31, 0, 200_000]
    assert got[1].base_failed and got[1].n_repeat_words == 900_000 and got[2].word_chars == 3_000_000 and got[3].word_chars == 500_060 and not got[5].base_failed
    assert got[4].level is None and not got[4].kept

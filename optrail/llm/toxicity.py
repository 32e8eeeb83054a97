"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded_sample, lean, others, schema_of, schema_text

# Letters that look like Latin ones, and digits or signs that stand for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнαορεικνυτχвзгпԛԝ", "aeopcyxijsdhkmtbhaopeiknytxbegnqw", strict=True))
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

#: One of 64 bits of a signed long, to tell roughly how many different things were seen.
SPREAD = [1 << i for i in range(63)] + [-(1 << 63)]
COUNTS = (("word", "string"), ("mark", "int"), ("n", "long"), ("spread", "long"))
_GLYPHS, _LETTERS = str.maketrans(HOMOGLYPHS), str.maketrans(LEET)
_ODD = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_MARKS = re.compile("[" + re.escape("".join(LEET)) + "]+")
_GAPS = re.compile(r"[\W_]+")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")


def _as_letters(m: re.Match) -> str:
    """Digits and signs between letters, or beside two of them at a word's edge, stand for letters."""
    text, a, b = m.string, m.start(), m.end()
    left, right = text[max(0, a - 2) : a], text[b : b + 2]
    inside = left[-1:].isalpha() and right[:1].isalpha()
    first = not left[-1:].isalnum() and len(right) == 2 and right[0].isalpha() and right[1].isalnum()
    last = not right[:1].isalnum() and len(left) == 2 and left.isalpha() and m[0].isdigit()
    return m[0].translate(_LETTERS) if inside or first or last else m[0]


def fold(text: str | None) -> str:
    """Words of a text in lower case and compatibility form, with homoglyphs and digit substitutions undone,
    one space around each; empty for a text without words. Accents stay, for they tell words apart."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
        if _ODD.search(text):
            text = text.translate(_GLYPHS)
    text = _GAPS.sub(" ", _MARKS.sub(_as_letters, text)).strip()
    return f" {text} " if text else ""


@dataclass(frozen=True)
class Lexicon:
    """Terms and their weights, phrases that void the terms inside them, and the score's slope, length power and offset."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    power: float = 0.0
    offset: float = -2.0


def uncovered(found: list[tuple[int, int, float]], voided: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """Those of ``found`` that lie in none of ``voided``: one sweep by start, with the farthest end so far."""
    out, i, reach = [], 0, -1
    voided.sort()
    for a, b, w in sorted(found):
        while i < len(voided) and voided[i][0] <= a:
            reach = max(reach, voided[i][1])
            i += 1
        if b > reach:
            out.append((a, b, w))
    return out


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, ahocorasick.Automaton()
        for term, weight in lexicon.terms.items():
            self.automaton.add_word(f" {term} ", (weight, len(term) + 2))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(f" {phrase} ", (None, len(phrase) + 2))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, folded: str) -> tuple[float, int]:
        """Summed weights and number of the terms that no exception phrase covers. One pass over the whole text."""
        if not len(self.automaton):
            return 0.0, 0
        found, voided = [], []
        for end, (weight, size) in self.automaton.iter(folded):
            if weight is None:
                voided.append((end - size + 1, end))
            else:
                found.append((end - size + 1, end, weight))
        if voided:
            found = uncovered(found, voided)
        return math.fsum(w for _, _, w in found), len(found)

    def score(self, text: str | None) -> tuple[float, int]:
        """Score and hits; the sum is divided by a power of the length."""
        folded, x = fold(text), self.lexicon
        total, n = self.hits(folded)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x.slope * total / (1 + n_words(folded)) ** x.power + x.offset)))), n


def n_words(folded: str) -> int:
    return max(0, folded.count(" ") - 1)


def marked() -> list:
    return [F.sum(F.when(F.col("mark") == mark, F.col("n")).otherwise(0)).alias(name) for name, mark in (("bad", 1), ("good", 0))]


def labelled_sample(labels: DataFrame, most: int, mark: str = "toxic") -> DataFrame:
    """At most ``most`` (doc_id, mark) rows, one per document, those of smallest digest of the id: the bound
    of what is learned from and of what is broadcast. Nulls and ids with two marks are left out."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(mark).isin(0, 1)).groupBy("doc_id").agg(F.min(mark).alias("mark"), F.max(mark).alias("_most")).where("mark = _most")
    return bounded_sample(one.select("doc_id", "mark"), "doc_id", labels.count(), most, "sample")


def learn_lexicon(docs: DataFrame, labels: DataFrame, most: int = 200_000, support: int = 3, margin: float = 2.5) -> Lexicon:
    """Learn terms, exceptions and the score's form from labelled documents.

    ``labels`` (doc_id, toxic) is cut to ``most`` rows and broadcast. A word is a term if ``support`` marked
    documents hold it, after as many different words (else copies of one document would make terms of
    all its words), and its log-odds are above ``margin``; an exception is a pair of words around a term that
    only unmarked documents hold, again in different surroundings. Only what passes reaches the driver.

    Labels that are null or neither 0 nor 1, ids that are null or have two marks, and documents without a label are not
    learned from; null and empty texts count as documents without words; repeated rows of a document count each;
    extra columns are ignored; without labels or documents the lexicon has no terms.
    """
    sample = labelled_sample(labels, most)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        after: dict[str, int] = {}

        def flush():
            rows = [(w, mark, n, after.get(w, 0) if mark else 0) for mark in (0, 1) for w, n in held[mark].items()]
            held[0].clear()
            held[1].clear()
            after.clear()
            return batch_of(rows, COUNTS)

        for batch in batches:
            for text, mark in zip(batch.column("text"), batch.column("mark").to_pylist(), strict=True):
                words = fold(text.as_py()).split()
                held[mark].update(set(words))
                held[mark][""] += 1
                if mark:
                    for left, word in zip(["", *words], words, strict=False):
                        after[word] = after.get(word, 0) | SPREAD[crc32(left.encode()) & 63]
                if len(held[0]) + len(held[1]) > 300_000:
                    yield flush()
        yield flush()

    tally = chosen.select("text", "mark").mapInArrow(lean(counts), schema_text(COUNTS)).groupBy("word").agg(*marked(), F.bit_count(F.bit_or("spread")).alias("spread"))
    kept = tally.where((F.col("word") == "") | (F.col("bad") >= support) & (F.col("spread") >= support)).collect()
    all_bad, all_good = next(((r.bad, r.good) for r in kept if r.word == ""), (0, 0))
    odds = {r.word: math.log((r.bad + 0.5) / (all_bad + 1)) - math.log((r.good + 0.5) / (all_good + 1)) for r in kept if r.word}
    terms = {w: min(x, 6.0) for w, x in odds.items() if x >= margin}
    return fit_form(chosen, terms, all_bad, all_good)


def fit_form(chosen: DataFrame, terms: dict[str, float], all_bad: int, all_good: int) -> Lexicon:
    """Exceptions and the logistic form, from the sample's hits; three numbers a document reach the driver."""
    if not terms or not all_bad:
        return Lexicon(terms)
    bare = Lexicon(terms)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for text, mark in zip(batch.column("text"), batch.column("mark").to_pylist(), strict=True):
                words, near = fold(text.as_py()).split(), {}
                for i in (i for i, w in enumerate(words) if w in terms):
                    for a in (i - 1, i):
                        if 0 <= a and a + 1 < len(words):
                            near[f"{words[a]} {words[a + 1]}"] = SPREAD[crc32(" ".join(words[max(0, a - 1) : a] + words[a + 2 : a + 3]).encode()) & 63]
                for pair, bit in near.items():
                    n, bits = pairs.get((pair, mark), (0, 0))
                    pairs[pair, mark] = (n + 1, bits | bit)
        yield batch_of([(p, mark, n, bits) for (p, mark), (n, bits) in pairs.items()], COUNTS)

    pairs = chosen.select("text", "mark").mapInArrow(lean(around), schema_text(COUNTS)).groupBy("word").agg(*marked(), F.bit_count(F.bit_or("spread")).alias("spread"))
    exceptions = tuple(sorted(r.word for r in pairs.where("good >= 3 and bad = 0 and spread >= 3").collect()))
    bare = Lexicon(terms, exceptions)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(bare)
        for batch in batches:
            rows = []
            for text, mark in zip(batch.column("text"), batch.column("mark").to_pylist(), strict=True):
                folded = fold(text.as_py())
                rows.append((matcher.hits(folded)[0], n_words(folded), mark))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.float64(), pa.int64(), pa.int32()), strict=True)], names=["total", "words", "mark"])

    got = chosen.select("text", "mark").mapInArrow(lean(features), "total double, words long, mark int").groupBy("total", "words", "mark").count().collect()
    total, words, mark, weight = (np.array([r[i] for r in got], float) for i in range(4))
    best = min((fit_logistic(total / (1 + words) ** power, mark, weight) + (power,) for power in (0.0, 0.25, 0.5, 0.75, 1.0)), key=lambda x: x[2])
    return Lexicon(terms, exceptions, slope=best[0], offset=best[1], power=best[3])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Slope, offset and loss of a one-feature logistic fit by damped Newton steps with a small ridge."""
    scale = max(float(np.sqrt(np.average(x * x, weights=weight))), 1e-9)
    z, w = np.stack([x / scale, np.ones_like(x)], 1), np.array([1.0, -1.0])

    def loss(v):
        return float(np.sum(weight * np.logaddexp(0, np.where(y == 1, -(z @ v), z @ v)))) + 0.5 * v[0] * v[0] * 1e-2

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + np.array([1e-2 * w[0], 0])
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-9]), gradient)
        rate, here = 1.0, loss(w)
        while rate > 1e-4 and loss(w - rate * step) > here:
            rate /= 2
        w = w - rate * step
    return float(w[0] / scale), float(w[1]), loss(w)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """Add score double (0 to 1), predicted int (score >= 0.5) and hits int.

    Null and empty texts have no hits and get the score of an empty text. Other columns are passed through
    (columns named like the added ones, in any case, give way); repeated rows score alike; an empty table gives none.
    """
    base = docs.select(*others(docs, "score", "predicted", "hits"))
    keep = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            scores, hits = [], []
            for value in batch.column(text):
                score, n = matcher.score(value.as_py())
                hits.append(n)
                scores.append(score)
            predicted = [int(s >= 0.5) for s in scores]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array(predicted, pa.int32()), pa.array(hits, pa.int32())], names=[*keep, "score", "predicted", "hits"])

    return base.mapInArrow(lean(run), schema_of(base, ("score", "double"), ("predicted", "int"), ("hits", "int")))

"""Paragraph vectors: a vector for each document, learned so that it tells the document's words from drawn ones.

Documents are dealt to parts. In a round each part goes over its own documents a few times with its own copy of the words' vectors, and behind the round
the copies are averaged by how often a part has a word. Documents' vectors stay in a table; the vectors of the vocabulary go through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import written

#: Documents of a part, about; rounds, and passes over the documents in each; words drawn for each that is there; first and last step.
PART, ROUNDS, PASSES, DRAWN, STEPS = 4000, 6, 10, 5, (0.2, 0.02)
#: Most words and words' vectors' numbers that are sent to the workers.
MOST_SENT = 20_000_000


def add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add rows to those of ``to``, several to one where their places are equal."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    to[at[first]] += np.add.reduceat(rows[order], first)


def trained(docs: list[np.ndarray], vectors: np.ndarray, words: np.ndarray, shares: np.ndarray, steps: np.ndarray, seed: list[int], batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of documents and words after a pass for each of ``steps``; ``docs`` are word numbers, ``shares`` the running sums of the chances to be drawn."""
    rng = np.random.default_rng(seed)
    doc, word = np.repeat(np.arange(len(docs)), [len(d) for d in docs]), np.concatenate([*docs, np.zeros(0, int)]).astype(int)
    vectors, words = vectors.copy(), words.copy()
    for step in steps:
        order = rng.permutation(len(doc))
        for i in range(0, len(order), batch):
            d, w = doc[order[i : i + batch]], word[order[i : i + batch]]
            drawn = np.minimum(np.searchsorted(shares, rng.random((len(w), DRAWN))), len(words) - 1)
            targets = np.concatenate([w[:, None], drawn], 1)
            own, other = vectors[d], words[targets]
            error = -1 / (1 + np.exp(-np.clip(np.matmul(other, own[..., None])[..., 0], -30, 30)))
            error[:, 0] += 1
            error[:, 1:] *= drawn != w[:, None]  # a word that is drawn against itself says nothing
            often = np.sqrt(np.bincount(targets.ravel(), minlength=len(words)))[targets]
            for_docs = step * np.matmul(error[:, None], other)[:, 0]
            for_words = ((step * error / often)[..., None] * own[:, None]).reshape(-1, own.shape[1])
            add_rows(vectors, d, for_docs)
            add_rows(words, targets.ravel(), for_words)
    return vectors, words


def paragraph_vectors(docs: DataFrame, words: Column, size: int, seed: int = 0, rounds: int = ROUNDS, part: int = PART) -> DataFrame:
    """(trace_id, features) of (trace_id, ...), ``words`` being an array of strings. Reruns agree, however the rows are dealt.

    A document without words keeps the vector that it starts with. An empty table gives none.
    """
    spark = docs.sparkSession
    table = written(docs.select("trace_id", words.alias("words")), "words")
    counts = sorted((r.w, r.n) for r in table.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).limit(MOST_SENT // size + 1).collect())
    if len(counts) * size > MOST_SENT:
        raise ValueError(f"more than {MOST_SENT // size} different words")
    number = {w: i for i, (w, _) in enumerate(counts)}
    chance = np.array([n for _, n in counts], float) ** 0.75
    shares = np.cumsum(chance) / max(chance.sum(), 1.0)
    vectors = np.random.default_rng([seed, 1]).random((len(counts), size)) - 0.5
    parts = max(1, -(-table.count() // part))
    start = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.pmod(F.xxhash64(F.lit(seed), "trace_id", i), F.lit(1 << 20)) / (1 << 20) - 0.5)
    state = table.select("trace_id", F.pmod(F.xxhash64("trace_id"), F.lit(parts)).cast("int").alias("part"), "words", start.alias("v"))
    steps = np.linspace(*STEPS, rounds * PASSES).reshape(rounds, PASSES)
    for i in range(rounds if counts else 0):
        dealt = state.repartition(parts, "part")  # not fewer tasks by size: a part's work is long, its rows are few
        state = written(dealt.groupBy("part").applyInPandas(_round(i, seed, number, vectors, shares, steps[i]), "trace_id long, part int, words array<string>, v array<double>, word int, n double"), "round")
        summed = state.where("word is not null").select("word", "n", F.posexplode("v").alias("i", "x")).groupBy("word", "i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"))
        for r in summed.collect():
            vectors[r.word, r.i] = r.x
        state = state.where("word is null").select("trace_id", "part", "words", "v")
    return state.select("trace_id", F.col("v").alias("features"))


def _round(i: int, seed: int, number: dict[str, int], vectors: np.ndarray, shares: np.ndarray, steps: np.ndarray):
    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("trace_id", ignore_index=True)
        docs = [np.array([number[w] for w in ws], int) for ws in pdf["words"]]
        own, words = trained(docs, np.stack(pdf["v"]), vectors, shares, steps, [seed, i, int(pdf["part"].iloc[0])])
        times = np.bincount(np.concatenate([*docs, np.zeros(0, int)]).astype(int), minlength=len(words))
        seen = np.flatnonzero(times).tolist()
        no_doc, no_word = [None] * len(seen), [None] * len(pdf)
        return pd.DataFrame(
            {
                "trace_id": pd.array(pdf["trace_id"].tolist() + no_doc, "Int64"),
                "part": int(pdf["part"].iloc[0]),
                "words": pdf["words"].tolist() + no_doc,
                "v": [*own, *words[seen]],
                "word": pd.array(no_word + seen, "Int32"),
                "n": pd.array(no_word + times[seen].tolist(), "Float64"),
            }
        )

    return run

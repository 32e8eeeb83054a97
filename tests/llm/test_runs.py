"""Runs and Lyndon arrays against their definitions, and what the operator makes of odd texts."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from optrail.llm.runs import collapsed, find_runs, lyndon_array, repeated, runs_in, runs_of


def plain_runs(s, least):
    n, out = len(s), []
    for p in range(1, n):
        i = 0
        while i + p < n:
            k = i
            while k + p < n and s[k] == s[k + p]:
                k += 1
            length = k - i + p
            if k > i and length >= max(least, 2 * p):
                w = s[i : i + length]
                if not any(w[q:] == w[:-q] for q in range(1, p)):
                    out.append((i, p, length))
            i = k + 1
    return sorted(out)


def periodic(draw, words):
    rng = random.Random(draw)
    n, k = rng.randrange(60), rng.choice(words)
    s = [rng.randrange(k) for _ in range(n)]
    if n > 6 and rng.random() < 0.6:
        a, p = rng.randrange(n // 2), rng.randrange(1, n // 3)
        s = s[:a] + (s[a : a + p] * n)[: n - a]
    return s


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**9))
def test_runs(draw):
    s = periodic(draw, (1, 2, 3, 8))
    for least in (4, 12):
        assert runs_of(s, least) == plain_runs(s, least)
        got = runs_in([[b"w%d" % x for x in s], [], [b"w0"] * 13], least)
        assert got == [plain_runs(s, least), [], [(0, 1, 13)]]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9))
def test_lyndon_array(draw):
    s = periodic(draw, (1, 2, 4))
    nxt, match = lyndon_array(s)
    for i in range(len(s)):
        j = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
        assert nxt[i] == j
        if j < len(s):
            assert match[i] == next((a for a in range(len(s) - j) if s[i + a] != s[j + a]), len(s) - j)


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**9), st.integers(2, 9))
def test_repeated_windows(draw, width):
    texts = [periodic(draw + i, (2, 3)) for i in range(4)]
    want = []
    for s in texts:
        windows = [tuple(s[i : i + width]) for i in range(len(s) - width + 1)]
        hit = [i for i, w in enumerate(windows) if windows.count(w) > 1]
        want += [any(i <= k < i + width for i in hit) for k in range(len(s))]
    names = np.array([x for s in texts for x in s], np.int64)
    assert repeated(names, np.repeat(np.arange(4), [len(s) for s in texts]), width).tolist() == want


def steps_of(s):
    """How often the comparisons of a Lyndon array look at a word."""

    class Word(int):
        looked = 0

        def __eq__(self, other):
            Word.looked += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    lyndon_array([Word(x) for x in s])
    return Word.looked


@pytest.mark.parametrize("kind", ["unary", "fibonacci", "thue_morse", "powers", "falling", "long_period"])
def test_comparisons_are_few(kind):
    """Linear on most families; a logarithm more on words like Fibonacci's, which repeat at a logarithmic number of distances."""
    n = 20_000
    fib = [[0], [0, 1]]
    while len(fib[-1]) < n:
        fib.append(fib[-1] + fib[-2])
    s = {
        "unary": lambda: [1] * n,
        "fibonacci": lambda: fib[-1][:n],
        "thue_morse": lambda: [i.bit_count() & 1 for i in range(n)],
        "powers": lambda: sum(([0] * k + [1] for k in range(199)), []),
        "falling": lambda: sum(([0] * k + [1] for k in range(199, 0, -1)), []),
        "long_period": lambda: [random.Random(3).choices(range(9), k=900)][0] * (n // 900),
    }[kind]()
    assert steps_of(s) <= (0.6 * math.log2(len(s)) if kind in ("fibonacci", "thue_morse") else 6) * len(s)


def test_collapsed():
    words = b"a b c a b c a b c a b c a d".split()
    runs = runs_in([words])[0]
    assert runs == [(0, 3, 13)] and collapsed(words, runs) == [b"a", b"b", b"c", b"d"]
    assert collapsed(words, []) == words


def test_documents(spark):
    line = "one two three four five six seven\n"
    rows = [(1, line * 4, 9), (2, None, 9), (3, "", 9), (4, " \t\n", 9), (None, "x " * 12, 9), (1, line * 4, 9), (5, "x " * 11, 9), (6, "É é " * 20, 9), (7, "a b " * 200_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = {(r.doc_id, r.n_words): r for r in find_runs(df.repartition(3)).collect()}
    assert len(got) == len(rows) - 1
    assert tuple(got[1, 28].runs[0]) == (0, 28, 7) and got[1, 28].text == line.strip()
    assert [got[k].runs for k in ((2, 0), (3, 0), (4, 0), (5, 11))] == [[]] * 4 and got[2, 0].text == ""
    assert tuple(got[None, 12].runs[0]) == (0, 12, 1) and got[None, 12].text == "x"
    assert got[6, 20].text == "É é"  # other white space parts no words
    assert tuple(got[7, 400_000].runs[0]) == (0, 400_000, 2) and got[7, 400_000].text == "a b"
    edited = find_runs(df.where("doc_id = 5"), edit=lambda k, ws: [*ws, str(k).encode()]).first()
    assert edited.n_words == 12 and edited.text.endswith("x 5")
    assert find_runs(df.where("doc_id = 77")).count() == 0
    with pytest.raises(ValueError):
        find_runs(df, least=3)

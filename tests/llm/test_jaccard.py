"""The similarity join against brute force over all pairs."""

import random

import numpy as np
import pytest

from optrail.llm import jaccard
from optrail.llm.hashing import shingle_sets
from optrail.llm.jaccard import join_near, links_among, prefix_size


def sets_of(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows, percent=80):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    low = {}
    for (k, _), r in zip(rows, root, strict=True):
        if k is not None:
            low[r] = min(k, low.get(r, k))
    return sorted(((k, len(s), low.get(r) if k is not None else None) for (k, _), s, r in zip(rows, sets, root, strict=True)), key=repr)


def make_rows(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base, passage, rows = text(120), text(40), []
    for i in range(160):
        words = list(base) if i < 70 else text(rng.randint(1, 90))
        if i < 70:  # near copies of one text, many of them not alike enough to each other
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = "edit%d" % rng.randrange(10**6)
        elif i < 110:
            words += passage
        rows.append((i * 3 + 1, " ".join(words)))
    for i in range(30):
        k, t = rows[rng.randrange(len(rows))]
        words = t.split()
        if i % 2 and len(words) > 8:
            words[rng.randrange(len(words))] = "other"
        rows.append((1000 + i, " ".join(words).upper() if i % 3 == 0 else "\n\t".join(words)))
    return [*rows, (2000, None), (2001, ""), (2002, " \n"), (2003, "one two"), (2004, "One  Two"), (2005, "one two three"), (None, rows[0][1]), (2006, "É é"), (2007, "é é"), (2003, "one two"), (2008, "long " * 30_000)]


@pytest.mark.parametrize("seed, block", [(1, 10_000), (2, 10_000), (3, 25)])
def test_components_equal_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rows = make_rows(seed)
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, n_shingles int").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in join_near(df).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark):
    assert join_near(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_among_joins_all_linked_sets():
    rng = random.Random(4)
    rows = make_rows(4)
    sets = [s for s in shingle_sets([t for _, t in rows if t]) if len(s)]
    root = np.arange(len(sets))
    links_among(sets, root, None, np.zeros(1 << jaccard.COUNT_BITS, np.uint8), 80)
    for _ in range(4000):
        i, j = rng.randrange(len(sets)), rng.randrange(len(sets))
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            assert root[i] == root[j]


def test_prefix_size_by_pigeonhole():
    for n in range(1, 200):
        assert n - prefix_size(n, 80) + 1 == -(-80 * n // 100)


def test_bits_that_differ_are_no_more_than_members_that_differ():
    rng = np.random.default_rng(5)
    for n in (1, 5, 60, 90, 400, 3000):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        sets = [s, s[: max(1, len(s) * 9 // 10)], s[len(s) // 2 :], np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))]
        size = np.array([len(x) for x in sets])
        bitmaps = jaccard.Bitmaps([jaccard.bitmap(x) for x in sets], size, 80)
        for i, j in ((0, 0), (0, 1), (0, 2), (0, 3), (1, 0)):
            both = len(np.intersect1d(sets[i], sets[j]))
            able = bool(bitmaps.alike(np.array([i]), np.array([j]))[0])
            assert able or 100 * both < 80 * (size[i] + size[j] - both)
            assert not (able and j == 3 and n >= 60)


@pytest.mark.parametrize("short", [64, 3])
def test_meetings_join_all_linked_sets(monkeypatch, short):
    monkeypatch.setattr(jaccard, "SHORT_RUN", short)
    monkeypatch.setattr(jaccard, "COMPARED_WORDS", 256)
    rng = np.random.default_rng(6)
    sets = [s for s in shingle_sets([t for _, t in make_rows(6) if t]) if len(s)]
    token = np.sort(rng.integers(0, 12, len(sets)))
    c = rng.integers(0, 40, len(sets))
    label = jaccard.meetings(token, c, jaccard.Bitmaps([jaccard.bitmap(s) for s in sets], np.array([len(s) for s in sets]), 80))
    linked = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if token[i] == token[j] and c[i] != c[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                linked += 1
                assert label[i] == label[j]
    assert linked > 100 and (token[label] == token).all()


def test_sets_that_share_a_rare_shingle_alone_do_not_meet(spark, monkeypatch):
    """A chain of texts, each with a rare passage of the next one, made one cluster of all of them."""
    met, plain = [], jaccard.wanted_texts
    monkeypatch.setattr(jaccard, "wanted_texts", lambda docs, named, width: met.append(named.count()) or plain(docs, named, width))
    passage = lambda name, n: [f"{name}w{j}" for j in range(n)]
    chain = [(i, " ".join(passage(f"link{i}", 5) + passage(f"a{i % 14}", 60) + passage(f"b{i % 15}", 60) + passage(f"link{i + 1}", 5))) for i in range(200)]
    near = [(1000 + i, chain[i][1] + " more") for i in range(3)]
    got = {r.doc_id: r.component_id for r in join_near(spark.createDataFrame(chain + near, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: i for i, _ in chain} | {1000 + i: i for i in range(3)}
    assert met == [6]

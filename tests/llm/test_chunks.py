"""Chunking, and removal of repeated passages against brute force over word windows."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from optrail.llm.chunks import chunk_ends, chunks_of, dedup_substrings, gear


def slow_gear(data):
    from optrail.llm.chunks import _GEAR

    h, out = 0, []
    for b in data:
        h = (2 * h + int(_GEAR[b])) & 0xFFFF
        out.append(h)
    return out


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400))
def test_gear_equals_the_recurrence(raw):
    assert gear(np.frombuffer(raw, np.uint8)).tolist() == slow_gear(raw)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=6))
def test_chunks_cover_texts(texts):
    found = {i: (e, d) for i, e, d in chunks_of(texts)}
    for i, t in enumerate(texts):
        if not t:
            assert i not in found
            continue
        ends, digests = found[i]
        assert ends[-1] == len(t) and (np.diff(ends, prepend=0) > 0).all() and len(digests) == len(ends)
        assert len({t[a:b]: 0 for a, b in zip([0, *ends], ends, strict=False)}) == len(set(digests.tolist()))


def test_insertion_moves_only_near_cuts():
    rng = random.Random(1)
    raw = bytes(rng.randrange(97, 123) for _ in range(20_000))
    before, after = set(chunk_ends(raw).tolist()), set((chunk_ends(raw[:5000] + b"new!" + raw[5000:]) - 4).tolist())
    far = lambda s: {x for x in s if x > 5100}
    assert far(before) == far(after)


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_repeats_go_and_clean_texts_stay(spark):
    rng = random.Random(9)
    passage = text_of(rng, 70)
    rows = []
    for i in range(120):
        words = text_of(rng, 150).split()
        if i % 3 == 0:
            words[50:50] = passage.split()
        rows.append((i, " ".join(words), "x", 1))
    rows += [(500, rows[5][1], "x", 1), (None, rows[5][1], "x", 1), (501, None, None, None), (502, "", "x", 1), (503, "short", "x", 1), (7, rows[7][1], "x", 1), (504, "é" * 100_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chunks int")
    got = dedup_substrings(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 7)}
    for i in range(120):
        if i == 7:
            continue
        if i % 3 or i == 0:
            assert by[i].text == rows[i][1] and by[i].removed_bytes == 0
        else:
            assert by[i].removed_bytes > 0.6 * len(passage) and 0 in by[i].copied_from
            assert set(by[i].text.split()) <= set(rows[i][1].split())
    assert by[500].text == "" and by[500].copied_from == [5]
    assert by[501].text is None and by[502].text == "" and by[503].text == "short"
    assert [r.text for r in got if r.doc_id is None] == [rows[5][1]]
    assert [r.text for r in got if r.doc_id == 7] == [rows[7][1]] * 2
    assert dedup_substrings(df.limit(0)).count() == 0


def test_common_chunks_of_different_documents_are_no_passage(spark):
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    pool = [words(400).encode() for _ in range(60)]
    pieces = []
    for t in pool:
        ends = chunk_ends(t)
        pieces.append(next(t[a:b] for a, b in zip(ends[3:], ends[4:], strict=False) if 16 < b - a < 100))
    joined = b"".join(pieces)
    rows = [(i, t.decode()) for i, t in enumerate(pool)] + [(100, joined.decode()), (101, joined.decode())]
    by = {r.doc_id: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by[100].removed_bytes == 0
    assert by[101].removed_bytes > 0.9 * len(joined) and by[101].copied_from == [100]

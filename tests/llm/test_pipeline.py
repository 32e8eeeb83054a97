"""Each stage of the pipeline against a brute-force version, on a small fixture and on the small table."""

import hashlib
import os
import random

import public_tokenizers as P
import pytest
import tiktoken
from test_jaccard import sets_of

import corpus_pipeline
from optrail.llm import jaccard
from optrail.llm.bpe import ranks_of

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8)))
    passage, rows, labels = [word() for _ in range(80)], [], []
    for i in range(150):
        words = [word() for _ in range(rng.randint(60, 140))]
        if i % 10 == 0:
            words[5:5] = [rng.choice(["clown", "moron"])]
            words += [rng.choice(["clown", "moron"]) for _ in range(3)]
        if i % 7 == 3:
            words[20:20] = passage
        rows.append((i, " ".join(words), "en", ["a", "b", None][i % 3], 0))
        labels.append((i, 1, int(i % 10 == 0)))
    rows += [(300 + i, rows[i][1] + " tail", "en", "c", 0) for i in range(1, 9)]
    rows += [(400, None, "en", "a", 0), (401, "", "en", "b", 0), (None, "no id here at all", "en", "a", 0), (402, rows[4][1], "en", "d", 0), (11, rows[11][1], "en", "c", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (name, f) in enumerate(corpus_pipeline.STAGES):
        before = docs
        f(spark, docs, folder).write.parquet(f"{folder}/out/{i}")
        docs = spark.read.parquet(f"{folder}/out/{i}")
        out.append((name, before, docs))
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_columns(stages):
    assert all(after.columns == before.columns for _, before, after in stages[:-1])


def test_toxic_documents_go(stages):
    _, before, after = stages[0]
    bad = lambda r: bool({"clown", "moron"} & set((r[1] or "").split()))
    assert rows_of(after) == [r for r in rows_of(before) if not bad(r)]


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    kept, want = [], []
    for r in sorted((r for r in rows_of(before) if r[0] is not None), key=lambda r: (r[0], r[3] is not None, r[3] or "")):
        s = sets_of(r[1])
        if not any((s and 100 * len(s & t) >= 80 * len(s | t)) or (r[:2] == q[:2]) for q, t in kept):
            kept.append((r, s))
            want.append(r)
    want += [r for r in rows_of(before) if r[0] is None]
    assert rows_of(after) == sorted(want, key=repr)


def test_no_passage_is_left_twice(stages):
    _, before, after = stages[2]
    seen = {}
    for r in after.collect():
        words = (r.text or "").split()
        for i in range(len(words) - 50):
            assert seen.setdefault(tuple(words[i : i + 51]), r.doc_id) == r.doc_id
    old = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == set(old)
    assert sum(r.text != old[r.doc_id] for r in after.collect()) < 30


def test_mix_takes_whole_documents_near_targets(stages):
    _, before, after = stages[3]
    size, total = lambda r: len((r[1] or "").split()), {}
    for r in before.collect():
        total[r.source] = total.get(r.source, 0) + size(r)
    weight, budget = {}, 1.5 * sum(total.values())
    for i, s in enumerate(sorted(total, key=lambda s: (s is None, s or ""))):
        weight[s] = (3, 1, 2)[i % 3]
    target, open_ = {}, set(total)
    while open_:  # fill by weight; sources that reach twice their size leave what they do not take
        left, weights = budget - sum(target.values()), sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / weights > 2 * total[s]}
        target |= {s: 2 * total[s] for s in full} if full else {s: left * weight[s] / weights for s in open_}
        open_ -= full or open_
    for s in total:
        own = [size(r) for r in before.collect() if r.source == s]
        assert abs(sum(size(r) for r in after.collect() if r.source == s) - target[s]) <= 2 * max(own)
    times = {}
    for r in rows_of(after):
        times[r] = times.get(r, 0) + 1
    assert max(times.values()) <= 2 and set(times) <= set(rows_of(before))


def test_encoding_is_that_of_the_mix(stages):
    _, before, after = stages[4]
    bpe = tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=ranks_of(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for r in before.collect():
        ids = bpe.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert rows_of(after) == sorted(want, key=repr)


def test_run_equals_the_stages(spark, folder, stages):
    assert rows_of(corpus_pipeline.run(spark, folder)) == rows_of(stages[-1][2])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_whole_table(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 500


def test_near_copies_alone_bring_their_texts_together(spark, monkeypatch):
    """Texts that lead to one another by chance made one cluster, whose texts were all sent."""
    met, plain = [], jaccard.wanted_texts
    monkeypatch.setattr(jaccard, "wanted_texts", lambda docs, named, width: met.append(named.count()) or plain(docs, named, width))
    passage = lambda name, n: [f"{name}w{j}" for j in range(n)]
    texts = [" ".join(passage(f"link{i}", 5) + passage(f"a{i % 14}", 60) + passage(f"b{i % 15}", 60) + passage(f"link{i + 1}", 5)) for i in range(200)]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate([*texts, texts[7] + " more"])]
    kept = corpus_pipeline.keep_one_of_near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), DATA)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(200))
    assert met == [2]

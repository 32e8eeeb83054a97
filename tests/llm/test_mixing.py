"""Base scores against a direct count, and the model's probabilities: proper, better than the base on unseen texts, repeatable."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from optrail.llm import mixing
from optrail.llm.mixing import Coder, Mixer, Tails, Words, earlier_in_text, head_inputs, head_logs, head_ready, learn_heads, score_texts, text_log, tokens_of


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 1


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    tongues = [["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(250)] for letters in ("abcdefg", "mnopqrs", "uvwxyzé")]
    out = []
    for i in range(900):
        words = rng.choices(tongues[i % 3], weights=[1 / (j + 1) for j in range(250)], k=rng.randint(0, 120))
        if i % 9 == 0:
            words += ["".join(rng.choice("abcdefg") for _ in range(8))]
        out.append((i, " ".join(words), "x"))
    return [*out, (2001, None, "x"), (2002, "", "x"), (2003, "É  Word\n\tword", "x"), (None, "no id", "x"), (5, out[5][1], "x"), (2004, "z" * 50_000, "x"), (2005, "many " * 20_000, "x")]


@pytest.fixture(scope="module")
def scored(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    return score_texts(df, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1).collect()


def test_base_scores(rows, scored):
    counts = collections.Counter()
    for k, t, _ in rows:
        if k is None or not held(k):
            counts.update(tokens_of(t))
    n, v, want = sum(counts.values()), len(counts), collections.Counter()
    for k, t, _ in rows:
        w = tokens_of(t)
        want[k, k is not None and held(k), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)] += 1
    assert want == collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)


def test_better_than_the_base_on_unseen_texts(scored):
    unseen = [r for r in scored if r.held_out and r.doc_id < 900]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in scored)


def test_reruns_agree_and_empty(spark, rows, scored):
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    again = score_texts(df, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 1).collect()
    key = lambda rs: sorted((repr(r.doc_id), r.n_tokens, round(r.score, 3)) for r in rs)
    assert key(again) == key(scored)
    assert score_texts(df.limit(0), F.lit(False)).count() == 0


@pytest.fixture(scope="module")
def coder():
    seen = np.zeros(256)
    seen[list(b"abcdefgh \n")] = [9, 8, 7, 6, 5, 4, 3, 2, 30, 5]
    return Coder(seen)


def test_decisions_spell_bytes(coder):
    """Every byte has a path of its own, and no path begins another."""
    paths = {}
    for b in range(256):
        paths[b] = tuple((int(n[0]), int(bit[0])) for _, n, bit in coder.decisions(np.array([b], np.uint8)))
    assert len(set(paths.values())) == 256
    assert abs(sum(2.0 ** -len(p) for p in paths.values()) - 1) < 1e-12
    assert len(paths[32]) < len(paths[200])


def trained_on(words, count, coder):
    tables, mixer = np.zeros((mixing.ORDERS, 2, 1 << mixing.TABLE_BITS), np.float32), mixing.tail_mixer()
    tails = Tails(words, count, 1, coder)
    tails.add_to(tables)
    tails.learn(tables, mixer)
    return tables, mixer


def test_probabilities_of_the_next_byte_add_up_to_one(coder):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))).encode() for _ in range(300)})
    count = np.random.default_rng(3).integers(1, 40, len(words))
    tables, mixer = trained_on(words, count, coder)
    odds = mixing.stretch(tables[:, 1], tables[:, 0], 0.4)
    # after "abcdef": the word's own counts are those of the words, and each probability is exp(log of longer - log of shorter)
    total = 0.0
    for b in range(256):
        if b == 32:
            ends = [*words, b"abcdef"]
            total += math.exp(first_after(ends, len(ends) - 1, 6, count, odds, mixer, coder))
        else:
            more = [*words, b"abcdef" + bytes([b])]
            total += math.exp(first_after(more, len(more) - 1, 6, count, odds, mixer, coder))
    assert abs(total - 1) < 1e-3


def first_after(words, at, place, count, odds, mixer, coder):
    """Logarithm of the probability of one byte of one word."""
    tails, own = Tails(words, np.append(count, 0), 1, coder), 0.0
    row = int(np.flatnonzero(tails.rows == tails.starts[at] + place)[0])
    for rows, node, bit in coder.decisions(tails.data):
        keep = rows == row
        if keep.any():
            x = np.empty((mixing.ORDERS + 2, 1), np.float32)
            for o in range(mixing.ORDERS):
                x[o] = odds[o][mixing.slot(tails.held[o][rows[keep]], node[keep])]
            x[mixing.ORDERS], gate = tails.deep_inputs(rows[keep], node[keep], bit[keep], 0.0)
            x[mixing.ORDERS + 1] = 0.3
            own -= float(mixing.log_loss(mixer.log_odds(x, gate), bit[keep])[0])
    return own


def test_counts_of_the_word_so_far_by_brute_force(coder):
    words, count = [b"abcdef", b"abcdxy", b"abcd", b"abzz", b"abcdefg" * 6], np.arange(1, 6)
    tails = Tails(words, count, 0, coder)
    spelled = [w + b" " for w in words]
    owner, place = np.repeat(np.arange(5), [len(w) for w in spelled])[tails.rows], np.concatenate([np.arange(len(w)) for w in spelled])[tails.rows]
    path = {r: () for r in range(len(tails.rows))}
    for rows, node, bit in coder.decisions(tails.data):
        at = mixing.slot(tails.so_far[rows], node, tails.bits)
        for r, n0, n1 in zip(rows.tolist(), tails.local[0][at], tails.local[1][at], strict=True):
            if place[r] >= mixing.PREFIX:
                same = {owner[q] for q in path if place[q] == place[r] and spelled[owner[q]][: place[q]] == spelled[owner[r]][: place[r]] and path[q][: len(path[r])] == path[r]}
                assert n0 + n1 == sum(count[w] for w in same)
        for r, b in zip(rows.tolist(), bit.tolist(), strict=True):
            path[r] = (*path[r], b)


def test_score_by_brute_force(coder):
    """The first bytes' logarithms, decision by decision in plain Python, and a text's probability as a plain mixture."""
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))).encode() for _ in range(60)}) + [b"\n"]
    at = np.array([rng.randrange(len(words)) for _ in range(3000)])
    tables, mixer, facts = np.zeros((mixing.HEADS, 2, 1 << mixing.TABLE_BITS), np.float32), mixing.head_mixer(), Words(words)
    begins = np.arange(0, 3000, 100)
    learn_heads(tables, mixer, coder, facts, at, begins, 2)
    assert tables[0].sum() == sum(coder.size[facts.first[at]])
    got = head_logs(head_ready(tables), mixer, coder, facts, at[:200], np.array([0, 100]), 2)
    held_contexts = facts.contexts(*facts.before(at[:200], np.array([0, 100])), 2)
    for i in range(0, 200, 7):
        byte, want = int(facts.first[at[i]]), 0.0
        for t in range(int(coder.size[byte])):
            node, bit = coder.node[t, byte], int(coder.bit[t, byte])
            x, gate, _ = head_inputs(tables, [c[i : i + 1] for c in held_contexts], np.array([0]), np.array([node]))
            z = sum(float(np.float32(w)) * float(v) for w, v in zip(mixer.weights[gate[0]], x[:, 0], strict=True))
            z = max(-11.99, min(11.99, z))
            low = int(z + 12)
            refined = mixer.refined[gate[0], low] * (1 - (z + 12 - low)) + mixer.refined[gate[0], low + 1] * (z + 12 - low)
            p = 1 / (1 + math.exp(-(z + refined) / 2))
            want += math.log(p if bit else 1 - p)
        assert abs(got[i] - want) < 1e-3
    log, text = np.log(np.random.default_rng(2).uniform(0.01, 0.5, 12)), np.array([1, 2, 1, 1, 3, 2, 2, 4, 1, 5, 5, 0])
    whole = 0.0
    for r in mixing.REPEAT:
        product = 1.0
        for i, t in enumerate(text):
            product *= (1 - r) * math.exp(log[i]) + r * (list(text[:i]).count(t) / max(i, 1))
        whole += product / len(mixing.REPEAT)
    assert abs(text_log(log, text) - math.log(whole)) < 1e-9


def test_earlier_in_text():
    assert earlier_in_text(np.array([3, 1, 3, 3, 1, 2])).tolist() == [0, 0, 1, 2, 1, 0]


def test_mixer_learns_online_and_tasks_unite():
    rng = np.random.default_rng(4)
    truth, parts, loss = np.array([1.2, 0.1, -0.4]), [], []
    for _ in range(3):
        mixer = Mixer(2, 3)
        for _ in range(30):
            x = rng.normal(size=(3, 400)).astype(np.float32)
            bit = (rng.random(400) < 1 / (1 + np.exp(-truth @ x))).astype(int)
            gate = rng.integers(0, 2, 400)
            loss.append(mixing.log_loss(mixer.mixed(x, gate), bit).mean())
            mixer.learn(x, gate, bit)
        parts.append(mixer)
    united = Mixer(2, 3)
    united.unite(sum(m.state() for m in parts))
    assert np.abs(united.weights - truth).max() < 0.15
    assert np.mean(loss[25:30]) < np.mean(loss[:1])
    assert np.allclose(united.weights, np.mean([m.weights for m in parts], 0), atol=0.1)


def test_every_training_token_moves_the_weights(spark, rows, monkeypatch):
    """The sum of the weights of all decisions of bytes after the first is that of the training text's bytes."""
    words, seen = collections.Counter(w for _, t, _ in rows for w in tokens_of(t)), []
    every = sorted(words)
    coder = Coder(np.bincount(np.frombuffer(b" ".join(every), np.uint8), minlength=256))
    learn = Mixer.learn
    monkeypatch.setattr(Mixer, "learn", lambda self, x, gate, bit, weight=None: (seen.append(float(weight.sum())), learn(self, x, gate, bit, weight)))
    trained_on(every, np.array([words[w] for w in every]), coder)
    assert sum(seen) == sum(n * int(coder.size[list(w[1:] + b" ")].sum()) for w, n in words.items())


def test_classes_are_means_of_all_texts(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(("abcd", "efgh", "ijkl", "mnop")[i % 4]) for _ in range(40)) for i in range(2600)]
    start = mixing.fit_classes(texts[:8])
    got, first, rest = mixing.refit_classes(spark.createDataFrame([(t,) for t in texts], "t string"), start.copy())
    x = np.stack([mixing.profile(t.encode()) for t in texts])
    own = np.argmax(x @ start.T, 1)
    want = np.stack([x[own == k].sum(0) / np.linalg.norm(x[own == k].sum(0)) for k in range(mixing.CLASSES)])
    assert np.allclose(got, want, atol=1e-4)
    assert (first + rest).sum() == sum(map(len, texts)) and first.sum() == len(texts) and (first + rest)[97] == sum(t.count("a") for t in texts)

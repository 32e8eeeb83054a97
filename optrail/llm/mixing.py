"""Language-model scoring by logistic context mixing: hashed-context bit predictors combined by gated weights.

A text is its words, bytes ended by a space each, and one end token. A byte is coded in binary decisions along a Huffman code
of bytes that begin words, or of those that stand behind one. Every decision is predicted by counted contexts, whose log-odds are mixed by weights that a gate
selects, and refined by a table over the mixed value; weights and table are learned online, batch by batch, over all training tokens.

The first byte of a token is predicted across the border: from the text's class, the last two and five bytes before, the word
before and the two words before. Its tables and its mixer learn in one pass: each batch of tokens is predicted by what the
task has counted so far, moves the weights, and is then counted. The bytes after it are predicted from one to six bytes before, as far as
the word reaches, and from the word so far, whose counts are kept for every word of the corpus; so they are worked out once
for a word of a class, and each training token is predicted from the counts of all others. Tasks' weights are united by their curvature.

A text's class, such as its language, is coded first, then its tokens. Within a text the model also adapts: its probability is the
mixture of coders that give a text's own earlier tokens more or less weight, and each token moves that mixture.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from zlib import compress, crc32, decompress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch_of, bounded_sample, give_back, lean, lean_group, lean_pair, materialize
from .hashing import SpanHash, mix

#: Latent classes of texts; so many training texts give the centres from which a round over all training texts starts.
CLASSES, CLASS_START = 4, 2000
#: Hashed contexts of each predictor: 2**TABLE_BITS counter pairs, of fixed size; the word so far has tables that grow with the vocabulary.
TABLE_BITS = 18
#: Contexts of a word's first byte, and of the bytes after it; the latter have the word so far besides.
HEADS, ORDERS = 5, 6
#: Words share counts of the word so far from this depth in bytes on, and are dealt to buckets by so many bytes.
PREFIX = 4
#: Bytes of texts whose words are indexed together, and tokens that are predicted before they are counted, at most.
GROUP_BYTES, HEAD_BATCH = 8 << 20, 1 << 16
#: Buckets of words at least; a bucket's words are worked on at once.
BUCKETS = 256
PARTS = 32
#: Weights of a text's own earlier tokens, among which the text's mixture moves.
REPEAT = np.array([0.001, 0.1, 0.4])
CONFIDENCE = np.array([0.5, 1.5, 3.5, 10.0, 100.0])
LEVELS = len(CONFIDENCE) + 1
END = b"\n"
#: Bytes that separate words.
GAP = np.isin(np.arange(256), [32, *range(9, 14)])

FACTS = (("kind", "int"), ("g", "long"), ("k", "long"), ("held", "boolean"), ("cls", "int"), ("size", "long"), ("bucket", "int"), ("words", "binary"), ("numbers", "binary"), ("places", "binary"))
VOCABULARY = (("bucket", "int"), ("words", "binary"), ("counts", "binary"), ("asked", "binary"), ("tokens", "long"), ("known", "long"))
SUMS, SUMS_DDL = (("part", "int"), ("sums", "binary")), "part int, sums binary"
SCORES = (("bucket", "int"), ("words", "binary"), ("counts", "binary"), ("logs", "binary"))
REPLIES = (("g", "long"), ("places", "binary"), ("words", "binary"), ("counts", "binary"), ("logs", "binary"))


def ddl(fields: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


def tokens_of(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


class Numbers(dict):
    """Words numbered as they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def profile(raw: bytes) -> np.ndarray:
    """Normalised histogram of hashed byte pairs."""
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    pairs = (data[:-1] * np.uint32(257) + data[1:]) * np.uint32(2654435761) >> np.uint32(23)
    h = np.bincount(pairs, minlength=512).astype(np.float32)
    return h / max(float(np.linalg.norm(h)), 1e-9)


def fit_classes(texts: list[str]) -> np.ndarray:
    """Centres of CLASSES groups of profiles: farthest-first start, then means on the sphere."""
    x = np.stack([profile(t.encode().lower()) for t in texts]) if texts else np.zeros((1, 512), np.float32)
    centre = [x[0]]
    while len(centre) < CLASSES:
        centre.append(x[int(np.argmin(np.max([x @ c for c in centre], 0)))])
    c = np.stack(centre)
    for _ in range(15):
        own = np.argmax(x @ c.T, 1)
        for i in range(CLASSES):
            if (own == i).any():
                mean = x[own == i].sum(0)
                c[i] = mean / max(float(np.linalg.norm(mean)), 1e-9)
    return c


def refit_classes(texts: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres after a round of means over all ``texts`` (t), and how often each byte begins a word of them and stands behind one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(centres.shape), np.zeros((2, 256))
        for batch in batches:
            for text in batch.column(0):
                raw = text.as_py().encode().lower()
                x = profile(raw)
                total[int(np.argmax(centres @ x))] += x
                data = np.frombuffer(raw, np.uint8)
                begins = np.append(True, GAP[data[:-1]])[: len(data)]
                every, first = np.bincount(data, minlength=256), np.bincount(data[begins], minlength=256)
                seen += np.stack([first, every - first])
        yield batch_of([(k, row.tobytes()) for k, row in enumerate([*total, *seen]) if row.any()], SUMS)

    out, seen = centres.copy(), np.zeros((2, 256))
    for r in summed(texts.mapInArrow(lean(run), SUMS_DDL)):
        if r.part >= CLASSES:
            seen[r.part - CLASSES] = np.frombuffer(bytes(r.sums))
        else:
            mean = np.frombuffer(bytes(r.sums))
            out[r.part] = mean / max(float(np.linalg.norm(mean)), 1e-9)
    return out, *seen


def summed(parts: DataFrame) -> list:
    """(part, sums) with the vectors of doubles of each part added up: as many rows as there are parts."""

    def both(table: pa.Table) -> pa.Table:
        vectors = sorted(x.as_py() for x in table.column("sums"))
        return pa.table({"part": table.column("part").slice(0, 1), "sums": pa.array([np.sum([np.frombuffer(x) for x in vectors], 0).tobytes()])})

    return parts.groupBy("part").applyInArrow(lean_group(both), SUMS_DDL).collect()


class Coder:
    """The binary decisions of bytes: a Huffman code of their frequencies, in which every byte has a place."""

    def __init__(self, seen: np.ndarray):
        heap = [(float(n) + 0.01, i, (i,)) for i, n in enumerate(seen)]
        heapq.heapify(heap)
        path: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        for node in range(255):
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for bit, side in enumerate((a, b)):
                for i in side[2]:
                    path[i].append((node, bit))
            heapq.heappush(heap, (a[0] + b[0], 256 + node, a[2] + b[2]))
        self.size = np.array([len(p) for p in path])
        self.node, self.bit = np.zeros((2, int(self.size.max()), 256), np.uint64)
        for i, p in enumerate(path):
            for t, (node, bit) in enumerate(reversed(p)):
                self.node[t, i], self.bit[t, i] = node + 1, bit

    def decisions(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, node, bit) level by level: every byte's decisions in coding order."""
        rows, size = np.arange(len(data)), self.size[data]
        for node, bit in zip(self.node, self.bit, strict=True):
            own = data if len(rows) == len(data) else data.take(rows)
            yield rows, node.take(own), bit.take(own)
            rows = rows[size[rows] > 1]
            size = size - 1
            if not len(rows):
                return


def flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the words, each ended by a space; starts; and every byte's place in its word."""
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return data, starts, np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))


def slot(context: np.ndarray, node: np.ndarray, bits: int = TABLE_BITS) -> np.ndarray:
    return (((context ^ (node * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)).view(np.int64)


def stretch(n1: np.ndarray, n0: np.ndarray, start: float) -> np.ndarray:
    return np.log((n1 + np.float32(start)) / (n0 + np.float32(start)))


def level_of(total: np.ndarray) -> np.ndarray:
    """How much a context has been seen, in LEVELS steps."""
    out = np.zeros(len(total), np.int8)
    for c in CONFIDENCE:
        out += total >= np.float32(c)
    return out


class Mixer:
    """Weights by gate, and a table that refines the mixed log-odds; both learn by online Newton steps."""

    STEPS = 24

    def __init__(self, gates: int, inputs: int):
        self.gates, self.n, self.tokens = gates, inputs, 0
        self.weights = np.full((gates, inputs), 1.0 / (inputs - 1))
        self.weights[:, -1] = 0
        self.curve = np.tile(np.eye(inputs), (gates, 1, 1))
        self.refined = np.tile(np.linspace(-12, 12, self.STEPS + 1), (gates, 1))
        self.seen = np.ones((gates, self.STEPS + 1))
        self.want, self.left = np.zeros((gates, inputs)), np.zeros((gates, self.STEPS + 1))

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gate), np.float32)
        for w, v in zip(np.ascontiguousarray(self.weights.T, np.float32), x, strict=True):
            out += w.take(gate) * v
        return np.clip(out, -11.99, 11.99)

    def knots(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = z + np.float32(12)
        low = at.astype(np.int64)
        return low, at - low.astype(np.float32)

    def log_odds(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = self.mixed(x, gate)
        low, part = self.knots(z)
        table, at = self.refined.ravel().astype(np.float32), gate * (self.STEPS + 1) + low
        return (z + table.take(at) * (1 - part) + table.take(at + 1) * part) / 2

    def learn(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Move the weights, then the table, by what these decisions (with weights) would have wanted."""
        self.gather(x, gate, bit, weight)
        self.step()

    def gather(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray | None = None) -> None:
        """Add up what these decisions want, without moving yet."""
        z, bit = self.mixed(x, gate), bit.astype(np.float32)
        guess = 1 / (1 + np.exp(-z))
        error, curve = bit - guess, guess * (1 - guess)
        low, part = self.knots(z)
        at, table = gate * (self.STEPS + 1) + low, self.refined.ravel().astype(np.float32)
        left = bit - 1 / (1 + np.exp(-(table.take(at) * (1 - part) + table.take(at + 1) * part)))
        if weight is not None:
            error, curve, left = error * weight, curve * weight, left * weight
        order = np.argsort(gate.astype(np.int8 if self.gates < 128 else np.int16), kind="stable")
        cuts = np.searchsorted(gate[order], np.arange(self.gates + 1))
        v, error, pull = x.take(order, 1), error.take(order), curve.take(order)
        for g in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[g], cuts[g + 1])
            self.curve[g] += (v[:, own] * pull[own]) @ v[:, own].T
            self.want[g] += v[:, own] @ error[own]
        size = self.refined.size
        grid = lambda x: (np.bincount(at, x * (1 - part), size) + np.bincount(at + 1, x * part, size)).reshape(self.seen.shape)
        self.seen += grid(curve)
        self.left += grid(left)

    def step(self) -> None:
        self.weights += np.clip(np.linalg.solve(self.curve, self.want[:, :, None])[:, :, 0], -0.5, 0.5)
        self.refined = np.clip(self.refined + np.clip(self.left / (self.seen + 4), -0.5, 0.5), -12, 12)
        self.want[:], self.left[:] = 0, 0

    def state(self) -> np.ndarray:
        """What tasks add up: curvature, curvature times weights, the table's curvature and that times the table."""
        pulled = np.einsum("gij,gj->gi", self.curve, self.weights)
        return np.concatenate([x.ravel() for x in (self.curve, pulled, self.seen, self.seen * self.refined)])

    def unite(self, total: np.ndarray) -> None:
        """Take the mean of tasks, weighed by curvature, from the sum of their states."""
        g, n, knots = self.gates, self.n, self.STEPS + 1
        curve, pulled, seen, table = np.split(total, np.cumsum([g * n * n, g * n, g * knots]))
        self.curve = curve.reshape(g, n, n)
        self.weights = np.linalg.solve(self.curve, pulled.reshape(g, n, 1))[:, :, 0]
        self.seen = seen.reshape(g, knots)
        self.refined = table.reshape(g, knots) / self.seen


def log_loss(z: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Minus the natural logarithm of the probability of the bits."""
    return np.log1p(np.exp(np.where(bit == 1, -z, z)))


class Words:
    """What the first byte of the token after each word is predicted from; the last row stands for a text's start."""

    def __init__(self, words: list[bytes]):
        data, starts, _ = flat(words)
        ends = np.append(starts[1:], len(data)) - 1
        self.first, self.length = data[starts], ends - starts
        self.whole = np.append(SpanHash(data).spans(starts, ends), np.uint64(0))
        tail = np.zeros(len(starts) + 1, np.uint64)
        for back in range(1, 6):
            tail[:-1] |= np.where(self.length >= back, data[np.maximum(ends - back, 0)], 0).astype(np.uint64) << np.uint64(8 * (back - 1))
        self.two, self.five = mix(tail & np.uint64(0xFFFF)), mix(tail + np.uint64(1 << 41))

    def before(self, at: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the word before each token of ``at`` and of the one before that; ``begins`` says where texts begin."""
        none = len(self.whole) - 1
        one = np.concatenate([[none], at[:-1]])
        one[begins] = none
        two = np.concatenate([[none], one[:-1]])
        two[begins] = none
        return one, two

    def contexts(self, one: np.ndarray, two: np.ndarray, cls: int) -> list[np.ndarray]:
        """Context hashes of tokens after the words ``one``, which stand after the words ``two``."""
        own = np.uint64((cls + 1) << 50)
        whole = self.whole[one]
        return [np.full(len(one), mix(np.array([own]))[0]), self.two[one] ^ own, self.five[one], whole, mix(whole + (self.whole[two] << np.uint64(1)) + np.uint64(7))]


def head_inputs(tables: np.ndarray, held: list[np.ndarray], rows: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Log-odds of the predictors of first bytes and a constant, gates, and the counters' places."""
    x, places, whole = np.empty((HEADS + 1, len(rows)), np.float32), [], len(rows) == len(held[0])
    gate = np.zeros(len(rows), np.int64)
    for o in range(HEADS):
        at = slot(held[o] if whole else held[o].take(rows), node)
        n0, n1 = tables[o, 0].take(at), tables[o, 1].take(at)
        x[o] = stretch(n1, n0, 0.4)
        if o >= HEADS - 2:
            gate = gate * LEVELS + level_of(n0 + n1)
        places.append(at)
    x[HEADS] = 0.3
    return x, gate, places


def learn_heads(tables: np.ndarray, mixer: Mixer, coder: Coder, words: Words, at: np.ndarray, begins: np.ndarray, cls: int) -> None:
    """Predict the first bytes of the tokens, batch by batch; move the weights; count the batch."""
    (one, two), first, a = words.before(at, begins), words.first[at], 0
    while a < len(at):
        b = a + max(1 << 11, min(HEAD_BATCH, mixer.tokens // 4))  # while little is counted, batches are small
        own, seen = words.contexts(one[a:b], two[a:b], cls), []
        for rows, node, bit in coder.decisions(first[a:b]):
            x, gate, places = head_inputs(tables, own, rows, node)
            mixer.gather(x, gate, bit)
            seen += [(o, p + (bit.astype(np.int64) << TABLE_BITS)) for o, p in enumerate(places)]
        mixer.step()
        for o, p in seen:
            np.add.at(tables[o].reshape(-1), p, np.float32(1))
        mixer.tokens += len(first[a:b])
        a = b


def head_logs(ready: np.ndarray, mixer: Mixer, coder: Coder, words: Words, at: np.ndarray, begins: np.ndarray, cls: int) -> np.ndarray:
    """Natural logarithms of the probability of each token's first byte; ``ready`` has the log-odds and the level of every slot."""
    (one, two), first, out = words.before(at, begins), words.first[at], np.zeros(len(at))
    odds, level = ready
    for a in range(0, len(at), HEAD_BATCH):
        own, done = words.contexts(one[a : a + HEAD_BATCH], two[a : a + HEAD_BATCH], cls), out[a : a + HEAD_BATCH]
        for rows, node, bit in coder.decisions(first[a : a + HEAD_BATCH]):
            x, gate, whole = np.empty((HEADS + 1, len(rows)), np.float32), np.zeros(len(rows), np.int64), len(rows) == len(done)
            for o in range(HEADS):
                p = slot(own[o] if whole else own[o].take(rows), node)
                x[o] = odds[o].take(p)
                if o >= HEADS - 2:
                    gate = gate * LEVELS + level[o - HEADS + 2].take(p)
            x[HEADS] = 0.3
            done[rows] -= log_loss(mixer.log_odds(x, gate), bit)
    return out


def head_ready(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``head_logs``: what ``head_inputs`` gives for every slot."""
    return stretch(tables[:, 1], tables[:, 0], 0.4), np.stack([level_of(t.sum(0)) for t in tables[HEADS - 2 :]])


def head_mixer() -> Mixer:
    return Mixer(LEVELS * LEVELS, HEADS + 1)


def tail_mixer() -> Mixer:
    return Mixer(LEVELS * (PREFIX + 1), ORDERS + 2)


def cut_table(kind: int, tables: np.ndarray) -> list[tuple]:
    """Rows (kind, part, counts) of a table of counters, in PARTS parts of its slots; empty ones are left out."""
    return [(kind * PARTS + i, compress(np.ascontiguousarray(x).tobytes(), 1)) for i, x in enumerate(np.split(tables, PARTS, axis=2)) if x.any()]


def united_table(parts: DataFrame, contexts: int) -> np.ndarray:
    """Counter pairs (context, bit, slot) from the parts (part, counts) of all tasks. The table has a fixed size."""

    def both(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(decompress(x.as_py()), np.float32) for x in table.column("counts")], axis=0, dtype=np.float32)
        return pa.table({"part": table.column("part").slice(0, 1), "counts": pa.array([compress(total.tobytes(), 1)])})

    width = (1 << TABLE_BITS) // PARTS
    tables = np.zeros((contexts, 2, 1 << TABLE_BITS), np.float32)
    for r in parts.groupBy("part").applyInArrow(lean_group(both), "part int, counts binary").collect():
        i = r.part % PARTS
        tables[:, :, i * width : (i + 1) * width] = np.frombuffer(decompress(bytes(r.counts)), np.float32).reshape(contexts, 2, width)
    return tables


def index_texts(docs: DataFrame, classes: np.ndarray, coder: Coder, buckets: int) -> DataFrame:
    """Kind 0: a row for each text with its class and its words by number; kind 1: numbered words of a group of texts of a
    class, dealt to buckets by their first bytes, with training counts; kinds 2 and 3: counters and mixer of first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() << 24
        held: list[list[tuple]] = [[] for _ in range(CLASSES)]
        size = [0] * CLASSES
        tables, mixer = np.zeros((HEADS, 2, 1 << TABLE_BITS), np.float32), head_mixer()

        def flush(c: int) -> pa.RecordBatch:
            nonlocal group
            number = Numbers()
            lists = [number.of([*raw.split(), END]) for _, _, raw in held[c]]
            used = [not h for _, h, _ in held[c]]
            words = list(number)
            training = [x for x, u in zip(lists, used, strict=True) if u]
            counts = np.bincount(np.concatenate(training), minlength=len(words)) if training else np.zeros(len(words), np.int64)
            facts_of = Words(words)
            if training:
                learn_heads(tables, mixer, coder, facts_of, np.concatenate(training), np.cumsum([0] + [len(x) for x in training[:-1]]), c)
            # frequent words first, so that high bytes of the numbers are mostly zero
            order = np.argsort(-np.bincount(np.concatenate(lists), minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            rows = []
            for (k, h, _), x in zip(held[c], lists, strict=True):
                planes = rank[x].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                rows.append((0, group, k, h, c, int((facts_of.length[x] + 1).sum()) - 1, None, None, compress(planes, 1), None))
            bucket = np.array([crc32(w[:PREFIX]) % buckets for w in words])
            by = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for b in range(buckets):
                own = by[cuts[b] : cuts[b + 1]]
                if len(own):
                    rows.append((1, group, None, None, c, None, b, b" ".join([words[i] for i in own]), compress(counts[own].astype("<u4").tobytes(), 1), rank[own].astype("<u4").tobytes()))
            held[c], size[c] = [], 0
            group += 1
            return batch_of(rows, FACTS)

        for batch in batches:
            for k, h, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw = (text.as_py() or "").encode().lower()
                c = int(np.argmax(classes @ profile(raw)))
                held[c].append((k.as_py(), h.as_py(), raw))
                size[c] += len(raw)
                if size[c] >= GROUP_BYTES or len(held[c]) >= 1 << 16:
                    yield flush(c)
                    give_back()
        for c in range(CLASSES):
            if held[c]:
                yield flush(c)
                give_back()
        yield batch_of([*((2, None, None, None, None, None, part, None, counts, None) for part, counts in cut_table(0, tables)), (3, None, None, None, None, None, 0, None, mixer.state().tobytes(), None)], FACTS)

    return materialize(docs.mapInArrow(lean(run), ddl(FACTS)), "lm-facts")


def unite_words(facts: DataFrame) -> DataFrame:
    """One row for each bucket: its words, their training counts by class, the classes that ask for them, and sums over them."""

    def run(table: pa.Table) -> pa.Table:
        number, seen = Numbers(), []
        for c, words, counts in zip(table.column("cls"), table.column("words"), table.column("numbers"), strict=True):
            at = number.of(words.as_py().split(b" "))
            seen.append((c.as_py(), at, np.frombuffer(decompress(counts.as_py()), "<u4")))
        total, asked = np.zeros((len(number), CLASSES), np.int64), np.zeros((len(number), CLASSES), bool)
        for c, at, counts in seen:
            total[at, c] += counts
            asked[at, c] = True
        return pa.Table.from_batches([batch_of([(table.column("bucket")[0].as_py(), b" ".join(number), total.tobytes(), asked.tobytes(), int(total.sum()), int((total.sum(1) > 0).sum()))], VOCABULARY)])

    rows = facts.where("kind = 1").select("bucket", "cls", "words", "numbers")
    return materialize(rows.groupBy("bucket").applyInArrow(lean_group(run), ddl(VOCABULARY)), "lm-vocabulary")


class Tails:
    """The bytes after the first of the words of a bucket that a class holds, their contexts, and counts of the word so far."""

    def __init__(self, words: list[bytes], count: np.ndarray, cls: int, coder: Coder):
        data, self.starts, place = flat(words)
        spread = np.repeat(count, np.diff(np.append(self.starts, len(data)))).astype(np.float32)
        self.rows = np.flatnonzero(place > 0)
        self.place, self.weight, self.total = np.minimum(place, PREFIX)[self.rows], spread[self.rows], len(data)
        self.data, self.coder, own = data[self.rows], coder, np.uint64((cls + 1) << 40)
        self.held, key = [], np.zeros(len(data), np.uint64)
        for n in range(1, ORDERS + 1):
            before = np.full(len(data), 32, np.uint64)
            before[n:] = data[:-n]
            key = (key << np.uint64(8)) | np.where(place >= n, before, 32)
            self.held.append((mix(key + np.uint64(n << 56)) ^ (own if n < 4 else np.uint64(0)))[self.rows])
        at = self.rows
        so_far = SpanHash(data).spans(at - place[at], at)
        deep = place[at] >= PREFIX
        self.so_far, self.deep = so_far, deep
        self.bits = max(16, (32 * int(deep.sum())).bit_length())  # few of some five decisions a byte share a slot
        self.local = np.zeros((2, 1 << self.bits), np.float32)
        for r, node, bit in coder.decisions(self.data):
            use = deep[r]
            np.add.at(self.local.reshape(-1), slot(so_far[r[use]], node[use], self.bits) + (bit[use].astype(np.int64) << self.bits), self.weight[r[use]])

    def deep_inputs(self, rows, node, bit, own: float) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds that the word so far gives, 0 where it is short, and gates; ``own`` occurrences are taken out."""
        use = self.deep[rows]
        x, total = np.zeros(len(rows), np.float32), np.zeros(len(rows), np.float32)
        at = slot(self.so_far[rows[use]], node[use], self.bits)
        n0, n1 = self.local[0][at], self.local[1][at]
        if own:
            n1, n0 = np.maximum(n1 - bit[use], 0), np.maximum(n0 - (1 - bit[use].astype(np.int64)), 0)
        x[use], total[use] = stretch(n1, n0, 0.2), n0 + n1
        return x, level_of(total).astype(np.int64) * (PREFIX + 1) + self.place[rows]

    def add_to(self, tables: np.ndarray) -> None:
        for rows, node, bit in self.coder.decisions(self.data):
            for o in range(ORDERS):
                np.add.at(tables[o].reshape(-1), slot(self.held[o][rows], node) + (bit.astype(np.int64) << TABLE_BITS), self.weight[rows])

    def learn(self, tables: np.ndarray, mixer: Mixer) -> None:
        """Every training token is predicted from the counts of all others; equal tokens are one weighted decision."""
        for rows, node, bit in self.coder.decisions(self.data):
            keep = self.weight[rows] > 0
            rows, node, bit = rows[keep], node[keep], bit[keep]
            if not len(rows):
                continue
            x, sign = np.empty((ORDERS + 2, len(rows)), np.float32), bit.astype(np.float32)
            for o in range(ORDERS):
                at = slot(self.held[o].take(rows), node)
                x[o] = stretch(np.maximum(tables[o, 1].take(at) - sign, 0), np.maximum(tables[o, 0].take(at) - (1 - sign), 0), 0.4)
            x[ORDERS], gate = self.deep_inputs(rows, node, bit, 1.0)
            x[ORDERS + 1] = 0.3
            mixer.learn(x, gate, bit, self.weight[rows])

    def logs(self, odds: np.ndarray, mixer: Mixer) -> np.ndarray:
        """Natural logarithms of each word's probability after its first byte; ``odds`` has those of every slot."""
        out = np.zeros(self.total)
        for rows, node, bit in self.coder.decisions(self.data):
            x, whole = np.empty((ORDERS + 2, len(rows)), np.float32), len(rows) == len(self.data)
            for o in range(ORDERS):
                x[o] = odds[o].take(slot(self.held[o] if whole else self.held[o].take(rows), node))
            x[ORDERS], gate = self.deep_inputs(rows, node, bit, 0.0)
            x[ORDERS + 1] = 0.3
            out[self.rows[rows]] -= log_loss(mixer.log_odds(x, gate), bit)
        return np.add.reduceat(out, self.starts)


def by_class(words: bytes, counts: bytes, asked: bytes, coder: Coder, only_counted: bool) -> Iterator[tuple[int, np.ndarray, Tails]]:
    """(class, numbers of its words, their tails) of a bucket."""
    every, count = words.split(b" "), np.frombuffer(counts, np.int64).reshape(-1, CLASSES)
    mask = np.frombuffer(asked, bool).reshape(-1, CLASSES)
    for k in range(CLASSES):
        own = np.flatnonzero(count[:, k] > 0 if only_counted else mask[:, k])
        if len(own):
            yield k, own, Tails([every[i] for i in own], count[own, k], k, coder)


def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in range(batch.num_columns))


def count_tails(vocabulary: DataFrame, coder: Coder) -> np.ndarray:
    """Counter pairs of the contexts of bytes after the first, over all training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((ORDERS, 2, 1 << TABLE_BITS), np.float32)
        for words, counts, asked in bucket_rows(batches):
            for _, _, tails in by_class(words, counts, asked, coder, True):
                tails.add_to(tables)
        yield batch_of(cut_table(0, tables), (("part", "int"), ("counts", "binary")))

    return united_table(vocabulary.select("words", "counts", "asked").mapInArrow(lean(run), "part int, counts binary"), ORDERS)


def fit_tails(vocabulary: DataFrame, tables, coder: Coder) -> Mixer:
    """The mixer of bytes after the first, learned online over all training tokens; what reaches the driver has the size of one state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = tail_mixer()
        for words, counts, asked in bucket_rows(batches):
            for _, _, tails in by_class(words, counts, asked, coder, True):
                tails.learn(tables.value, mixer)
        yield batch_of([(0, mixer.state().tobytes())], SUMS)

    mixer = tail_mixer()
    for r in summed(vocabulary.select("words", "counts", "asked").mapInArrow(lean(run), SUMS_DDL)):
        mixer.unite(np.frombuffer(bytes(r.sums)))
    return mixer


def score_words(vocabulary: DataFrame, tables, mixer, coder: Coder) -> DataFrame:
    """(SCORES): natural logarithms of every word's probability after its first byte, in the classes that ask for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, trained = stretch(tables.value[:, 1], tables.value[:, 0], 0.4), mixer.value
        for b, words, counts, asked in bucket_rows(batches):
            count = np.frombuffer(counts, np.int64).reshape(-1, CLASSES)
            logs = np.zeros(count.shape, "<f4")
            for k, own, tails in by_class(words, counts, asked, coder, False):
                logs[own, k] = tails.logs(odds, trained)
            yield batch_of([(b, words, count.sum(1).tobytes(), logs.tobytes())], SCORES)

    return materialize(vocabulary.select("bucket", "words", "counts", "asked").mapInArrow(lean(run), ddl(SCORES)), "lm-scores")


def earlier_in_text(at: np.ndarray) -> np.ndarray:
    """How often each token has occurred in its text before."""
    order = np.argsort(at, kind="stable")
    runs = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0]))
    nth = np.arange(len(at)) - np.repeat(runs, np.diff(np.append(runs, len(at))))
    out = np.empty(len(at), np.int64)
    out[order] = nth
    return out


def text_log(log: np.ndarray, at: np.ndarray) -> float:
    """Natural logarithm of a text's probability from those of its tokens: a mixture of coders that also give a text's earlier tokens a
    share, each of a weight in REPEAT. Every token moves the mixture towards the coders that foresaw it."""
    repeats = earlier_in_text(at) / np.maximum(np.arange(len(at)), 1)
    each = np.log(np.exp(log) * (1 - REPEAT[:, None]) + REPEAT[:, None] * repeats).sum(1)
    return float(np.logaddexp.reduce(each)) - math.log(len(REPEAT))


def score_texts(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    The model learns from rows where ``held_out`` is false (null counts as false). base_score is the sum of
    log10((c + 0.5) / (N + 0.5 * (V + 1))) over tokens; score is the mixed model's log10 probability of the text.
    Null text is empty and has the end token alone; rows with a null or a repeated key are scored like others;
    extra columns are ignored; an empty table gives none. A text is held whole in one task, with about GROUP_BYTES of others.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("t"))
    facts_of = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("t")).alias("size")).first()
    names = f"{key} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    if not facts_of.n:
        return spark.createDataFrame([], names)
    training = rows.where("not held and t is not null")
    sample = [r.t for r in bounded_sample(training.select("k", "t"), "k", facts_of.n, CLASS_START, "classes").collect()]
    classes, begin, follow = refit_classes(training.select("t"), fit_classes(sample))
    begin[GAP] = 0
    begin[END[0]], follow[32] = facts_of.n, follow[GAP].sum() + facts_of.n
    head_coder, coder = Coder(begin), Coder(follow)
    buckets = max(BUCKETS, (facts_of.size or 0) // (16 << 20))
    facts = index_texts(rows, classes, head_coder, buckets)
    vocabulary = unite_words(facts)
    sums = vocabulary.agg(F.sum("tokens").alias("tokens"), F.sum("known").alias("known")).first()
    tokens, distinct = sums.tokens, sums.known
    priors = {r.cls: r["count"] for r in facts.where("kind = 0 and not held").groupBy("cls").count().collect()}
    prior = np.log(np.array([priors.get(k, 0) + 1 for k in range(CLASSES)]) / (sum(priors.values()) + CLASSES))
    heads = head_mixer()
    for r in summed(facts.where("kind = 3").select(F.lit(0).alias("part"), F.col("numbers").alias("sums"))):
        heads.unite(np.frombuffer(bytes(r.sums)))
    first = spark.sparkContext.broadcast((united_table(facts.where("kind = 2").select(F.col("bucket").alias("part"), F.col("numbers").alias("counts")), HEADS), heads))
    tables = spark.sparkContext.broadcast(count_tails(vocabulary, coder))
    scores = score_words(vocabulary, tables, spark.sparkContext.broadcast(fit_tails(vocabulary, tables, coder)), coder)
    replies = answer(facts, scores)
    least = tokens + 0.5 * (distinct + 1)
    ready: list = []

    def finish(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not ready:
            ready.append(head_ready(first.value[0]))
        join = lambda c, kind: np.frombuffer(b"".join(x.as_py() for x in found.column(c)), kind)
        place, count, logs = join("places", "<u4"), join("counts", np.int64), join("logs", "<f4")
        words, c, log = np.empty(len(place), object), np.zeros(len(place), np.int64), np.zeros(len(place))
        words[place] = b" ".join(x.as_py() for x in found.column("words")).split(b" ")
        c[place], log[place] = count, logs
        base, facts_of, cls = np.log10((c + 0.5) / least), Words(words.tolist()), texts.column("cls")[0].as_py()
        lists = [np.ascontiguousarray(np.frombuffer(decompress(x.as_py()), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for x in texts.column("numbers")]
        begins = np.cumsum([0] + [len(x) for x in lists])
        every = np.concatenate(lists)
        each = head_logs(ready[0], first.value[1], head_coder, facts_of, every, begins[:-1], cls) + log[every]
        out = []
        for i, (k, h, size) in enumerate(zip(*(texts.column(x) for x in ("k", "held", "size")), strict=True)):
            at = lists[i]
            score = (float(prior[cls]) + text_log(each[begins[i] : begins[i + 1]], at)) / math.log(10)
            out.append((k.as_py(), h.as_py(), len(at), int((c[at] > 0).sum()), tokens, float(base[at].sum()), score, -score * math.log2(10) / max(1, size.as_py())))
        return pa.Table.from_batches([batch_of(out, tuple((n.split()[0], n.split()[1]) for n in names.split(", ")))])

    texts = facts.where("kind = 0").select("g", "k", "held", "cls", "size", "numbers")
    return texts.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(lean_pair(finish), names)


def answer(facts: DataFrame, scores: DataFrame) -> DataFrame:
    """(REPLIES): counts and logarithms of each group's words, looked up bucket by bucket."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        number = Numbers()
        number.of(known.column("words")[0].as_py().split(b" "))
        counts, logs = np.frombuffer(known.column("counts")[0].as_py(), np.int64), np.frombuffer(known.column("logs")[0].as_py(), "<f4").reshape(-1, CLASSES)
        out = []
        for g, c, words, places in zip(*(asked.column(x) for x in ("g", "cls", "words", "places")), strict=True):
            at = number.of(words.as_py().split(b" "))
            out.append((g.as_py(), places.as_py(), words.as_py(), counts[at].tobytes(), logs[at, c.as_py()].tobytes()))
        return pa.Table.from_batches([batch_of(out, REPLIES)])

    asked = facts.where("kind = 1").select("bucket", "g", "cls", "words", "places")
    return asked.groupBy("bucket").cogroup(scores.groupBy("bucket")).applyInArrow(lean_pair(run), ddl(REPLIES))

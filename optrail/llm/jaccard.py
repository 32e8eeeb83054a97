"""N-gram Jaccard join: rare-first prefix filtering with length, positional, bitmap and suffix filters."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, connected_components, lean, lean_group, materialize, slices
from .hashing import mix, shingle_sets

#: Shingles are counted in 2**COUNT_BITS classes by hash: the order by class count puts frequent ones last.
#: The table has this size whatever the input; any order gives the same pairs, a better one fewer candidates.
COUNT_BITS = 19
PARTS = 64
#: Bits of the filter of documents that some candidate pair names.
WANTED_BITS = 27
#: Runs of one prefix shingle up to this length are searched for pairs that pass the filters.
LONG_RUN = 2000
#: Members of a run up to this number are compared by bitmaps all at once, those of a longer one in turn.
SHORT_RUN = 64
#: 64-bit words of bitmaps that are compared at a time, roughly.
COMPARED_WORDS = 1 << 20
#: Sets of a cluster that one block holds at most, roughly; a task joins two blocks.
BLOCK_SETS = 4000
#: Clusters of several blocks are first joined within blocks, dealt anew each time; the last round joins every
#: two blocks of what is then still in different components.
ROUNDS = 4
GROUP_BYTES = 8 << 20

FACTS = (("kind", "int"), ("k", "long"), ("n", "int"), ("set_id", "long"), ("part", "int"), ("counts", "binary"), ("bits", "binary"))
PACKED = (("bucket", "int"), ("tokens", "binary"), ("sets", "binary"), ("sizes", "binary"), ("places", "binary"))
RUNS = (("token", "long"), ("set_id", "long"), ("n", "int"))


def set_id(s: np.ndarray) -> int:
    """64 bits of a set, whatever the order of its members."""
    return int(mix(np.array([np.add.reduce(mix(s)) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def prefix_size(n: int, percent: int) -> int:
    """Members in which two sets of that likeness must share one: all but ceil(percent * n / 100), plus one."""
    return n - -(-percent * n // 100) + 1


def needed(a, b, percent: int):
    """Least intersection for a likeness of ``percent``: 100 * i >= percent * (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the members in each of about as many classes as there are members, a power of two.

    A member that only one of two sets has changes one bit, so bits that differ are no more than members that differ.
    The halves' exclusive or is the bitmap over half as many classes, so bitmaps of two lengths can be compared.
    """
    size = 64
    while 4 * size < 3 * len(s):
        size *= 2
    return np.packbits((np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


def facts(docs: DataFrame, width: int) -> DataFrame:
    """Kind 0: a row for each document with its set's size, digest and bitmap; kind 1: parts of the count table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for part in slices([batch]):
                sets, rows = shingle_sets(part.column(1).to_pylist(), width), []
                for k, s in zip(part.column(0).to_pylist(), sets, strict=True):
                    rows.append((0, k, len(s), set_id(s), None, None, bitmap(s)))
                together = np.concatenate(sets)
                counts += np.bincount(together >> np.uint64(64 - COUNT_BITS), minlength=len(counts)).astype(np.uint32)
                yield batch_of(rows, FACTS)
        yield batch_of([(1, None, None, None, i, x.tobytes(), None) for i, x in enumerate(np.split(counts, PARTS)) if x.any()], FACTS)

    return materialize(docs.mapInArrow(lean(run), ", ".join(f"`{n}` {t}" for n, t in FACTS)), "facts")


def frequency_classes(facts_table: DataFrame) -> np.ndarray:
    """The count table in eighths of a power of two: one byte for each class."""

    def total(table: pa.Table) -> pa.Table:
        counts = np.add.reduce([np.frombuffer(x.as_py(), np.uint32).astype(np.uint64) for x in table.column("counts")])
        return pa.table({"part": table.column("part").slice(0, 1), "classes": pa.array([np.round(8 * np.log2(counts + 1.0)).clip(0, 255).astype(np.uint8).tobytes()])})

    got = {r.part: bytes(r.classes) for r in facts_table.where("kind = 1").select("part", "counts").groupBy("part").applyInArrow(lean_group(total), "part int, classes binary").collect()}
    return np.frombuffer(b"".join(got.get(i, bytes((1 << COUNT_BITS) // PARTS)) for i in range(PARTS)), np.uint8)


def rare_first(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """A set's members, those of rare classes first."""
    return s[np.lexsort((s, classes[s >> np.uint64(64 - COUNT_BITS)]))]


def shared_prefixes(docs: DataFrame, classes: Broadcast, width: int, percent: int, expected: int) -> DataFrame:
    """(token, set_id, n) of every prefix shingle that two different sets share; shingles that the same sets share are one token."""
    buckets = max(64, expected * 24 // GROUP_BYTES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(classes.value, np.uint8)
        for batch in batches:
            seen, tokens, ids, sizes = set(), [], [], []
            for a in range(0, batch.num_rows, 2000):
                for s in shingle_sets(batch.column(1).slice(a, 2000).to_pylist(), width):
                    i = set_id(s)
                    if len(s) and i not in seen:  # equal sets of a batch count once
                        seen.add(i)
                        p = rare_first(s, table)[: prefix_size(len(s), percent)]
                        tokens.append(p)
                        ids.append(i)
                        sizes.append(len(s))
            if not tokens:
                continue
            lengths = [len(t) for t in tokens]
            token = np.concatenate(tokens)
            owner, size = np.repeat(np.array(ids, np.int64), lengths), np.repeat(np.array(sizes, np.uint32), lengths)
            place = np.concatenate([np.arange(n, dtype=np.uint32) for n in lengths])
            bucket = mix(token) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            yield batch_of([(b, token[o].tobytes(), owner[o].tobytes(), size[o].tobytes(), place[o].tobytes()) for b, o in ((b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets)) if len(o)], PACKED)

    def unite(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)
        token, owner, size, place = join("tokens", np.uint64), join("sets", np.int64), join("sizes", np.uint32), join("places", np.uint32)
        order = np.lexsort((owner, token))
        token, owner, size, place = token[order], owner[order], size[order], place[order]
        same = token[1:] == token[:-1]
        fresh = np.concatenate([[True], ~(same & (owner[1:] == owner[:-1]))])  # a set found in two batches
        token, owner, size, place = token[fresh], owner[fresh], size[fresh], place[fresh]
        many = with_partner(token, size.astype(np.int64), place.astype(np.int64), percent)
        token, owner, size = token[many], owner[many], size[many]
        starts = starts_of(token)
        if len(token):
            alike = mix(np.add.reduceat(mix(owner.view(np.uint64)), starts))  # the same for the same sets
            token = np.repeat(alike, np.diff(np.append(starts, len(token))))
            once = np.lexsort((owner, token))
            once = once[np.concatenate([[True], (token[once][1:] != token[once][:-1]) | (owner[once][1:] != owner[once][:-1])])]
            token, owner, size = token[once], owner[once], size[once]
        return pa.table({"token": pa.array(token.view(np.int64)), "set_id": pa.array(owner), "n": pa.array(size.astype(np.int32))})

    found = docs.mapInArrow(lean(pack), ", ".join(f"{n} {t}" for n, t in PACKED)).groupBy("bucket").applyInArrow(lean_group(unite), ", ".join(f"{n} {t}" for n, t in RUNS))
    return materialize(found.distinct(), "runs")


def starts_of(token: np.ndarray) -> np.ndarray:
    """Where the runs of equal tokens begin."""
    return np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)


def with_partner(token: np.ndarray, size: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """Rows, sorted by token, that pass the length and positional filters with another row of their run.

    A linked pair passes at its first common shingle, so what is left still holds every linked pair. Runs too
    long to be looked at pair by pair are kept whole.
    """
    starts = starts_of(token)
    lengths = np.diff(np.append(starts, len(token)))
    good = np.zeros(len(token), bool)
    for n in np.unique(lengths[(lengths > 1) & (lengths <= 8)]):
        rows = starts[lengths == n][:, None] + np.arange(n)
        for i in range(n):
            for j in range(i):
                ok = may_link(size[rows[:, i]], place[rows[:, i]], size[rows[:, j]], place[rows[:, j]], percent)
                good[rows[ok, i]] = good[rows[ok, j]] = True
    for s, n in zip(starts[lengths > 8], lengths[lengths > 8], strict=True):
        own = slice(s, s + n)
        if n > LONG_RUN:
            good[own] = True
            continue
        ok = may_link(size[own][:, None], place[own][:, None], size[own][None], place[own][None], percent)
        np.fill_diagonal(ok, False)
        good[own] = ok.any(1)
    return good


def may_link(n, p, m, q, percent: int):
    """Length filter, and positional filter for a common member at places ``p`` and ``q`` that is the first."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(n - p, m - q) >= needed(n, m, percent))


class Bitmaps:
    """Bitmaps of rows, each in its own length and in those shorter ones in which rows that pass the length filter may have theirs."""

    def __init__(self, bits: list[bytes], size: np.ndarray, percent: int):
        self.size, self.percent, self.length = size, percent, np.array([len(b) for b in bits], np.int64)
        self.at, self.words = {}, {}
        for n in np.unique(self.length).tolist():
            rows = np.flatnonzero((self.length >= n) & (percent * self.length <= 200 * n))
            self.at[n] = np.zeros(len(bits), np.int64)
            self.at[n][rows] = np.arange(len(rows))
            self.words[n] = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[i], np.uint64).reshape(-1, n // 8), axis=0) for i in rows.tolist()])

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether rows ``x`` and ``y`` pass the length filter and differ in so few bits that they may be linked."""
        good, (n, m) = np.zeros(len(x), bool), (self.size[x], self.size[y])
        near = np.flatnonzero(100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))
        level, most = np.minimum(self.length[x[near]], self.length[y[near]]), (n + m - 2 * needed(n, m, self.percent))[near]
        for short in np.unique(level).tolist():
            words, at, step = self.words[short], self.at[short], max(1, COMPARED_WORDS * 8 // short)
            pairs, bound = near[level == short], most[level == short]
            for a in range(0, len(pairs), step):
                p = pairs[a : a + step]
                good[p] = np.bitwise_count(words[at[x[p]]] ^ words[at[y[p]]]).sum(1, dtype=np.int64) <= bound[a : a + step]
        return good


def meetings(token: np.ndarray, c: np.ndarray, bitmaps: Bitmaps) -> np.ndarray:
    """For rows sorted by token, the first of the rows to which pairs lead that have one token, differ in ``c`` and may be linked."""
    label, starts = np.arange(len(token)), starts_of(token)
    lengths = np.diff(np.append(starts, len(token)))
    for n in np.unique(lengths[(lengths > 1) & (lengths <= SHORT_RUN)]).tolist():
        i, j = np.triu_indices(n, 1)
        own, step = starts[lengths == n], max(1, COMPARED_WORDS // 8 // len(i))
        for a in range(0, len(own), step):
            x, y = ((own[a : a + step, None] + k).ravel() for k in (i, j))
            other = c[x] != c[y]
            x, y = x[other], y[other]
            good = bitmaps.alike(x, y)
            unite_labels(label, x[good], y[good])
    for s, n in zip(starts[lengths > SHORT_RUN].tolist(), lengths[lengths > SHORT_RUN].tolist(), strict=True):
        own = label[s : s + n]
        for i in range(1, n):
            for a, b in ((0, min(i, SHORT_RUN)), (SHORT_RUN, i)):  # what the first ones lead to is not compared again
                before = s + a + np.flatnonzero((own[a:b] != own[i]) & (c[s + a : s + b] != c[s + i]))
                for hit in np.unique(label[before[bitmaps.alike(before, np.full(len(before), s + i))]]).tolist():
                    low, high = min(hit, int(own[i])), max(hit, int(own[i]))
                    own[: i + 1][own[: i + 1] == high] = low
    return label


def unite_labels(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give all that pairs lead to one label, the smallest; labels are places, and those of ``x`` and ``y`` are their own before."""
    while (differ := label[x] != label[y]).any():
        low, high = np.minimum(label[x], label[y])[differ], np.maximum(label[x], label[y])[differ]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label[:] = label[label]


def clustered(runs: DataFrame, members: DataFrame | None, own: DataFrame, percent: int, seed: int) -> DataFrame:
    """(set_id, c, cluster, block, blocks): sets of runs that may be linked with a set of another component ``c``.

    Sets of a run are compared by bitmaps, so that those which share no more than a shingle do not meet, and what is
    linked already leaves nothing here. Clusters are components joined by such pairs; a large one is dealt at random to
    blocks of bounded size.
    """
    rows = runs.withColumn("c", F.col("set_id"))
    if members is not None:
        rows = runs.join(members, "set_id", "left").select("token", "set_id", "n", F.coalesce("component", "set_id").alias("c"))
        rows = rows.join(rows.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("token"), "token", "left_semi")
    rows = materialize(rows, "mixed") if members is not None else rows
    buckets = max(64, int(rows.select(F.sum(32 + F.col("n") / 5)).first()[0] or 0) // GROUP_BYTES)
    bits = own.join(rows.select("set_id").distinct(), "set_id", "left_semi").groupBy("set_id").agg(F.first("bits").alias("bits"))

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table.column("n").to_numpy(), table.column("token").to_numpy()))))
        token, ids, c, size = (table.column(name).to_numpy() for name in ("token", "set_id", "c", "n"))
        label = meetings(token, c, Bitmaps(table.column("bits").to_pylist(), size.astype(np.int64), percent))
        low = np.full(len(label), np.iinfo(np.int64).max)
        np.minimum.at(low, label, c)
        many = np.bincount(label, minlength=len(label))[label] > 1
        return pa.table({"set_id": pa.array(ids[many]), "c": pa.array(c[many]), "low": pa.array(low[label][many])})

    met = rows.join(bits, "set_id").withColumn("bucket", F.pmod("token", F.lit(buckets))).groupBy("bucket").applyInArrow(lean_group(run), "set_id long, c long, low long")
    left = materialize(met.distinct(), "unsettled")
    clusters = connected_components(left.where("c <> low").select("c", "low").distinct(), "c", "low")
    sets = left.select("set_id", "c").distinct().join(clusters.select(F.col("node").alias("c"), F.col("component").alias("cluster")), "c")
    sizes = sets.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("blocks"))
    return materialize(sets.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "set_id"), F.col("blocks")).cast("int")), "clusters")


def join_blocks(sets: DataFrame, texts: DataFrame, classes: Broadcast, width: int, percent: int, every: bool) -> DataFrame:
    """Links between components of clustered sets: each block in itself, or ``every`` two blocks of a cluster."""
    groups = max(64, sets.count() // BLOCK_SETS)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if every else F.col("block")
    dealt = (
        sets.withColumn("other", other)
        .select("set_id", "c", "block", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "cluster")
        .withColumn("meeting", F.xxhash64("cluster", "a", "b"))
        .withColumn("task", F.pmod("meeting", F.lit(groups)))
        .join(texts, "set_id")
    )

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.lexsort((table.column("set_id").to_numpy(), table.column("meeting").to_numpy()))))
        meeting, ids, root, block, a, b = (table.column(c).to_numpy().copy() for c in ("meeting", "set_id", "c", "block", "a", "b"))
        borders = np.flatnonzero(np.concatenate([[True], meeting[1:] != meeting[:-1], [True]]))
        found, order = [], np.frombuffer(classes.value, np.uint8)
        for s, e in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
            members = shingle_sets([zlib.decompress(x.as_py()).decode() for x in table.column("packed").slice(s, e - s)], width)
            found += [(int(ids[s + i]), int(ids[s + j])) for i, j in links_among(members, root[s:e], block[s:e] if a[s] != b[s] else None, order, percent)]
        return pa.Table.from_batches([batch_of(found, (("x", "long"), ("y", "long")))])

    return dealt.groupBy("task").applyInArrow(lean_group(run), "x long, y long")


def links_among(sets: list[np.ndarray], root: np.ndarray, block: np.ndarray | None, classes: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that join all linked sets of different roots: an inverted index of the prefixes, a count of
    shared prefix members that bounds the intersection, and no comparison within a root."""
    sizes = np.array([len(s) for s in sets])
    prefixes = [rare_first(s, classes)[: prefix_size(len(s), percent)] for s in sets]
    rest = sizes - np.array([len(p) for p in prefixes])
    token, owner = np.concatenate(prefixes), np.repeat(np.arange(len(sets)), [len(p) for p in prefixes])
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    found = []
    for i, prefix in enumerate(prefixes):
        starts, stops = np.searchsorted(token, prefix), np.searchsorted(token, prefix, "right")
        near = np.concatenate([owner[a:b] for a, b in zip(starts, stops, strict=True)])
        shared = np.bincount(near, minlength=len(sets))[:i]
        able = (shared >= np.maximum(1, needed(sizes[:i], sizes[i], percent) - np.maximum(rest[:i], rest[i]))) & (root[:i] != root[i])
        able &= 100 * np.minimum(sizes[:i], sizes[i]) >= percent * np.maximum(sizes[:i], sizes[i])
        if block is not None:
            able &= block[:i] != block[i]
        candidates = np.flatnonzero(able)
        for j in candidates[np.argsort(-shared[candidates], kind="stable")]:
            if root[j] == root[i]:
                continue
            least = needed(int(sizes[i]), int(sizes[j]), percent)
            if may_reach(sets[i], sets[j], least) and len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= least:
                found.append((i, int(j)))
                root[root == root[j]] = root[i]
    return found


def may_reach(a: np.ndarray, b: np.ndarray, least: int, depth: int = 3) -> bool:
    """Suffix filter: split both sorted sets at a member and bound what the halves can share."""

    def bound(a: np.ndarray, b: np.ndarray, depth: int) -> int:
        if not depth or len(a) < 8 or len(b) < 8:
            return min(len(a), len(b))
        pivot = b[len(b) // 2]
        i, j = int(np.searchsorted(a, pivot)), len(b) // 2
        return bound(a[:i], b[:j], depth - 1) + bound(a[i:], b[j:], depth - 1)

    return bound(a, b, depth) >= least


def wanted_texts(docs: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """(set_id, packed) of the sets in ``named`` (set_id, each once), found through a filter of fixed size."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << WANTED_BITS >> 3, np.uint8)
        for batch in batches:
            at = mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - WANTED_BITS)
            np.bitwise_or.at(seen, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
        for i, x in enumerate(np.split(seen, PARTS)):
            if x.any():
                yield batch_of([(i, zlib.compress(x.tobytes(), 1))], (("part", "int"), ("bits", "binary")))

    def both(table: pa.Table) -> pa.Table:
        merged = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in table.column("bits")])
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([zlib.compress(merged.tobytes(), 1)])})

    size = (1 << WANTED_BITS >> 3) // PARTS
    got = {r.part: zlib.decompress(bytes(r.bits)) for r in named.select("set_id").mapInArrow(lean(mark), "part int, bits binary").groupBy("part").applyInArrow(lean_group(both), "part int, bits binary").collect()}
    bitmap = docs.sparkSession.sparkContext.broadcast(b"".join(got.get(i, bytes(size)) for i in range(PARTS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            known = set()
            for a in range(0, batch.num_rows, 1000):
                texts = batch.column(1).slice(a, 1000).to_pylist()
                rows = []
                for t, s in zip(texts, shingle_sets(texts, width), strict=True):
                    i = set_id(s)
                    at = int(mix(np.array([i], np.int64).view(np.uint64))[0]) >> (64 - WANTED_BITS)
                    if len(s) and i not in known and seen[at >> 3] >> (at & 7) & 1:
                        known.add(i)
                        rows.append((i, zlib.compress(t.encode(), 4)))
                yield batch_of(rows, (("set_id", "long"), ("packed", "binary")))

    found = docs.mapInArrow(lean(run), "set_id long, packed binary").join(named, "set_id", "left_semi")
    return materialize(found.groupBy("set_id").agg(F.first("packed").alias("packed")), "texts")


def join_near(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of every row: components of texts whose sets of word shingles are alike.

    A text's words, A-Z in lower case, make the set of its distinct shingles of ``width`` words; fewer
    words make one shingle of all. Texts link if 100 * intersection >= ``percent`` * union. Equal sets are
    one set; sets meet on the rarest shingles of each, of which a linked pair must share one where it passes the
    length and positional filters, if bitmaps of the whole sets do not differ too much for a link. Sets that meet form clusters; a task joins a cluster, or two blocks of a large
    one, over an index of prefixes, comparing a pair once and none within a component.

    Null and empty texts have no shingles, link with nothing and keep their own key as component; a null
    key takes no part and gets a null component; rows with one key are told apart by their sets, and the
    component is the smallest key of any row; an empty table gives none. Other columns are ignored. Sets are known by 64-bit digests.
    """
    spark = docs.sparkSession
    usable = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    seen = facts(usable, width)
    own = seen.where("kind = 0").select("k", "n", "set_id", "bits")
    classes = spark.sparkContext.broadcast(frequency_classes(seen).tobytes())
    expected = own.select(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    with_key = usable.where("k is not null and t is not null")
    runs = shared_prefixes(with_key, classes, width, percent, int(expected))
    members = links = None
    for nth in range(ROUNDS):
        last = nth == ROUNDS - 1
        sets = clustered(runs, members, own, percent, nth)
        new = join_blocks(sets, wanted_texts(with_key, sets, width), classes, width, percent, every=last)
        links = materialize(new if links is None else links.union(new), "links")
        members = connected_components(links, "x", "y").select(F.col("node").alias("set_id"), "component")
        large = sets.where("blocks > 1").select("set_id")
        if last or large.isEmpty():
            break
        runs = materialize(runs.join(large, "set_id", "left_semi"), "runs")
    grouped = own.where("k is not null and n > 0").join(members, "set_id", "left").select("k", "n", "set_id", F.coalesce("component", "set_id").alias("c"))
    lowest = grouped.groupBy("c").agg(F.min("k").alias("component_id"))
    linked = grouped.join(lowest, "c").select("k", "n", "component_id")
    alone = own.where("k is null or n = 0").select("k", "n", F.col("k").alias("component_id"))
    return linked.union(alone).select(F.col("k").alias(key), F.col("n").cast("long").alias("n_shingles"), "component_id")

"""Quality rules: plain counts of a text, and bands of perplexity under a modified Kneser-Ney model of its language.

The model is one of bytes inside words: a word is read from the blank before it to the blank behind it, and each byte is
predicted from up to ORDER - 1 before it, no further than the blank. Such n-grams are counted once for each distinct word of a batch, by its
number, so a pass over the corpus sends few of them; Spark adds them up, and makes the counts of shorter ones, discounts and
probabilities as tables. For scoring, probabilities and back-off weights lie in arrays sorted by the hash of their n-gram.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, give_back, lean, materialize, slices
from .hashing import mix
from .runs import repeated

#: Longest n-gram, in bytes, and the blank that stands at both ends of a word.
ORDER, BLANK = 5, 32
#: Most n-grams that a model may have to be sent to all workers, some 12 bytes each; a larger one is joined with the words of the texts.
MOST_SENT = 4_000_000
#: Bytes of distinct words that a worker keeps while it counts or scores, and bytes of text that it looks at together.
KEPT, PART = 16 << 20, 2 << 20
#: Bands: as many deviations below and above the median of the language's texts.
BELOW, ABOVE = 5.0, 5.0
#: Steps of the decimal logarithm of the perplexity in which texts are counted to find a language's median and deviation.
STEPS = 1000

COUNTS = (("lang", "string"), ("gram", "bigint"), ("c", "bigint"))
FEATURES = (("n_words", "bigint"), ("word_chars", "bigint"), ("n_symbols", "bigint"), ("n_dup_lines", "bigint"), ("n_repeat_words", "bigint"))
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"


def words_in(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or b"").lower().split()


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The longest n-gram of every byte of the words and of the blank behind each, and where each word's begin.

    An n-gram is a number: its bytes, the last one lowest, and its order above them.
    """
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    blanks = np.flatnonzero(data == BLANK)
    sizes = np.diff(blanks)  # bytes of a word and the blank behind it
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    place = np.arange(1, len(data)) - np.repeat(blanks[:-1], sizes)  # of a byte in its word, from 1
    gram, at = data[1:].copy(), np.arange(1, len(data))
    for back in range(1, ORDER):
        gram += np.where(place >= back, data[np.maximum(at - back, 0)] << (8 * back), 0)
    return gram | (np.minimum(place + 1, ORDER) << 40), starts


def order_of(gram: Column) -> Column:
    return F.shiftright(gram, 40)


def bytes_of(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit((1 << 40) - 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}
    size = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for lang, counter in held.items():
            words = list(counter)
            if not words:
                continue
            grams, starts = grams_of(words)
            times = np.repeat(np.fromiter(counter.values(), np.int64, len(words)), np.diff(np.append(starts, len(grams))))
            order = np.argsort(grams, kind="stable")
            grams, times = grams[order], times[order]
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            sums = np.add.reduceat(times, first)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), pa.array(grams[first]), pa.array(sums)], names=[n for n, _ in COUNTS])

    for batch in slices(batches, PART):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            counter = held.setdefault(lang, Counter())
            before = len(counter)
            words = words_in(text)
            counter.update(words)
            size += (len(counter) - before) * (len(text or b"") // max(1, len(words)) + 1)
        if size > KEPT:
            yield from counted()
            held, size = {}, 0
            give_back()
    yield from counted()


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, c): how often each longest n-gram occurs in the words of a language's texts."""
    counted = docs.select(language(), "text").mapInArrow(lean(_count), ", ".join(f"{n} {t}" for n, t in COUNTS))
    return counted.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def language() -> Column:
    """The language of a text; null is one with the empty name."""
    return F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")


def kneser_ney(top: DataFrame) -> DataFrame:
    """(lang, gram, p, backoff) of (lang, gram, c): the interpolated probability of each n-gram's last byte, and the weight of the shorter
    context where its own is not followed by a byte. Either may be null: a context need not be an n-gram that is predicted.

    Counts of the longest n-grams and of those that begin with a blank are how often they occur, of others how many different bytes stand before them. Discounts follow
    Chen and Goodman, by language and order, or are 0.5, 1 and 1.5 where numbers of counts do not give them. No window holds more than the 256 bytes
    that may follow a context, or the orders of a language.
    """
    top = materialize(top, "grams")
    levels = {ORDER: top.where(order_of(F.col("gram")) == ORDER)}
    for k in range(ORDER - 1, 0, -1):
        shorter = bytes_of(F.col("gram")).bitwiseAND(F.lit((1 << 8 * k) - 1)).bitwiseOR(F.lit(k << 40))
        continued = levels[k + 1].groupBy("lang", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        levels[k] = materialize(continued.union(top.where(order_of(F.col("gram")) == k)), "level")
    out, lower = None, None
    for k in range(1, ORDER + 1):
        own = levels[k].withColumn("context", F.shiftright(bytes_of(F.col("gram")), 8).bitwiseOR(F.lit((k - 1) << 40)))
        n = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)]
        some = lambda x: F.nullif(x, F.lit(0))
        y = F.col("n1") / some(F.col("n1") + 2 * F.col("n2"))
        ds = [F.lit(i) - (i + 1) * y * F.col(f"n{i + 1}") / some(F.col(f"n{i}")) for i in (1, 2, 3)]
        fit = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
        fit = fit & (ds[0] > 0) & (ds[1] > 0) & (ds[2] > 0)
        discounts = own.groupBy("lang").agg(*n).select("lang", *(F.when(fit, d).otherwise(F.lit(0.5 * i)).alias(f"d{i}") for i, d in enumerate(ds, 1)))
        by = Window.partitionBy("lang", "context")
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = own.join(discounts, "lang").withColumn("d", d)
        rows = rows.withColumn("total", F.sum("c").over(by)).withColumn("rest", F.sum("d").over(by) / F.col("total"))
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            shorter = bytes_of(F.col("gram")).bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).bitwiseOR(F.lit((k - 1) << 40))
            rows = rows.withColumn("shorter", shorter).join(lower.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below")), ["lang", "shorter"])
        rows = materialize(rows.select("lang", "gram", "context", ((F.col("c") - F.col("d")) / F.col("total") + F.col("rest") * F.col("below")).alias("p"), "rest"), "probabilities")
        lower = rows
        part = rows.select("lang", "gram", "p", F.lit(None).cast("double").alias("backoff")).union(rows.select("lang", F.col("context").alias("gram"), F.lit(None), F.col("rest").alias("backoff")).distinct())
        out = part if out is None else out.union(part)
    return out.groupBy("lang", "gram").agg(F.max("p").alias("p"), F.max("backoff").alias("backoff"))


def salt_of(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little"))


@dataclass
class Model:
    """Decimal logarithms of probabilities and back-off weights in arrays sorted by hash; NaN where there is none."""

    keys: np.ndarray
    p: np.ndarray
    backoff: np.ndarray

    @classmethod
    def of(cls, table: DataFrame) -> Model:
        """The arrays of a table (lang, gram, p, backoff): hashes are made by the workers, 16 bytes an n-gram reach the driver."""
        rows = table.mapInArrow(lean(_hashed), "key bigint, p float, backoff float").toArrow()
        keys = rows["key"].to_numpy().view(np.uint64)
        order = np.argsort(keys)
        return cls(keys[order], *(rows[c].to_numpy()[order].astype(np.float32) for c in ("p", "backoff")))

    def find(self, salt: np.uint64, grams: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(grams), np.nan)
        wanted = mix(grams.astype(np.uint64) ^ salt)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, values[at].astype(float), np.nan)

    def score(self, lang: str, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word, with the blank behind it. An n-gram that the model does not have costs its context's weight and counts as the shorter one."""
        grams, starts = grams_of(words)
        salt, out = salt_of(lang), np.zeros(len(grams))
        left = np.arange(len(grams))
        while len(left):
            g = grams[left]
            k, low = g >> 40, g & ((1 << 40) - 1)
            found = self.find(salt, g, self.p)
            hit = ~np.isnan(found)
            out[left[hit]] += found[hit]
            left, k, low = left[~hit], k[~hit], low[~hit]
            out[left] += np.nan_to_num(self.find(salt, (low >> 8) | ((k - 1) << 40), self.backoff))
            done = k == 1
            out[left[done]] += np.log10(1 / 256)
            left, k, low = left[~done], k[~done] - 1, low[~done]
            grams[left] = (low & ((np.int64(1) << (8 * k)) - 1)) | (k << 40)
        return np.add.reduceat(out, starts) if len(starts) else out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).unique().to_pylist()
        salts = np.array([salt_of(x) for x in names], np.uint64)
        where = pc.index_in(batch.column(0), pa.array(names, pa.string())).to_numpy(zero_copy_only=False).astype(int)
        keys = mix(batch.column(1).to_numpy().astype(np.uint64) ^ salts[where])
        logs = [np.log10(batch.column(i).to_numpy(zero_copy_only=False).astype(float)).astype(np.float32) for i in (2, 3)]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(x) for x in logs)], names=["key", "p", "backoff"])


def features(texts: list[bytes]) -> list[tuple[int, ...]]:
    """FEATURES of each text."""
    numbers: dict[bytes, int] = {}
    listed = [t.split() for t in texts]
    names = np.array([numbers.setdefault(w, len(numbers)) for ws in listed for w in ws], np.int64)
    sizes = np.array([len(ws) for ws in listed], np.int64)
    mask = repeated(names, np.repeat(np.arange(len(texts)), sizes), 8)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.concatenate([[0], np.cumsum(mask)])
    again = (sums[ends[1:]] - sums[ends[:-1]]).tolist()
    out = []
    for t, ws, n in zip(texts, listed, again, strict=True):
        lines = [x for x in t.split(b"\n") if x.strip()]
        chars = len(t.decode()) - (len(t) - len(t.translate(None, SPACES)))
        out.append((len(ws), chars, len(t) - len(t.translate(None, SYMBOLS)), len(lines) - len(set(lines)), n))
    return out


def _score(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    fields = (("lang", "string"), ("doc_id", "bigint"), *FEATURES, *((("n_bytes", "bigint"), ("score", "double")) if sent else ()))
    known: dict[str, dict[bytes, float]] = {}
    size = 0
    for batch in slices(batches, PART):
        langs, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
        rows = list(zip(langs, ids, *zip(*features(texts), strict=True), strict=True))
        if sent:
            if size > KEPT:
                known, size = {}, 0
            model = sent.value
            listed = [words_in(t) for t in texts]
            fresh: dict[str, dict[bytes, None]] = {}
            for lang, ws in zip(langs, listed, strict=True):
                old = known.setdefault(lang, {})
                fresh.setdefault(lang, {}).update(dict.fromkeys(w for w in ws if w not in old))
            for lang, ws in fresh.items():
                new = list(ws)
                if new:
                    known[lang].update(zip(new, model.score(lang, new).tolist(), strict=True))
                    size += sum(map(len, new)) + len(new)
            rows = [(*r, sum(map(len, ws)) + len(ws), sum(map(known[lang].__getitem__, ws))) for r, lang, ws in zip(rows, langs, listed, strict=True)]
        yield batch_of(rows, fields)
        del texts, rows
        give_back()


def score_words(words: DataFrame, model: DataFrame) -> DataFrame:
    """(lang, word, score) of distinct (lang, word), whatever the size of the model: n-grams meet it in a join. Words are binary; a word's n-grams
    that the model lacks go through the join again as shorter ones, ORDER times at most."""
    left = words.mapInArrow(_explode, "lang string, word binary, place int, gram bigint")
    table = model.select("lang", "gram", F.log10("p").alias("lp"), F.log10("backoff").alias("lb"))
    out = None
    for k in range(ORDER, 0, -1):
        here = left.where(order_of(F.col("gram")) == k)
        context = F.shiftright(bytes_of(F.col("gram")), 8).bitwiseOR(F.lit((k - 1) << 40))
        met = here.join(table.where("lp is not null").select("lang", "gram", "lp"), ["lang", "gram"], "left")
        met = met.withColumn("context", context).join(table.where("lb is not null").select("lang", F.col("gram").alias("context"), "lb"), ["lang", "context"], "left")
        met = materialize(met, "met")
        last = F.when(F.lit(k == 1), F.lit(float(np.log10(1 / 256)))).otherwise(F.lit(0.0))
        own = met.select("lang", "word", F.coalesce("lp", F.coalesce("lb", F.lit(0.0)) + last).alias("x"))
        out = own if out is None else out.union(own)
        shorter = bytes_of(F.col("gram")).bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).bitwiseOR(F.lit((k - 1) << 40))
        left = left.where(order_of(F.col("gram")) < k).union(met.where("lp is null").select("lang", "word", "place", shorter.alias("gram")))
    return out.groupBy("lang", "word").agg(F.sum("x").alias("score"))


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, PART):
        langs, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if not words:
            continue
        grams, starts = grams_of(words)
        sizes = np.diff(np.append(starts, len(grams)))
        which = np.repeat(np.arange(len(words)), sizes)
        columns = [pa.array(langs, pa.string()).take(pa.array(which)), pa.array(words, pa.binary()).take(pa.array(which)), pa.array((np.arange(len(grams)) - np.repeat(starts, sizes)).astype(np.int32)), pa.array(grams)]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "place", "gram"])


def _list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, PART):
        rows = [(k, lang, w, n) for k, lang, t in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2).cast(pa.binary()).to_pylist(), strict=True) for w, n in Counter(words_in(t)).items()]
        yield batch_of(rows, (("row", "bigint"), ("lang", "string"), ("word", "binary"), ("n", "bigint")))


def bands(scored: DataFrame, below: float, above: float) -> DataFrame:
    """(lang, low, high) of (lang, level, base_failed): the median level of a language's texts that pass the plain rules, less and plus so many deviations.

    The deviation is 1.4826 times the median distance from the median. Both come from counts of levels in steps of 1 / STEPS, of which
    a language has some thousands, so no task holds all texts of a language.
    """
    def middle(values: DataFrame) -> DataFrame:
        counts = values.groupBy("lang", "v").agg(F.count(F.lit(1)).alias("n"))
        whole = Window.partitionBy("lang")
        reached = counts.withColumn("reached", F.sum("n").over(whole.orderBy("v"))).withColumn("all", F.sum("n").over(whole))
        return reached.where(F.col("reached") * 2 >= F.col("all")).groupBy("lang").agg(F.min("v").alias("m"))

    steps = scored.where("not base_failed and level is not null").select("lang", F.floor(F.col("level") * STEPS).alias("v"))
    median = middle(steps)
    spread = middle(steps.join(median, "lang").select("lang", F.abs(F.col("v") - F.col("m")).alias("v"))).withColumnRenamed("m", "d")
    width = F.greatest(F.col("d"), F.lit(1)) * 1.4826
    return median.join(spread, "lang").select("lang", ((F.col("m") - width * below) / STEPS).alias("low"), ((F.col("m") + 1 + width * above) / STEPS).alias("high"))


def judge(docs: DataFrame, below: float = BELOW, above: float = ABOVE, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, lang, FEATURES, level, base_failed, kept) for each row of ``docs`` (doc_id, lang, text).

    A text fails the plain rules with fewer than 20 words, or where 100 times the words in repeated windows of 8 words are more than 30 times its words. One that
    passes is kept if its level, the decimal logarithm of its perplexity by byte under the model of its language, lies in that language's band. The
    model is counted over all texts, the bands over all that pass. Null texts count as empty, with a null level; null languages as one of their
    own; repeated rows are judged alike and count each; an empty table gives none. Other columns are ignored.

    A model of at most ``most_sent`` n-grams is sent to the workers; a larger one meets the texts' distinct words in joins.
    """
    spark = docs.sparkSession
    own = docs.select(language(), F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = materialize(kneser_ney(count_grams(own)), "model")
    types = ", ".join(f"{n} {t}" for n, t in (("lang", "string"), ("doc_id", "bigint"), *FEATURES))
    if model.count() <= most_sent:
        sent = spark.sparkContext.broadcast(Model.of(model))
        scored = own.mapInArrow(lean(partial(_score, sent=sent)), f"{types}, n_bytes bigint, score double")
    else:
        numbered = materialize(own.withColumn("row", F.monotonically_increasing_id()), "numbered")
        listed = materialize(numbered.select("row", "lang", "text").mapInArrow(lean(_list_words), "row bigint, lang string, word binary, n bigint"), "words")
        words = score_words(listed.select("lang", "word").distinct(), model)
        sums = listed.join(words, ["lang", "word"]).groupBy("row").agg(F.sum(F.col("n") * (F.length("word") + 1)).alias("n_bytes"), F.sum(F.col("n") * F.col("score")).alias("score"))
        plain = numbered.select("lang", F.col("row").alias("doc_id"), "text").mapInArrow(lean(partial(_score, sent=None)), types).withColumnRenamed("doc_id", "row")
        scored = plain.join(numbered.select("row", "doc_id"), "row").join(sums, "row", "left").drop("row")
    level = F.when(F.col("n_words") > 0, -F.col("score") / F.col("n_bytes"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = materialize(scored.withColumn("level", level).withColumn("base_failed", failed).drop("n_bytes", "score"), "scored")
    limits = scored.join(bands(scored, below, above), "lang", "left")
    inside = F.coalesce((F.col("level") >= F.col("low")) & (F.col("level") <= F.col("high")), F.lit(False))
    return limits.withColumn("kept", ~F.col("base_failed") & inside)

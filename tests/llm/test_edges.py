"""Every operator and every stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from optrail.llm.bpe import decode_ids, encode_texts
from optrail.llm.caps import link_near
from optrail.llm.chunks import dedup_substrings
from optrail.llm.html import extract_main_text
from optrail.llm.jaccard import join_near
from optrail.llm.mih import search
from optrail.llm.mix import in_mix_order, mix_sources
from optrail.llm.mixing import score_texts
from optrail.llm.toxicity import Lexicon, Matcher, learn_lexicon, score_toxicity, uncovered
from optrail.llm.warc import read_archives, round_trip, write_archives

PATH = P.path("byte_bpe_multi_50k.tiktoken")
#: Names that operators add or use, in other letters, beside those of the table.
CLASHES = ["Score", "IDS", "N_Tokens", "_K", "_Mark", "_copies", "_Finish", "Removed_Bytes", "Spans", "held_OUT", "finish", "taken", "MARK", "draw", "slice", "size", "Component_id", "n", "set_id", "id", "of", "t", "m", "_nth", "Predicted", "hits", "decoded"]


def long_text(rng, size):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    out = []
    while size > 0:
        out.append(rng.choice(words))
        size -= len(out[-1]) + 1
    return " ".join(out)


def document_rows():
    rng = random.Random(2)
    same = "the same words stand in several rows of this table and tie with each other"
    rows = [(1, None, "en", "a", 1), (2, "", "en", "a", 0), (3, " \n\t", None, None, 3), (None, same, "en", "b", 5), (None, same, "en", "b", 5), (4, same, "en", None, 5), (4, same, "en", None, 5), (4, same + " but longer", "en", "b", 5), (5, same, "en", "b", None)]
    rows += [(6, long_text(rng, 5_000_000), "en", "a", 5_000_000), (7, "x" * 60_000, "de", "c", 60_000), (8, "a\x0bb\x0c\u2003c \U0001f600", "", "", 9), (-1, "negative", "en", "a", 8)]
    return rows + [(10 + i, long_text(rng, 300), "en", "abc"[i % 3], 300) for i in range(20)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
OPERATORS = {
    "op2": lambda d: dedup_substrings(d),
    "op3": lambda d: mix_sources(d),
    "op3_order": lambda d: in_mix_order(d, mix_sources(d)),
    "op4": lambda d: score_toxicity(d, Lexicon({"words": 3.0}, ("same words",))),
    "op5": lambda d: score_texts(d, F.col("doc_id") == 7),
    "op6": lambda d: decode_ids(encode_texts(d, PATH, P.PATTERN), PATH, P.PATTERN),
    "op10": lambda d: join_near(d),
}
#: Rows that come back, if not all.
ROWS = {"op3_order": None}


def table(spark, rows, clashing):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.select("*", *(F.lit("z").alias(c) for c in CLASHES)) if clashing else df


@pytest.mark.parametrize("clashing", [False, True])
@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents(spark, name, clashing):
    rows = document_rows()
    got = OPERATORS[name](table(spark, rows, clashing))
    found = got.collect()
    if name in ROWS:
        assert 0 < len(found) <= 2 * len(rows)
    else:
        assert len(found) == len(rows)
        assert sorted(repr(r.doc_id) for r in found) == sorted(repr(r[0]) for r in rows)
    names = [c.lower() for c in got.columns]
    assert len(names) == len(set(names))


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_documents(spark, name):
    df = spark.createDataFrame([], SCHEMA)
    assert OPERATORS[name](df).count() == 0
    assert OPERATORS[name](df.select("*", *(F.lit("z").alias(c) for c in CLASHES))).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_only_nulls(spark, name):
    rows = [(1, None, None, None, None), (None, None, None, None, None), (1, None, None, None, None)]
    found = OPERATORS[name](table(spark, rows, False)).count()
    assert found == (0 if name in ROWS else 3)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("clashing", [False, True])
def test_vectors(spark, clashing):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 0.0], 1), (5, [float("nan"), 1.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (6, [1.0, 0.0, 0.0], None), (7, [1.0, 0.0, 0.0], 1), (7, [1.0, 0.0, 0.0], 1), (8, [2.0, 0.0, 0.0], 1), (100, [0.0, 1.0, 0.0], 2), (200, [1.0, 0.1, 0.0], 1), (9, [1.0] * 1500, 1)]
    df = spark.createDataFrame(rows, VECTORS)
    if clashing:
        df = df.select("*", *(F.lit(1).alias(c) for c in ("Rank", "SCORE", "id", "h", "raw", "query", "N_links", "g", "Kept", "size")))
    near = search(df, F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r.vec_id) for r in sorted(near, key=lambda r: (r.query_id, r.rank))] == [(100, 200), (100, 6), (100, 7), (100, 8), (200, 6), (200, 7), (200, 8), (200, 100)]
    links = {(r.vec_id, r.n_links, r.component_id) for r in link_near(df).collect()}
    assert {(7, 3, 7), (8, 3, 7), (200, 3, 7), (6, 0, 6), (None, 0, None), (9, 0, 9)} <= links
    assert search(df.limit(0), F.col("vec_id") % 100 == 0).count() == link_near(df.limit(0)).count() == 0


PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("clashing", [False, True])
def test_pages(spark, clashing):
    long_page = "<article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(100_000)) + "</article>"
    rows = [(1, None, None), (2, "u", ""), (None, "u", "<p>no key</p>"), (3, "u", long_page), (4, "u\r\nv", "<p>same</p>"), (4, "u", "<p>same</p>"), (5, "u", "<p>same</p>")]
    df = spark.createDataFrame(rows, PAGES).repartition(2)
    if clashing:
        df = df.select("*", *(F.lit(1).alias(c) for c in ("Text", "N_CHARS", "_digest", "_Refers", "k", "u", "p", "_first", "Digest")))
    texts = sorted((r.page_id or 0, r.n_chars) for r in extract_main_text(df).collect())
    assert texts[0][0] == 0 and texts[1:3] == [(1, 0), (2, 0)] and texts[3][1] > 2_000_000 and texts[4:] == [(4, 4), (4, 4), (5, 4)]
    back = sorted(((r.key or 0, r.record_type, r.refers_to) for r in round_trip(df).collect()), key=repr)
    assert back == sorted([(0, "response", None), (1, "response", None), (2, "revisit", 1), (3, "response", None), (4, "response", None), (4, "response", None), (5, "revisit", 4)], key=repr)
    assert extract_main_text(df.limit(0)).count() == round_trip(df.limit(0)).count() == 0


def test_selected_records_are_read_alone(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50) for i in range(300)], PAGES).repartition(3)
    index = write_archives(df, f"file://{tmp_path}/warc")
    got = read_archives(index.where("record_key % 10 = 0").union(index.where("record_key = 20")), f"file://{tmp_path}/warc").collect()
    assert sorted((r.key, bytes(r.payload).decode()) for r in got) == [(i, f"<p>{i}</p>" * 50) for i in range(0, 300, 10)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(10, 1, 1), (11, 0, 0), (None, 1, 1), (12, None, None), (10, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("rows", ["all", "none", "clashing"])
@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, folder, name, rows):
    df = table(spark, document_rows(), rows == "clashing")
    out = dict(corpus_pipeline.STAGES)[name](spark, df.limit(0) if rows == "none" else df, folder)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == df.columns
        if rows == "clashing":  # the table's own columns keep their values
            assert {tuple(r[len(SCHEMA.split(", ")) :]) for r in out.collect()} == {("z",) * len(CLASHES)}
    n = out.count()
    assert n == 0 if rows == "none" else n > 0


def test_voided_terms_by_brute_force_and_in_linear_time():
    rng = random.Random(1)
    for _ in range(200):
        spans = [(a, a + rng.randint(0, 6), 1.0) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 12)))]
        voided = [(a, a + rng.randint(0, 9)) for a in (rng.randint(0, 40) for _ in range(rng.randint(0, 6)))]
        assert uncovered(list(spans), list(voided)) == sorted(s for s in spans if not any(x <= s[0] and s[1] <= y for x, y in voided))
    matcher = Matcher(Lexicon({"moron": 2.0}, ("moron said",)))
    assert matcher.score("moron said moron " * 200_000)[1] == 200_000


def test_nothing_to_learn_from(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    assert learn_lexicon(docs, labels).terms == {}
    assert learn_lexicon(spark.createDataFrame(document_rows()[:5], SCHEMA), labels).terms == {}

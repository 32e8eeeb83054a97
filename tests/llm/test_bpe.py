"""Tree reduction against the tokenizer's own encoding of the whole text."""

import base64
import hashlib
import os

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from optrail.llm.bpe import TreeBpe, decode_ids, encode_texts, load, ranks_of

DATA = "/root/testdata/sf0.01"
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def whole():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = st.one_of(st.text(max_size=12), st.sampled_from(["'re", "'ll", "  ", "\n\n ", " \t", "aaaa", "the", " 12", "!!", "é", "日本", "𝄞", "'", "xyz" * 20, " " * 30]))


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=40).map("".join), st.integers(1, 17))
def test_same_ids_as_whole(whole, text, leaf):
    bpe = TreeBpe(ranks_of(PATH), P.PATTERN, leaf, 1 + leaf % 5)
    ids = bpe.encode(text)
    assert ids == whole.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_short_text_goes_through_joins(whole):
    bpe = TreeBpe(ranks_of(PATH), P.PATTERN)
    text = "unbelievable counterrevolutionary words and flibbertigibbets make a text of just one hundred characters"[:100]
    assert bpe.encode(text) == whole.encode_ordinary(text) and bpe.joins >= 3


def test_every_character_is_matched_as_by_the_library(whole):
    bpe = load(PATH, P.PATTERN)
    for c in [*range(0x3000), *range(0x3000, 0xD800, 37), *range(0xE000, 0x20000, 13)]:
        text = f"a{chr(c)}'re {chr(c)}9"
        assert bpe.encode(text) == whole.encode_ordinary(text)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_all_documents(spark, whole):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    out = {r.doc_id: r for r in encode_texts(docs, PATH, P.PATTERN, outputs=("n_tokens", "ids", "decoded_sha256", "ids_sha256")).collect()}
    for d in docs.collect():
        r, ids = out[d.doc_id], whole.encode_ordinary(d.text or "")
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, bytes(r.ids), r.ids_sha256) == (len(ids), raw, hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


@pytest.mark.parametrize("text", ["", "a" * 30_000, " " * 20_000, "ab'" * 9000, "word " * 5000, "x\n" * 9000, "日本語" * 5000, "0123456789" * 3000])
def test_long_texts(whole, text):
    assert load(PATH, P.PATTERN).encode(text) == whole.encode_ordinary(text)


def test_frame_with_nulls_and_extra_columns(spark, whole):
    rows = [(1, "Hello world", "x"), (2, None, None), (None, "", "y"), (1, "Hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = decode_ids(encode_texts(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens, bytes(r.decoded)) for r in out if r.doc_id) == [(False, 1, 2, b"Hello world")] * 2 + [(False, 2, 0, b"")]
    assert encode_texts(df.limit(0), PATH, P.PATTERN).count() == 0

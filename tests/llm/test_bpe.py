import hashlib
import struct

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import bpe
from strandloom.llm.text import Texts

CASES = ["", "Hello world", "don't we'll they've 's 'S ''s 's's !'s a 's", "  two  spaces \n\n\nx \t y ", " ", "\n", "x ", "é à  b 12३ ٣x", "'", "''", "'r", "'re", "'l", "a'll'd've", "　x", "emoji 😀😀 !!", "'\n's", "a" * 300, "ab" * 5000, " '", " 't", "x\n 't", "_'t", "1'm"]


@pytest.fixture(scope="module")
def coder():
    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(texts):
    t = Texts.of(pa.array(texts, pa.string()))
    at, stop, doc = bpe.boundaries(t)
    out = [[] for _ in texts]
    for a, b, d in zip(at, stop, doc, strict=True):
        out[d].append(t.data[a:b].tobytes().decode())
    return out


def test_slices_are_the_matches():
    assert pieces(CASES) == [regex.findall(P.PATTERN, c) for c in CASES]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="a'stmdrevl \n\t 　1!é.", max_size=14), max_size=4))
def test_slices_are_the_matches_for_any_text(texts):
    assert pieces(texts) == [regex.findall(P.PATTERN, c) for c in texts]


def test_round_trip(spark, coder):
    rows = [(i, c) for i, c in enumerate(CASES)] + [(100, None), (0, CASES[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as bytes")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, bpe.ranks_path()).collect()}
    want = set()
    for i, c in rows:
        ids = coder.encode_ordinary(c or "")
        want.add((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((c or "").encode()).hexdigest()))
    assert got == want


def test_offsets_and_decoding(spark, coder):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    tokens = bpe.encode(docs, bpe.ranks_path())
    for r in tokens.collect():
        ids = coder.encode_ordinary(CASES[r.doc_id])
        assert r.ids == ids
        assert r.ends == np.cumsum([len(coder.decode_single_token_bytes(x)) for x in ids]).tolist()
    assert {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(tokens, bpe.ranks_path()).collect()} == dict(enumerate(CASES))


def test_offsets_that_do_not_fit_are_found(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four")], "doc_id long, text string")
    tokens = bpe.encode(docs, bpe.ranks_path())
    broken = tokens.selectExpr("doc_id", "ids", "transform(ends, (x, i) -> if(i = 1, x + 1, x)) as ends")
    assert bpe.decode(broken.drop("ends"), bpe.ranks_path()).count() == 2
    with pytest.raises(Exception, match="offsets do not fit"):
        bpe.decode(broken, bpe.ranks_path()).collect()
    whole = {r.doc_id: r.decoded_sha256 for r in bpe.encode_and_decode(docs, bpe.ranks_path()).collect()}
    assert whole == {1: hashlib.sha256(b"one two three").hexdigest(), 2: hashlib.sha256(b"four").hexdigest()}


def test_a_very_long_text(spark, coder):
    text = "lorem " * 60_000 + "x" * 30_000 + " \n" * 20_000
    r = bpe.round_trip(spark.createDataFrame([(1, text)], "doc_id long, text string"), bpe.ranks_path()).first()
    ids = coder.encode_ordinary(text)
    assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
    assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), bpe.ranks_path()).count() == 0

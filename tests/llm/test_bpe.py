import os

import pytest

from delvestone.llm import bpe

PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")
ODD = [
    "", " ", "\n\n", "a", "the cat's hat", "  two  spaces ", "<|endoftext|>", "don't  we'll\t\tI'd", "漢字かな交じり文", "x" * 900, "ab" * 700, " " * 500, "é̂", "​ \x85\x1c", "😀👩‍👩‍👧", "Ⅷ½²", "ſẞ", "a\x00b", "1234567890123", "-" * 450,
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


def test_equals_public_library(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    known = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Encoder(ranks)
    for text in ODD:
        assert own.encode(text) == known.encode_ordinary(text), text


def test_random_texts(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    st = pytest.importorskip("hypothesis.strategies")
    from hypothesis import given, settings

    known = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Encoder(ranks)

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60))
    def same(text):
        assert own.encode(text) == known.encode_ordinary(text)

    same()


def test_long_and_short_merge_agree(ranks):
    for word in (b"abcabc" * 30, "überraschung".encode() * 20, bytes(range(256))):
        assert bpe.merge_short(word, ranks) == bpe.merge_long(word, ranks)


def test_frame(spark, ranks):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world", "x"), (3, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")  # a clashing extra column
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_texts(df, "doc_id", "text", ranks).collect())
    assert got == [(1, []), (2, []), (3, [31373, 995]), (3, [31373, 995])]
    assert bpe.encode_texts(df.limit(0), "doc_id", "text", ranks).count() == 0

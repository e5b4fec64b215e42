import hashlib
import struct

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from kernelweave.llm import byte_bpe

LIBRARY = tiktoken.Encoding(
    "own",
    pat_str=P.PATTERN,
    mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")),
    special_tokens={},
)
TEXTS = [
    "",
    " ",
    "a",
    "Hello world, it's  spaced\n\n out \t",
    "naïve façade — 東京 👩‍👩‍👧 ßẞ",
    "x" * 3000,
    "don't  we'll\r\n  I'd 12345 67 !!??",
    "   odd\u0085space\u001c!",
    "<unk> <|endoftext|> ▁x",
    "a\x00b",
]


def packed(text):
    ids = LIBRARY.encode_ordinary(text)
    return struct.pack(f"<{len(ids)}I", *ids)


def test_same_ids_as_the_library():
    codec = byte_bpe.codec()
    for text in TEXTS:
        assert codec.encode(text) == packed(text), text
        assert codec.decode(codec.encode(text)) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x2FFF, exclude_categories=["Cn"]), max_size=60))
def test_any_text_comes_back(text):
    codec = byte_bpe.codec()
    assert codec.decode(codec.encode(text)) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tabT'é1.,-", max_size=40))
def test_spaces_like_the_library(text):
    assert byte_bpe.codec().encode(text) == packed(text)


def test_query(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(99, None), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS ids", "1 AS n_tokens")
    got = {r.doc_id: r for r in byte_bpe.digest(df).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        want = packed(text or "")
        assert got[k].n_tokens == len(want) // 4
        assert got[k].ids_sha256 == hashlib.sha256(want).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_one_pass_is_both_operators(spark):
    rows = [*enumerate(TEXTS), (50, "long text — " * 100_000), (50, "again"), (50, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: (r.doc_id, bytes(r.ids), r.n_tokens, bytes(r.decoded))
    got = sorted(map(key, byte_bpe.round_trip(df).collect()))
    assert got == sorted(map(key, byte_bpe.decode(byte_bpe.encode(df)).collect()))
    assert sorted(d for _, _, _, d in got) == sorted(t.encode() for _, t in rows)
    assert {i for k, i, _, _ in got if k == 50 and len(i) > 100} == {packed("long text — " * 100_000)}


def test_empty_table(spark):
    assert byte_bpe.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0

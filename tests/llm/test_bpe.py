import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pointlake.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec.of(bpe.model_json(bpe.read_ranks(PATH)))


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    return [i for own in codec.encode([text]) for x, _ in own for i in x]


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text_as_tiktoken(codec, other, text):
    assert ids(codec, text) == other.encode_ordinary(text)
    assert codec.decode(ids(codec, text)) == text.encode()
    assert "".join(codec.stream(ids(codec, text))) == text


def test_long_texts_are_cut_where_matches_end(codec, other):
    text = "It's  a <|endoftext|> 12 über \n\n\tthe 　end. " * 9000 + "x" * 70000
    assert len(bpe.pieces(text)) > 2 and "".join(bpe.pieces(text)) == text
    assert ids(codec, text) == other.encode_ordinary(text)


def test_frame(spark, other):
    rows = [(1, "a über 🎈", "x"), (2, None, "x"), (3, "", None), (3, "", None), (None, "b" * 100_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = bpe.encode(df)
    assert out.columns == ["doc_id", "text", "ids", "starts", "ends"]
    for row in out.collect():
        assert row.ids == other.encode_ordinary(row.text or "")
        assert all((row.text or "")[a:b] for a, b in zip(row.starts, row.ends))
    back = bpe.decode(out).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert bpe.decode(spark.createDataFrame([([1, 99999999],), (None,)], "ids array<int>")).where("decoded is not null").count() == 0
    assert bpe.digests(df.limit(0)).count() == 0


def test_whole_table(spark, other):
    got = {r.doc_id: r for r in bpe.op1_byte_bpe(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        want = other.encode_ordinary(d.text or "")
        assert got[d.doc_id].n_tokens == len(want)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()

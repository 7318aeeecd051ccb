import hashlib
import random

import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st

from encore.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(PATH)
PARTS = ["a", "th", "ing", " the", " ", "  ", "\n", "\r\n", "\t", "é", "ß", "漢字", "😀", "'s", "'", "9", "12", "!", "...", "\x1c", "\x85", "\xa0", "　", "́", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40).map("".join) | st.text(max_size=60))
def test_as_the_library(text):
    ids = ENCODER.encode(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert ENCODER.decode(ids) == text.encode()


def test_long_pieces():
    for text in ("a" * 20_000, "abc" * 5000, "the" * 5000):
        assert ENCODER.encode(text).tolist() == LIBRARY.encode_ordinary(text)


def test_appending_is_exact():
    p = bpe.Prefixes(ENCODER.vocabulary)
    text = b"internationalisationsanthathers"
    for i in range(len(text)):
        p.append(text[i : i + 1])
        assert p.ids() == bpe.Prefixes(ENCODER.vocabulary, text[: i + 1]).ids()
        assert b"".join(ENCODER.vocabulary.token[t] for t in p.ids()) == text[: i + 1]


def test_edits_are_exact_and_local():
    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice("abcdefghinost") for _ in range(2000)).encode()
        a = r.randrange(2000)
        b = min(2000, a + r.randrange(6))
        new = "".join(r.choice("abcst") for _ in range(r.randrange(6))).encode()
        p = bpe.Prefixes(ENCODER.vocabulary, text)
        done = p.replace(a, b, new)
        fresh = bpe.Prefixes(ENCODER.vocabulary, text[:a] + new + text[b:])
        assert (p.data, p.last) == (fresh.data, fresh.last)
        assert done <= 6 + 8 * ENCODER.vocabulary.longest


def test_documents(documents, odd_rows):
    got = bpe.encode(documents(odd_rows, extra=True), decoded=True).collect()
    assert len(got) == len(odd_rows)
    want = sorted([(d, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for d, t in odd_rows], key=repr)
    assert sorted([(g.doc_id, list(g.ids), bytes(g.decoded)) for g in got], key=repr) == want
    back = bpe.decode(bpe.encode(documents(odd_rows))).collect()
    assert sorted([bytes(b.decoded) for b in back]) == sorted((t or "").encode() for _, t in odd_rows)


def test_query_columns(spark):
    rows = bpe.op3_bpe_encode_decode(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_empty(documents):
    assert bpe.encode(documents([])).count() == 0
    with pytest.raises(KeyError):
        ENCODER.decode(__import__("numpy").array([10**6]))

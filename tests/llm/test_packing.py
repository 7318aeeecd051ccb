import random
import zlib
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from encore.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True
OWN = packing.WordTokenizer(PATH)
PARTS = ["a", "The", "É", "é", "́", ".", "!!", "'s", "'", "1", "²", "漢", "\x01", " ", "  ", "\n", "\x85", "\x1c", "<|endoftext|>", "_", "İ", "ß", "ﬁ", "-", "word,", "Ł", "ŉ", "ª", "à", "Œ", "µ", "ÿŸ", "İx"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=20).map("".join) | st.text(max_size=40))
def test_ids_as_the_library(text):
    assert OWN.encode(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def least_cost(ends, sentences, length):
    """The least cost over all choices of the same cut places, by plain recursion."""
    total = ends[-1]
    natural = sorted({0, total, *ends, *sentences})
    step = max(1, length // 8)
    places = set(natural)
    for a, b in zip(natural, natural[1:]):
        places |= set(range(a + step, b, step))
    powers = [1 << p for p in range(8, 30) if 1 << p <= length] or [length]
    places |= {total - p for p in powers if p < total}

    def price(c):
        inside = 0 if c in ends else packing.SENTENCE_CUT if c in sentences else packing.WORD_CUT
        return packing.WINDOW_COST + inside

    @cache
    def best(at):
        if at == 0:
            return 0
        out = min(best(c) + length - (at - c) for c in places if at - length <= c < at)
        out = min([out] + [best(at - p) for p in powers if at - p in places])
        return out + price(at)

    return best(total)


def cost_of(cuts, ends, sentences, length):
    powers = [1 << p for p in range(8, 30) if 1 << p <= length] or [length]
    total = 0
    for a, b in zip(cuts, cuts[1:]):
        assert 0 < b - a <= length
        total += 0 if b - a in powers else length - (b - a)
        total += packing.WINDOW_COST + (0 if b in ends else packing.SENTENCE_CUT if b in sentences else packing.WORD_CUT)
    return total


@pytest.mark.parametrize("length", [16, 64, 512])
def test_cuts_cost_least(length):
    r = random.Random(length)
    for _ in range(25):
        ends = np.cumsum([r.randint(1, r.choice([5, length, 2 * length])) for _ in range(r.randint(1, 8))])
        total = int(ends[-1])
        sentences = sorted(r.sample(range(1, total + 1), min(total, r.randint(0, 12))))
        cuts = packing.cuts(ends, np.array(sentences, dtype=np.int64), length)
        assert cuts[0] == 0 and cuts[-1] == total
        e, s = set(ends.tolist()), set(sentences)
        assert cost_of(cuts, e, s, length) == least_cost(tuple(ends.tolist()), s, length)


def check_pieces(rows, texts):
    """Every id of every document lies in exactly one piece; sequences are gapless."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = tokens = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.LENGTH
        padding += packing.padding(at, packing.LENGTH)
        tokens += at
    return padding / tokens


def test_whole_table(spark):
    rows = packing.op4_packing(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert check_pieces(rows, {d.doc_id: d.text for d in docs}) < 0.02


def test_odd_rows(documents, odd_rows):
    from pyspark.sql import functions as F

    rows = packing.pack(documents(odd_rows, extra=True)).withColumn("ids_crc32", F.crc32("ids")).collect()
    once = [r for r in rows if r.doc_id not in (5, None)]
    assert sum(r.length for r in rows if r.doc_id is None) == rows[[r.doc_id for r in rows].index(None)].doc_tokens
    assert sum(r.length for r in rows if r.doc_id == 5) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 5)
    texts = {d: t for d, t in odd_rows if d not in (5, None)}
    for doc_id, text in texts.items():
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
        mine = sorted([r for r in once if r.doc_id == doc_id], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == np.array(ids, dtype="<u4").tobytes()


def test_empty(documents):
    assert packing.pack(documents([])).count() == 0

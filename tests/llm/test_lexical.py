import math
import re
from collections import Counter

import pytest

from encore.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, Counter(t), len(t)) for i, t in found if t]
    n_docs, length = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in found:
            m = 100 - 75 + (75 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture
def frames(spark):
    def make(docs, items, parts=3):
        d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as term", "1 as n", "2 as rid").repartition(parts)
        return d, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'y' as doc_id", "3 as rid")

    return make


def got(d, i, **kw):
    return sorted((tuple(r) for r in lexical.search(d, i, **kw).select("item_id", "rank", "doc_id", "score").collect()), key=str)


WORDS = ["alpha", "Beta", "gamma", "größe", "漢字", "x1", "the", "THE", "and", "zeta", "Ω", "ß"]


def random_rows(seed, n, longest):
    import random

    r = random.Random(seed)
    return [(i, r.choice([" ", ", ", "-", "\n", "_"]).join(r.choices(WORDS, k=r.randrange(1, longest)))) for i in range(n)]


@pytest.mark.parametrize("block,cells,postings", [(200_000, 500_000, 1_000_000), (20, 40, 30)])
def test_against_brute_force(frames, monkeypatch, block, cells, postings):
    for name, value in (("BLOCK_TERMS", block), ("CELLS", cells), ("POSTINGS", postings)):
        monkeypatch.setattr(lexical, name, value)
    docs = random_rows(1, 120, 30)
    docs += [(500 + i, docs[3][1]) for i in range(40)] + [(3, docs[3][1]), (3, docs[3][1])]  # copies, repeated rows
    items = random_rows(2, 12, 9) + [(4, "alpha"), (4, "alpha alpha"), (None, "gamma")]
    assert got(*frames(docs, items)) == brute(docs, items)
    assert got(*frames(docs, items, 1), k=3) == brute(docs, items, 3)


def test_odd_rows(frames, odd_rows):
    docs = [r[:2] for r in odd_rows]
    items = [(1, None), (2, ""), (3, "words LONG größe"), (4, "!!!"), (5, "x" * 50_000), (6, "nowhere"), (7, "😀 text " * 3000)]
    assert got(*frames(docs, items)) == brute(docs, items)


@pytest.mark.parametrize("docs,items", [([], []), ([], [(1, "a")]), ([(1, "a")], []), ([(1, None), (2, ",")], [(1, "a")])])
def test_empty(frames, docs, items):
    assert got(*frames(docs, items)) == []


def test_chunks_of_a_long_text(monkeypatch):
    text = ("Ab c-dé " * 500 + "z" * 300 + " tail").encode()
    whole = lexical.term_counts(text)
    monkeypatch.setattr(lexical, "CHUNK", 7)
    assert lexical.term_counts(text) == whole == Counter(t.encode() for t in terms(text.decode()))


def test_sums_beyond_doubles(frames, monkeypatch):
    """Items of so many equal terms that the sums leave the whole numbers a double holds."""
    docs = [(i, "alpha beta " * (i + 1) + "gamma " * (50 - i)) for i in range(40)] + [(99, "delta")]
    items = [(0, "alpha gamma beta " * 400_000)]
    assert got(*frames(docs, items)) == brute(docs, items)

import hashlib
import random

import pytest

from encore.llm import exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        out += [(i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_against_brute_force(documents, counters):
    r = random.Random(counters)
    rows = [(i, r.choice(["hot", "hot", "hot", "warm", f"t{r.randrange(40)}", f"u{i}"])) for i in range(400)]
    got = exact_dedup.exact_groups(documents(rows).repartition(5), counters=counters).collect()
    assert sorted([(g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got], key=repr) == brute(rows)
    assert all(g.kept == (g.doc_id == g.keep_id) for g in got)


def test_odd_rows(documents, odd_rows):
    got = exact_dedup.exact_groups(documents(odd_rows, extra=True)).collect()
    assert sorted([(g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got], key=repr) == brute(odd_rows)
    kept = [g for g in got if g.kept]
    assert len(kept) == len({t or "" for _, t in odd_rows})  # one row of each text, of the repeated row too
    left = exact_dedup.keep_one(documents(odd_rows, extra=True))
    assert left.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "rid" in left.columns
    assert left.count() == len(kept)


def test_empty(documents):
    assert exact_dedup.exact_groups(documents([])).count() == 0


def test_misra_gries_finds_every_heavy_value():
    r = random.Random(5)
    for k in (1, 2, 7):
        values = [r.choice("aaaabbbccd") if r.random() < 0.7 else str(r.random()) for _ in range(3000)]
        kept = exact_dedup.misra_gries(iter([values[i : i + 100] for i in range(0, 3000, 100)]), k)
        assert len(kept) <= k
        for v in set(values):
            if values.count(v) > 3000 / (k + 1):
                assert v in kept and values.count(v) - 3000 / (k + 1) <= kept[v] <= values.count(v)


def test_frequent_bounds_its_rows_and_misses_none(spark):
    rows = [(f"h{i % 3}" if i % 2 else f"u{i}").encode() for i in range(2000)]
    df = spark.createDataFrame([(bytearray(v),) for v in rows], "digest binary").repartition(7)
    got = {bytes(r.digest) for r in exact_dedup.frequent(df, "digest", 20).collect()}
    assert {b"h0", b"h1", b"h2"} <= got and len(got) <= 21

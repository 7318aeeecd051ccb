import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from encore.llm import suffix_dedup as sd


def brute(texts, length, keep):
    """``(n_bytes, spans, kept)`` per text, from every window's places."""
    places = defaultdict(list)
    for t, text in enumerate(texts):
        for i in range(len(text) - length + 1):
            places[text[i : i + length]].append((t, i))
    out = []
    for t, text in enumerate(texts):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            p = places[text[i : i + length]]
            if len(p) > 1 and (keep == "none" or p[0] != (t, i)):
                gone[i : i + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(text), spans, bytes(b for b, g in zip(text, gone) if not g)))
    return out


def texts(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(1, 5)))
    shared = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(3)]
        if r.random() < 0.7:
            parts.insert(1, r.choice(shared)[r.randint(0, 20) :])
        if r.random() < 0.1:
            parts.append(r.choice(["a", "ab", "é"]) * r.randint(1, 90))
        out.append(" ".join(parts))
    return out + out[:5]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("length", [12, 30])
@pytest.mark.parametrize("hot", [4096, 1])
def test_against_brute_force(documents, monkeypatch, keep, length, hot):
    monkeypatch.setattr(sd, "BATCH_CONTENTS", hot)  # 1: every key of several contents by window hashes
    rows = list(enumerate(texts(length)))
    docs = documents(rows).coalesce(1)  # one partition: rows are numbered in this order
    got = {r.doc_id: r for r in sd.remove_repeats(docs, length=length, keep=keep).collect()}
    for (doc_id, _), (n, spans, kept) in zip(rows, brute([t.encode() for _, t in rows], length, keep)):
        g = got[doc_id]
        assert (g.n_bytes, [tuple(s) for s in g.spans], bytes(g.kept)) == (n, spans, kept)


def test_odd_rows(documents, odd_rows):
    got = sd.remove_repeats(documents(odd_rows, extra=True), length=40, keep="none").collect()
    want = [(d, *x) for (d, _), x in zip(odd_rows, brute([(t or "").encode() for _, t in odd_rows], 40, "none"))]
    assert sorted([(g.doc_id, g.n_bytes, [tuple(s) for s in g.spans], bytes(g.kept)) for g in got], key=repr) == sorted(want, key=repr)


def test_window_ranks_and_factors():
    r = random.Random(2)
    for length in (1, 3, 8, 9, 20, 37):
        data = np.frombuffer("".join(r.choice("ab") for _ in range(400)).encode(), np.uint8)
        starts = np.arange(len(data) - length + 1)
        rank = sd.window_ranks(data, starts, length)
        pieces = [data[i : i + length].tobytes() for i in starts]
        order = {p: i for i, p in enumerate(sorted(set(pieces)))}
        assert np.array_equal(np.unique(rank, return_inverse=True)[1], [order[p] for p in pieces])
        earlier, later = sd.longest_previous_factors(rank, starts)
        assert earlier.tolist() == [p in pieces[:i] for i, p in enumerate(pieces)]
        assert later.tolist() == [p in pieces[i + 1 :] for i, p in enumerate(pieces)]


def test_long_texts_are_scanned_whole_in_chunks(monkeypatch):
    monkeypatch.setattr(sd, "CHUNK", 50)
    r = random.Random(1)
    values = ["".join(r.choice("abc") for _ in range(n)).encode() for n in (0, 5, 20, 49, 50, 51, 69, 70, 400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(values))), pa.array(values, pa.binary())], ["rid", "text"])
    seen = defaultdict(list)
    for data, ends, row, shift in sd.runs_of_text(batch, 20):
        start, n, key, content = sd.zones(data, ends, 20, 6)
        begin = np.concatenate([[0], ends[:-1]])
        for s, k in zip(start.tolist(), n.tolist()):
            which = int(np.searchsorted(ends, s, side="right"))
            seen[int(row[which])] += [s - begin[which] + shift[which] + i for i in range(k)]
    for i, v in enumerate(values):
        assert sorted(seen[i]) == list(range(max(0, len(v) - 19)))


def test_query_on_a_table(spark):
    rows = sd.op9_suffix_dedup(spark, "/root/testdata/sf0.001").collect()
    docs = sorted((d.doc_id, (d.text or "").encode()) for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    want = {d: x for (d, _), x in zip(docs, brute([t for _, t in docs], 200, "none"))}
    assert len(rows) == len(docs)
    for r in rows:
        n, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, n - len(kept), len(spans))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_empty(documents):
    assert sd.remove_repeats(documents([])).count() == 0
    with pytest.raises(ValueError):
        sd.remove_repeats(documents([]), keep="last")


def test_a_batch_is_sorted_in_little_memory():
    """Six Python workers of an executor sort a batch each, beside its heap."""
    import tracemalloc

    r = np.random.default_rng(1)
    pieces = [r.integers(97, 101, 270, dtype=np.uint8).tobytes() for _ in range(sd.BATCH_BYTES // 270 + 1)]
    pieces[5] = pieces[9]
    tracemalloc.start()
    out = sd.judge(pieces, np.arange(len(pieces)), np.zeros(len(pieces), np.int64), 200)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i for i, (_, any_) in enumerate(out) if any_] == [5, 9] and out[5][0] == [] and out[9][0] == [(0, 71)]
    assert most < 80 << 20, most

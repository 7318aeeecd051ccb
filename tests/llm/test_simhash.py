import random

import numpy as np
import xxhash

from encore.llm import simhash


def brute_fingerprint(text, shingle=4):
    words = bytes((text or ""), "utf-8").lower().split()
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, bits=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_words_one_bit_apart_share_an_index():
    table = simhash.golay_indices()
    word = np.arange(1 << 16)
    for bit in range(16):
        other = table[word ^ (1 << bit)]
        assert (table[:, :, None] == other[:, None, :]).any(axis=(1, 2)).all()


def test_fingerprints_up_to_four_bits_apart_share_a_key():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * 2 + rng.integers(0, 2, 4000, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 5, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    keys, row = simhash.golay_keys(np.concatenate([a, b]))
    held = {}
    for k, r in zip(keys.tolist(), row.tolist()):
        held.setdefault(r, set()).add(k)
    assert all(held[i] & held[i + len(a)] for i in range(len(a)))


def test_fingerprint_is_the_definition():
    r = random.Random(1)
    for n in (0, 1, 3, 4, 5, 40, 700):
        text = " ".join(r.choice(["The", "ÉTÉ", "a", "b\x0bc", "x\x1cy", "ß"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_components_against_all_pairs(documents, spark, monkeypatch):
    r = random.Random(9)
    fps = []
    for _ in range(12):  # clusters: chains and clouds around a centre
        f = r.getrandbits(64)
        for _ in range(r.choice([1, 5, 60])):
            fps.append(f)
            g = f
            for _ in range(r.randint(0, 5)):
                g ^= 1 << r.randrange(64)
            fps.append(g)
            f = g if r.random() < 0.3 else f
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(s,) for s in signed], "fp long").groupBy("fp").agg(F.count("*").alias("n"))
    from encore.llm.common import components

    got = {x.node: x.root for x in components(simhash.links(df)).collect()}
    want = brute_components(fps)
    groups = {}
    for f, root in want.items():
        groups.setdefault(root, set()).add(f - (1 << 64) if f >> 63 else f)
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_documents(documents, odd_rows):
    rows = odd_rows + [(20 + i, "alpha beta gamma delta " * 30 + f"tail{i}") for i in range(6)]
    got = simhash.near_groups(documents(rows, extra=True)).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    want = brute_components(fps)
    least = {}
    for (doc_id, _), f in zip(rows, fps):
        if doc_id is not None:
            least[want[f]] = min(least.get(want[f], doc_id), doc_id)
    expect = sorted([(d, format(f, "016x"), least.get(want[f])) for (d, _), f in zip(rows, fps)], key=repr)
    assert sorted([(g.doc_id, g.fingerprint, g.component_id) for g in got], key=repr) == expect
    left = simhash.keep_one(documents(rows, extra=True))
    assert left.count() == len(set(want.values()))


def test_empty(documents):
    assert simhash.near_groups(documents([])).count() == 0

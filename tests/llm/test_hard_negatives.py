import math

import numpy as np
import pytest

from encore.llm import hard_negatives as hn


def brute(rows, anchors, n_pos=5, n_neg=10, low=30, high=90):
    def good(rows):
        for i, label, v in rows:
            if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
                yield i, label, [math.floor(256 * x) for x in v]

    rows, out = list(good(rows)), []
    for a, label, v in good(anchors):
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in rows if len(w) == len(v)]
        positives = sorted(s for s in scored if s[2] == label and s[1] != a)[:n_pos]
        for p, pid, _ in positives:
            negatives = sorted(s for s in scored if s[2] != label and -low * p <= -100 * s[0] <= -high * p)[:n_neg]
            out += [(a, pid, rank, i, -p, -s) for rank, (s, i, _) in enumerate(negatives, 1)]
    return sorted(out)


@pytest.fixture
def frame(spark):
    return lambda rows, kind="double": spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").selectExpr(
        "*", "'x' as id", "'x' as vec", "'x' as rid", "'x' as part", "'x' as dim"
    )


def got(rows, anchors, **kw):
    out = hn.mine(rows, anchors, **kw)
    return sorted(map(tuple, out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def made(seed, n, dim, labels=4, spread=1.0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=dim)
    return [(i, int(rng.integers(labels)), (centre + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("seed,sizes", [(1, (30, 2, 4)), (2, (2048, 16, 256))])
def test_against_brute_force(frame, monkeypatch, seed, sizes):
    for name, value in zip(("CELL_ROWS", "BAND", "BLOCK_ROWS"), sizes):
        monkeypatch.setattr(hn, name, value)
    rows = made(seed, 300, 9)
    rows += [(400 + i, rows[i % 4][1], rows[i % 4][2]) for i in range(40)]  # ties
    rows += [(500 + i, 7, rows[5][2]) for i in range(120)]  # one label with many copies
    rows += [(10, 1, rows[10][2]), (20, 2, rows[21][2])]  # repeated ids
    anchors = [r for r in rows if r[0] % 10 == 0]
    want = brute(rows, anchors)
    assert len(want) > 500
    assert got(frame(rows).repartition(5), frame(anchors)) == want


def test_rows_that_take_no_part(frame):
    nan, inf = float("nan"), float("inf")
    good = made(3, 40, 2, labels=2)
    odd = [(100, 0, None), (101, 0, []), (102, 0, [nan, 1.0]), (103, 1, [inf, 1.0]), (104, 1, [None, 1.0]), (105, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (106, 1, [1.0, 1.0, 1.0]), (107, 0, [0.0, 0.0]), (108, 1, [-0.001, 0.0])]
    rows = good + odd
    assert got(frame(rows), frame(rows)) == brute(rows, rows)


def test_single_precision_and_few_rows(frame):
    rows = [(i, l, np.float32(v).astype(float).tolist()) for i, l, v in made(4, 12, 5)]
    assert got(frame(rows, "float"), frame(rows[:6], "float")) == brute(rows, rows[:6])


def test_empty(frame):
    assert got(frame([]), frame([])) == []
    assert got(frame([(1, 1, [1.0])]), frame([(1, 1, [1.0])])) == []


def test_query_needs_no_int_label(spark):
    rows = spark.createDataFrame([(i, str(l), v) for i, l, v in made(5, 60, 4)], "vec_id long, label string, embedding array<double>")
    assert got(rows.withColumn("label", rows.label.cast("int")), rows.where("vec_id % 10 = 0")) != []


@pytest.mark.parametrize("top", [1, 100, 1 << 20, 1 << 40, 1 << 70])
def test_packed_products_are_exact(top):
    rng = np.random.default_rng(8)
    x = np.array([[int(v * top) for v in row] for row in rng.uniform(-1, 1, (7, 11))], object)
    y = np.array([[int(v * top) for v in row] for row in rng.uniform(-1, 1, (23, 11))], object)
    if top < 1 << 62:
        x, y = x.astype(np.int64), y.astype(np.int64)
    want = np.clip(x.astype(object) @ y.astype(object).T, -hn.END, hn.END)
    assert (hn.Packed(y, x).products(x) == want).all()
    assert (hn.Packed(-abs(y), x).products(x) == np.clip(x.astype(object) @ -abs(y).astype(object).T, -hn.END, hn.END)).all()
    if top == 100:
        assert hn.Packed(y, x).fields > 2  # several rows in a word


def test_magnitudes_beyond_64_bits(frame):
    rows = [(i, i % 2, [x * 1e30 for x in v]) for i, _, v in made(6, 20, 3)] + [(50 + i, i % 2, v) for i, _, v in made(7, 20, 3)]
    anchors = rows[20:25]
    end = hn.END

    def clipped(row):
        return (*row[:4], min(end, max(-end, row[4])), min(end, max(-end, row[5])))

    # only ranges that lie inside 64 bits can be compared with the plain computation
    want = [r for r in map(clipped, brute(rows, anchors)) if abs(r[4]) < end]
    assert [r for r in got(frame(rows), frame(anchors)) if abs(r[4]) < end] == want

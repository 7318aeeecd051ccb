import numpy as np
import pytest

from encore.llm import neighbours


def brute(queries, rows, k):
    out = []
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q, v in queries:
        if (q, v) not in good:
            continue
        # added one after the other, as the operator does
        scored = []
        for i, w in good:
            if i != q and len(w) == len(v):
                s = 0.0
                for a, b in zip(v, w):
                    s += a * b
                scored.append((-s, i))
        for rank, (s, i) in enumerate(sorted(scored)[:k], 1):
            out.append((q, rank, i, -s))
    return sorted(out)


@pytest.fixture
def vectors(spark):
    return lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("k", [1, 5, 40])
def test_against_brute_force(vectors, monkeypatch, k):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 30)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(k)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(150)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(60)]  # ties
    rows += [(300 + i, [float(x) for x in rng.integers(-2, 3, 12)]) for i in range(30)]
    queries = [r for r in rows if r[0] % 10 == 0]
    got = neighbours.nearest(vectors(queries), vectors(rows).repartition(4), k=k).collect()
    assert sorted(map(tuple, got)) == brute(queries, rows, k)


@pytest.mark.parametrize("top", [20, 160, 300])
def test_magnitudes_far_apart(vectors, top):
    """Norms of such vectors overflow, and so may products."""
    rng = np.random.default_rng(top)
    rows = [(0, [1.0, 1.0, 0.0]), (1, [10.0**top, 1.0, 0.0]), (2, [1.0, 2.0, 0.0]), (3, [0.0, 10.0**top, 1.0]), (4, [-(10.0**-top), 0.5, 2.0])]
    scales = 10.0 ** rng.uniform(-top, top, 120)
    rows += [(10 + i, (s * rng.normal(size=3)).tolist()) for i, s in enumerate(scales)]
    if top < 100:
        rows += [(900, [10.0**top] * 3)]
    else:
        rows += [(900, [10.0 ** (top - 150), -(10.0 ** (top - 150)), 1.0])]
    queries = [r for r in rows if r[0] % 3 == 0 and max(map(abs, r[1])) < 10.0 ** (304 - top)]
    got = neighbours.nearest(vectors(queries), vectors(rows).repartition(3), k=6).collect()
    want = brute(queries, rows, 6)
    assert len(want) == 6 * len(queries) and sorted(map(tuple, got)) == want


def test_scores_that_are_no_number(vectors):
    rows = [(1, [1e200, 1e200]), (2, [1e200, -1e200]), (3, [1.0, 1.0]), (4, [1e200, -2e200])]
    got = neighbours.nearest(vectors([rows[0]]), vectors(rows), k=3).orderBy("rank").collect()
    assert [(r["vec_id"], str(r["score"])) for r in got] == [(2, "nan"), (4, "nan"), (3, "2e+200")]


def test_extra_columns_with_clashing_names(vectors):
    rows = vectors([(i, [1.0, float(i)]) for i in range(9)]).selectExpr("*", *[f"'x' as `{n}`" for n in ("id", "vec", "rid", "dim", "part", "cell", "score", "rank", "query_id")])
    assert neighbours.nearest(rows.where("vec_id = 3"), rows, k=2).select("vec_id", "score").collect() == [(8, 25.0), (7, 22.0)]


def test_vectors_that_take_no_part(vectors):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [3.0, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0]), (20, [5.0, 5.0])]
    queries = [r for r in rows if r[0] is not None and r[0] % 4 == 0]
    got = sorted(map(tuple, neighbours.nearest(vectors(queries), vectors(rows)).collect()))
    # the row with id 20 is there twice: both are queries and neither is a candidate of the other
    assert got == brute(queries, rows, 20)
    assert not [g for g in got if g[0] in (4, 8)]


def test_bounds_hold():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(40, 64)), rng.standard_cauchy(size=(50, 64))
    q, c = neighbours.Quantised(x), neighbours.Quantised(y)
    guess, off = neighbours.bounds(q, c, slice(0, 40))
    assert (np.abs(x @ y.T - guess) <= off).all()


def test_empty(vectors):
    assert neighbours.nearest(vectors([]), vectors([])).count() == 0
    assert neighbours.nearest(vectors([(1, [1.0])]), vectors([(1, [1.0])])).count() == 0

"""Operator 12 against brute force, and its bounds."""

import numpy as np
import pytest

from salesspark.llm import exact_search as X

SCHEMA = "vec_id long, embedding array<double>, chunk string, x int, d int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, 2) for i, v in rows], SCHEMA)


def plain(rows, every, k):
    sound = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows
             if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (qid, q) in enumerate(sound):
        if qid is None or qid % every:
            continue
        scores = [(-sum(x * y for x, y in zip(q, v, strict=False)), i is None, i or 0, i) for b, (i, v) in enumerate(sound) if b != a]
        out += [(qid, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(spark, rows, every=3, k=5, **more):
    got = X.top_k(table_of(spark, rows), lambda i: i % every == 0, k=k, **more)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("spread", [0.0, 3.0])
def test_many_chunks(spark, spread):
    """Isotropic and clustered vectors of different lengths of arrow, over many small chunks and batches."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 12)) * spread
    rows = [(i, (centres[i % 6] + rng.standard_normal(12) * rng.choice([0.2, 1.0])).tolist()) for i in range(900)]
    assert found(spark, rows, chunk_rows=64) == plain(rows, 3, 5)


def test_hard_rows(spark):
    rows = [(0, [1.0, -0.5]), (3, [1.0, -0.5]), (3, [1.0, -0.5]), (6, None), (9, [float("nan"), 1.0]), (12, [None, 1.0]), (15, []),
            (18, [0.0, 0.0]), (21, [2.0]), (None, [1.0, -0.5]), (24, [float("inf"), 0.0]), (27, [1e9, 1.0]), (30, [-0.001, 0.5, 7.0])]
    assert found(spark, rows) == plain(rows, 3, 5)
    assert found(spark, [(0, [1.0])]) == [] and found(spark, []) == [] and found(spark, [(0, None)]) == []
    large = [(0, [2.0 ** 21, 1 / 256]), (3, [2.0 ** 21, 2 / 256]), (4, [2.0 ** 21, 3 / 256])]
    assert found(spark, large) == plain(large, 3, 5)
    with pytest.raises(Exception, match="does not fit a long"):
        found(spark, [(0, [2.0 ** 40]), (3, [2.0 ** 40])])


def test_a_third_of_the_rows_is_one_vector(spark):
    rng = np.random.default_rng(9)
    same = rng.standard_normal(8).tolist()
    rows = [(i, same if i % 3 == 0 else rng.standard_normal(8).tolist()) for i in range(600)]
    assert found(spark, rows, every=50, chunk_rows=32) == plain(rows, 50, 5)


def test_bounds_leave_most_of_a_clustered_chunk_out():
    rng = np.random.default_rng(10)
    centres = rng.standard_normal((20, 16)) * 4
    x = np.floor(256 * (centres[np.arange(2000) % 20] + rng.standard_normal((2000, 16)) * 0.05))
    space = X.Space(16, float((x * x).sum(axis=1).max()), float(abs(x).max()), (x[:500] / 256).tolist(), 16)
    table, ids = space.to_pivots(x), list(range(2000))
    evaluated = 0
    for i in range(0, 2000, 100):
        q = x[i]
        hits, n = X.bounded_search(space, x, table, ids, q, space.asked_to_pivots(x[i:i + 1])[0], 5, None, skip=i)
        evaluated += n
        s = x @ q
        s[i] = -np.inf
        want = sorted(range(2000), key=lambda j: (-s[j], j))[:5]
        assert [h[0] for h in hits] == want
    assert evaluated < 0.6 * 20 * 2000

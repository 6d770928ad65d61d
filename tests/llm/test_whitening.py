import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.llm import whitening as W

VECTORS = "vec_id long, embedding array<double>, X string, N string, component string"


def usable(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) and abs(64 * c) < W.REACH for c in v)


def plain(rows, most=16):
    """n, S, exact covariance (as floats), and deviations by vec_id, by definition."""
    x = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if usable(v)]
    fit = sorted({tuple(v) for _, v in x})
    n, d = len(fit), len(fit[0])
    s = [sum(v[k] for v in fit) for k in range(d)]
    v = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in fit), n**3) for j in range(d)] for i in range(d)]
    return x, fit, n, s, np.array([[float(c) for c in row] for row in v])


def check(found, rows, most=16):
    x, fit, n, s, v = plain(rows)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(most, int((e > 1e-11 * e[0]).sum()))
    by = defaultdict(list)
    for r in found:
        by[r.vec_id].append(r)
    want = defaultdict(list)
    for i, vec in x:
        want[i].append(vec)
    assert {i: len(r) for i, r in by.items()} == {i: k * len(r) for i, r in want.items()}
    signs = {}
    for i, vecs in want.items():
        if len(vecs) > 1:
            assert {r.deviation for r in by[i]} == {sum((n * c - t) ** 2 for c, t in zip(vec, s)) for vec in vecs}
            continue
        y = [n * c - t for c, t in zip(vecs[0], s)]
        z = (np.array(y, float) / n) @ u[:, :k] / np.sqrt(e[:k])
        for r in by[i]:
            assert (r.n, int(r.deviation)) == (n, sum(c * c for c in y))
            assert abs(r.explained - e[r.component - 1] / e.sum()) <= 1e-9 * r.explained + 1e-15
            assert r.identity_error < 1e-8
            apart = np.abs(np.delete(e, r.component - 1) - e[r.component - 1]).min() if len(e) > 1 else e[0]
            if apart > 1e-6 * e[0]:
                w = z[r.component - 1]
                sign = signs.setdefault(r.component, math.copysign(1, w * r.whitened) if abs(w) > 1e-3 else 1) if abs(w) > 1e-3 else None
                assert abs(abs(w) - abs(r.whitened)) < 1e-6 and (sign is None or sign == math.copysign(1, w * r.whitened))


def test_query_against_exact_fractions(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = W.op12_whitening(spark, folder)
    assert dict(found.dtypes)["deviation"] == "bigint"
    check(found.collect(), rows)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], VECTORS)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    good = [(k, [float(c) for c in rng.normal(size=3) * (9, 1, 0.3)]) for k in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [nan, 1.0, 1.0]), (104, [inf, 0.0, 0.0]), (105, [1e300, 0.0, 0.0]), (107, [2.0**56, 0.0, 0.0]), (106, [-0.0, -1e-9, 0.5])]
    copies = [(7, good[7][1]), (None, good[3][1]), (200, good[0][1])]
    rows = good + odd + copies
    short = [(300, [1.0, 2.0])]
    check(W.whiten(frame(spark, rows + short), 2).collect(), rows, 2)
    check(W.whiten(frame(spark, rows[::-1]).repartition(7), 16).collect(), rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3])
def test_nothing_varies(spark, rows):
    assert W.whiten(frame(spark, rows)).collect() == []


def test_flat_dimensions_are_no_components(spark):
    rows = [(k, [float(k), 5.0, 2.0 * k]) for k in range(9)]
    found = W.whiten(frame(spark, rows)).collect()
    assert {r.component for r in found} == {1} and len(found) == 9
    check(found, rows)


@pytest.mark.parametrize("size", [1e7, 1e13, 3e16])
def test_large_deviations_are_exact(spark, size):
    rows = [(k, [k * size / 5 + 0.3, -k * k * size / 50, size * (k % 3) / 3]) for k in range(5)]
    x, _, n, s, _ = plain(rows)
    want = {i: sum((n * c - t) ** 2 for c, t in zip(v, s)) for i, v in x}
    rows = W.whiten(frame(spark, rows)).collect()
    found = {r.vec_id: r.deviation and int(r.deviation) for r in rows}
    assert found == {k: v if v < 10**38 else None for k, v in want.items()}
    assert max(want.values()) > 2**58 and all(r.identity_error < 1e-8 for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**61), 2**61), min_size=2, max_size=2), min_size=1, max_size=9))
def test_slices_and_outer_sums(rows):
    y = np.array(rows, np.int64)
    parts = [p.astype(np.int64).tolist() for p in W.sliced(y, 62)]
    assert [[sum(p[i][j] << 21 * k for k, p in enumerate(parts)) for j in range(2)] for i in range(len(rows))] == rows
    hi, lo = W.outer_sum(y, 62, np.zeros((2, 2)), np.zeros((2, 2)))
    for i in range(2):
        for j in range(2):
            exact = sum(r[i] * r[j] for r in rows)
            size = sum(abs(r[i] * r[j]) for r in rows)
            assert abs(int(hi[i, j]) + int(lo[i, j]) - exact) <= size * 2**-98 + 1


def test_small_variance_beside_a_large_one():
    """Double precision alone would lose the second eigenvalue."""
    v = np.array([[1e16, 1e8], [1e8, 2.0]], np.longdouble)
    e, x = W.components(v, 2)
    assert abs(float(e[1]) - 1.0) < 1e-2 and np.abs((v @ x - x * e)).max() < 1


def test_pairs_merge_without_loss():
    a, b = np.array([1e16]), np.array([1.0])
    hi, lo = W.add_pairs(a, b, np.array([-1e16]), np.array([2.0**-40]))
    assert float(hi[0]) + float(lo[0]) == 1 + 2.0**-40

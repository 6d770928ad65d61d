"""Offsets of curves against every offset by definition."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lineweave.operators import offsets as O

CURVE = st.lists(st.integers(-9, 9), min_size=1, max_size=14)


def plain(a, b, most, near):
    a, b = (np.array(v, float) - np.mean(v) for v in (a, b))
    a, b = (v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-9 else v * 0 for v in (a, b))
    by = {k: round(sum(a[i + k] * b[i] for i in range(len(b)) if 0 <= i + k < len(a)), 12) for k in range(-most, most + 1) if -len(b) < k < len(a)}
    best = max(by, key=lambda k: (by[k], -k))
    rest = [v for k, v in by.items() if abs(k - best) > near]
    return best, max(by[best], 0.0), max([0.0, *rest]) if by[best] > 0 else 0.0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(CURVE, CURVE), min_size=1, max_size=6), st.integers(0, 9), st.integers(0, 3))
def test_every_offset(pairs, most, near):
    got = O.best_lags([np.array(a, float) for a, _ in pairs], [np.array(b, float) for _, b in pairs], most, near)
    for (a, b), (lag, score, second) in zip(pairs, got):
        want = plain(a, b, most, near)
        assert abs(score - want[1]) < 1e-9 and abs(second - want[2]) < 1e-9 or abs(score - want[1]) < 1e-9 and lag != want[0]
        if want[1] > want[2] + 1e-9 and want[1] > 0:
            assert lag == want[0]


def test_shift_and_sign(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(size=300)
    late = np.concatenate((rng.exponential(size=20), x))
    beat = np.tile([5.0, 0, 0, 0, 1.0, 0, 0, 0], 40)
    rows = [(1, late.tolist(), x.tolist()), (2, x.tolist(), late.tolist()), (3, x.tolist(), rng.exponential(size=200).tolist()), (4, beat.tolist(), beat.tolist()), (5, None, x.tolist()), (6, [], [1.0]), (7, [2.0, 2.0], [1.0, 3.0]), (8, [1.0, None, 0.0, 7.0], [1.0, 0.0, 0.0, 7.0])]
    df = spark.createDataFrame([(i, "z", a, b) for i, a, b in rows], "id long, score_ string, x array<double>, y array<double>")
    got = {r.id: r for r in O.validated_links(df, "x", "y", 60, 3).collect()}
    assert (got[1].offset, got[1].verdict) == (20, "linked") and (got[2].offset, got[2].verdict) == (-20, "linked")
    assert got[3].verdict == "low" and (got[4].offset, got[4].verdict) == (0, "unclear")
    for i in (5, 6, 7):
        assert (got[i].offset, got[i].score, got[i].verdict) == (0, 0.0, "low")
    assert got[8].offset == 0 and got[8].score > 0.999
    assert O.best_offsets(df.limit(0), "x", "y", 5).collect() == []

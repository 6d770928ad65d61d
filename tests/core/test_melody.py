"""Notes from spans: by plain loops, and on small tracks."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lineweave.operators import melody as M

CURVE = st.lists(st.one_of(st.none(), st.floats(58, 64)), min_size=1, max_size=30)


def array(curve):
    return np.array([np.nan if v is None else v for v in curve])


@settings(max_examples=200, deadline=None)
@given(CURVE, st.data())
def test_change_point_counts_every_cut(curve, data):
    n = len(curve)
    first = data.draw(st.integers(0, n))
    at, until = data.draw(st.integers(first, n)), None
    until = data.draw(st.integers(at, n))
    a, b, reach = 60, 62, data.draw(st.integers(0, 6))
    got = M.change_point(array(curve), first, at, until, a, b, reach)
    lo, hi = max(first + 1, at - reach), min(until - 1, at + reach)
    if hi <= lo or sum(v is not None for v in curve[lo:hi]) < M.EVIDENCE:
        assert got == at
        return

    def agree(cut):
        closer = lambda v: abs(v - a) <= abs(v - b)
        return sum(v is not None and closer(v) == (k < cut) for k, v in zip(range(lo, hi), curve[lo:hi]))

    best = max(range(lo, hi + 1), key=lambda c: (agree(c), -c))
    assert got == (best if agree(best) - agree(at) >= M.BETTER else at)


def plain_runs(curve, step, shortest, pause, join, least):
    """Frame by frame."""
    voiced = [k for k, v in enumerate(curve) if v is not None]
    if len(voiced) < M.VOICED or len(voiced) < least * len(curve):
        return []
    runs = []
    for k in voiced:
        p = int(np.rint(curve[k]))
        if runs and runs[-1][0] == p and (k - runs[-1][2]) * step <= pause:
            runs[-1][2] = k
        else:
            runs.append([p, k, k])
    out = []
    for p, a, b in runs:
        if (b - a) * step >= shortest:
            if out and out[-1][0] == p and (a - out[-1][2]) * step <= join:
                out[-1][2] = b
            else:
                out.append([p, a, b])
    if not out and (voiced[-1] - voiced[0]) * step >= shortest:
        out = [[M.common_pitch(array(curve))[0], voiced[0], voiced[-1]]]
    return [tuple(x) for x in out]


@settings(max_examples=200, deadline=None)
@given(CURVE, st.integers(0, 5), st.integers(1, 4), st.integers(0, 6))
def test_runs_frame_by_frame(curve, shortest, pause, join):
    got = M.pitch_runs(array(curve), 1, shortest, pause, join, 0.2)
    assert [x[:3] for x in got] == plain_runs(curve, 1, shortest, pause, join, 0.2)
    assert all(0 < x[3] <= 1 for x in got)


@settings(max_examples=100, deadline=None)
@given(CURVE, st.lists(st.integers(0, 300), min_size=2, max_size=8))
def test_notes_never_overlap(curve, cuts):
    cuts = sorted(cuts)
    notes = M.span_notes(array(curve), list(zip(cuts, cuts[1:])), 10, 3, 80, {"shortest": 30, "pause": 20, "join": 20, "least": 0.1})
    for (_, s, e, _), (_, t, _, _) in zip(notes, notes[1:]):
        assert s <= e <= max(t, s + 10)


def test_small_tracks(spark):
    low, high = [60.1] * 10, [64.2] * 10
    spans = lambda *x: [{"s": a * 10_000, "e": b * 10_000} for a, b in x]
    rows = [
        (1, low + high, spans((0, 12), (12, 20))),  # the boundary moves to where the pitch changes
        (2, low + high, spans((0, 18), (18, 20))),  # out of reach, and the second is too short
        (3, low[:5] + [None] * 5 + high, spans((0, 10), (10, 20))),  # trimmed
        (4, low + high, spans((0, 10), (11, 20), (5, 5)) + [{"s": None, "e": 4}]),
        (5, None, spans((0, 9))),
        (6, low, None),
        (7, [60.0] * 30 + [None] * 3 + [62.0] * 30, spans((0, 63))),  # a long span has its own pitches
        (8, [], spans((0, 9))),
    ]
    df = spark.createDataFrame(rows, "song long, midi array<double>, spans array<struct<s: long, e: long>>")
    got = {}
    for r in M.notes_from_spans(df, 10_000, 6, 300_000).orderBy("song", "k").collect():
        got.setdefault(r.song, []).append((r.midi, r.s // 10_000, r.e // 10_000, round(r.confidence, 3)))
    assert got[1] == [(60, 0, 10, 1.0), (64, 10, 20, 1.0)]
    assert got[2] == [(60, 0, 18, 0.556)]
    assert got[3] == [(60, 0, 5, 0.5), (64, 10, 20, 1.0)]
    assert got[4] == [(60, 0, 10, 1.0), (64, 11, 20, 1.0)]
    assert [x[:3] for x in got[7]] == [(60, 0, 29), (62, 33, 62)]
    assert set(got) == {1, 2, 3, 4, 7}
    assert M.notes_from_spans(df.where(F.lit(False)), 10_000).collect() == []


def test_halves_of_semitones_go_away_from_zero():
    assert M.semitones(np.array([60.5, 61.5, -60.5, 60.49999999999999, 59.0])).tolist() == [61, 62, -61, 60, 59]
    assert M.common_pitch(np.array([60.5, 60.5, 60.5])) == (61, 3)

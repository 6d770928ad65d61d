"""Notes from the spans of syllables and a pitch curve.

A track is one row: song, midi (array of semitones, a frame each, null or nan where nothing is voiced) and
spans (array of (s, e) in order, in microseconds); frame n is at n * step.  Tracks meet no others and are
looked at a batch at a time.  A null curve or list has no notes; a span without a start or an end, or that
doesn't last, has none; of equally frequent pitches the lowest is taken; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineweave.operators.arrays import frames

NOTE = "k int, midi int, s long, e long, confidence double"
#: Voiced frames that a pitch needs, frames that a boundary needs, and how many more must agree before it moves.
VOICED, EVIDENCE, BETTER = 3, 4, 2


def semitones(midi: np.ndarray) -> np.ndarray:
    """The nearest whole ones, halves away from zero, as SQL's round has them."""
    whole = np.trunc(midi)
    return (whole + np.sign(midi) * (np.abs(midi - whole) >= 0.5)).astype(int)


def common_pitch(midi: np.ndarray) -> tuple[int, int] | None:
    """The semitone that most voiced frames have, and how many do."""
    voiced = midi[np.isfinite(midi)]
    if len(voiced) < VOICED:
        return None
    values, counts = np.unique(semitones(voiced), return_counts=True)
    k = int(counts.argmax())
    return int(values[k]), int(counts[k])


def change_point(midi: np.ndarray, first: int, at: int, until: int, a: int, b: int, reach: int) -> int:
    """The frame within reach of ``at`` that best parts frames nearer to pitch a from those nearer to b, strictly
    inside (first, until); ``at`` itself unless clearly more frames agree."""
    lo, hi = max(first + 1, at - reach), min(until - 1, at + reach)
    part = midi[lo:hi]
    voiced = np.isfinite(part)
    if hi <= lo or voiced.sum() < EVIDENCE:
        return at
    near = np.zeros(len(part), np.int64)
    near[voiced] = np.where(np.abs(part[voiced] - a) <= np.abs(part[voiced] - b), 1, -1)
    gain = np.concatenate(([0], np.cumsum(near)))  # agreeing frames, but for a constant
    best = int(gain.argmax())
    return lo + best if gain[best] - gain[at - lo] >= BETTER else at


def pitch_runs(midi: np.ndarray, step: int, shortest: int, pause: int, join: int, least: float) -> list[tuple[int, int, int, float]]:
    """(midi, first, last, confidence) of stable pitches in a long span: runs of one semitone with pauses of no
    more than pause, of shortest at least; neighbours of one pitch within join are one.  If none is stable,
    the most common pitch from the first voiced frame to the last."""
    at = np.flatnonzero(np.isfinite(midi))
    if len(at) < VOICED or len(at) < least * len(midi):
        return []
    notes = np.rint(midi[at]).astype(int)
    cut = np.flatnonzero((np.diff(notes) != 0) | (np.diff(at) * step > pause)) + 1
    runs = [(int(notes[x[0]]), int(at[x[0]]), int(at[x[-1]])) for x in np.split(np.arange(len(at)), cut)]
    found: list[tuple[int, int, int]] = []
    for pitch, a, b in runs:
        if (b - a) * step < shortest:
            continue
        if found and found[-1][0] == pitch and (a - found[-1][2]) * step <= join:
            found[-1] = (pitch, found[-1][1], b)
        else:
            found.append((pitch, a, b))
    if not found and (at[-1] - at[0]) * step >= shortest:
        found, notes = [(common_pitch(midi)[0], int(at[0]), int(at[-1]))], semitones(midi[at])
    inside = lambda a, b: notes[(at >= a) & (at <= b)]
    return [(p, a, b, float(np.mean(inside(a, b) == p)) * len(at) / len(midi)) for p, a, b in found]


def span_notes(midi: np.ndarray, spans: list[tuple[int, int]], step: int, snap: int, long: int | None, runs: dict) -> list[tuple[int, int, int, float]]:
    """(midi, s, e, confidence) of one track."""
    own = []
    for s, e in spans:
        if s is None or e is None or e <= s:
            continue
        i, j = max(-(-s // step), 0), min(-(-e // step), len(midi))
        if long is not None and e - s > long:
            parts = pitch_runs(midi[i:j], step, **runs)
            if parts:
                notes = [(p, (i + a) * step, (i + b) * step, c) for p, a, b, c in parts]
                notes[0] = (notes[0][0], s, notes[0][2], notes[0][3])
                own.append([notes, i, j, s, e])
                continue
        pitch = common_pitch(midi[i:j])
        if pitch:
            own.append([pitch[0], i, j, s, e])
    for x, y in zip(own, own[1:]):
        if isinstance(x[0], int) and isinstance(y[0], int) and x[2] == y[1] and x[0] != y[0]:
            at = change_point(midi, x[1], y[1], y[2], x[0], y[0], snap)
            if at != y[1]:
                x[2], x[4], y[1], y[3] = at, at * step, at, at * step
    out = []
    for pitch, i, j, s, e in own:
        if not isinstance(pitch, int):
            out += pitch
            continue
        found = common_pitch(midi[i:j])
        if found:
            last = i + int(np.flatnonzero(np.isfinite(midi[i:j]))[-1])
            e = min(e, (last + 1) * step)
            out.append((found[0], s, e if e > s else s + step, found[1] / (j - i)))
    return out


def notes_from_spans(tracks: DataFrame, step: int, snap: int = 6, long: int | None = 1_000_000, shortest: int = 80_000, pause: int = 120_000, join: int = 150_000, least: float = 0.15) -> DataFrame:
    """song, k, midi, s, e, confidence: a note for each span, with the pitch that it has most.  Where two spans
    meet and the pitch changes, the boundary moves by up to snap frames to where the curve changes; a note ends
    with the last voiced frame of its span.  Spans of over long give the stable pitches in them; None: never."""
    runs = {"shortest": shortest, "pause": pause, "join": join, "least": least}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            songs, rows = [], []
            for song, midi, spans in zip(*(batch.column(c).to_pylist() for c in ("song", "midi", "spans"))):
                curve = np.array([np.nan if v is None else v for v in midi or ()], float)
                notes = span_notes(curve, [(x["s"], x["e"]) for x in spans or () if x], step, snap, long, runs)
                songs += [song] * len(notes)
                rows += [(k, *n) for k, n in enumerate(notes)]
            names = [("k", pa.int32()), ("midi", pa.int32()), ("s", pa.int64()), ("e", pa.int64()), ("confidence", pa.float64())]
            yield pa.RecordBatch.from_pydict({"song": pa.array(songs, pa.int64()), **{n: pa.array([r[at] for r in rows], t) for at, (n, t) in enumerate(names)}})

    return tracks.select(F.col("song").cast("long").alias("song"), "midi", F.col("spans").cast("array<struct<s: bigint, e: bigint>>").alias("spans")).mapInArrow(run, f"song long, {NOTE}")


STEP, SNAP = 10_000, 3


def q_notes(spark, d):
    """Curves as pitches that go up by 2 every eight frames, low values unvoiced; spans of seven frames and a
    bit, every fourth a little shorter."""
    f = frames(spark, d)
    midi = F.transform("x", lambda v, i: F.when(v > -150_000, 60.0 + 2 * F.floor(i / 8) + v / 100_000))
    k = F.sequence(F.lit(0), F.lit(7))
    at = lambda n: n * 75_000 + (F.col("vec_id") * n % 4) * 3_000
    spans = F.transform(k, lambda n: F.struct(at(n).cast("long").alias("s"), (at(n + 1) - F.when(n % 4 == 3, 15_000).otherwise(0)).cast("long").alias("e")))
    rows = notes_from_spans(f.select(F.col("vec_id").alias("song"), midi.alias("midi"), spans.alias("spans")), STEP, SNAP, None)
    return rows.withColumn("confidence", F.round("confidence", 9))


#: f: frames; a: spans with frames; m: pitches; v: spans that have one, numbered; r: boundaries, one after the other.
NOTES_SQL = f"""f AS (SELECT vec_id AS song, i, CASE WHEN v > -150000 THEN 60 + 2 * (i // 8) + v / 100000.0::DOUBLE END AS midi FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda x: round(x::DOUBLE * 1000000)::BIGINT)) AS v FROM embeddings)),
a0 AS (SELECT vec_id AS song, n, n * 75000 + vec_id * n % 4 * 3000 AS s, (n + 1) * 75000 + vec_id * (n + 1) % 4 * 3000 - CASE WHEN n % 4 = 3 THEN 15000 ELSE 0 END AS e FROM embeddings, range(8) t(n)),
a AS (SELECT *, (s + {STEP - 1}) // {STEP} AS i, least((e + {STEP - 1}) // {STEP}, 64) AS j FROM a0 WHERE e > s),
m AS (SELECT song, n, p AS pitch FROM (SELECT a.song, a.n, round(midi)::BIGINT AS p, count(*) AS c, sum(count(*)) OVER (PARTITION BY a.song, a.n) AS voiced FROM a JOIN f ON f.song = a.song AND f.i >= a.i AND f.i < a.j AND midi IS NOT NULL GROUP BY 1, 2, 3) WHERE voiced >= {VOICED} QUALIFY row_number() OVER (PARTITION BY song, n ORDER BY c DESC, p) = 1),
v AS (SELECT a.*, pitch, row_number() OVER (PARTITION BY song ORDER BY n) AS k FROM a JOIN m USING (song, n)),
l AS (SELECT song, list(midi ORDER BY i) AS y FROM f GROUP BY 1),
r AS (SELECT song, k, n, i, j, s, e, pitch, NULL::BIGINT AS cut FROM v WHERE k = 1
UNION ALL SELECT song, k, n, coalesce(cut, i), j, CASE WHEN cut IS NOT NULL THEN cut * {STEP} ELSE s END, e, pitch, cut FROM (SELECT q.*, CASE WHEN j0 = i AND p0 <> pitch AND hi > lo AND len(list_filter(part, lambda z: z IS NOT NULL)) >= {EVIDENCE} AND gain[best] - gain[(i - lo + 1)::INT] >= {BETTER} THEN lo + best - 1 END AS cut FROM (SELECT *, list_position(gain, list_max(gain)) AS best FROM (SELECT *, list_transform(range(0, greatest(hi - lo, 0) + 1), lambda z: coalesce(list_sum(list_transform(part[1:z], lambda t: CASE WHEN t IS NULL THEN 0 WHEN abs(t - p0) <= abs(t - pitch) THEN 1 ELSE -1 END)), 0)) AS gain FROM (SELECT *, CASE WHEN hi > lo THEN y[lo + 1:hi] ELSE [] END AS part FROM (SELECT v.*, r.i AS i0, r.j AS j0, r.pitch AS p0, greatest(r.i + 1, v.i - {SNAP}) AS lo, least(v.j - 1, v.i + {SNAP}) AS hi, y FROM r JOIN v ON v.song = r.song AND v.k = r.k + 1 JOIN l ON l.song = v.song)))) q)),
w AS (SELECT r.song, r.k, r.i, coalesce(x.cut, r.j) AS j, r.s, coalesce(x.cut * {STEP}, r.e) AS e FROM r LEFT JOIN r x ON x.song = r.song AND x.k = r.k + 1),
z AS (SELECT w.song, w.k, p, c, voiced, last FROM (SELECT w.song, w.k, round(midi)::BIGINT AS p, count(*) AS c, sum(count(*)) OVER g AS voiced, max(max(f.i)) OVER g AS last FROM w JOIN f ON f.song = w.song AND f.i >= w.i AND f.i < w.j AND midi IS NOT NULL GROUP BY 1, 2, 3 WINDOW g AS (PARTITION BY w.song, w.k)) z JOIN w USING (song, k) WHERE voiced >= {VOICED} QUALIFY row_number() OVER (PARTITION BY w.song, w.k ORDER BY c DESC, p) = 1)"""
QUERIES = {
    "span_notes": (
        q_notes,
        f"WITH RECURSIVE {NOTES_SQL} SELECT song, (row_number() OVER (PARTITION BY song ORDER BY k) - 1)::INT AS k, p::INT AS midi, s, CASE WHEN least(e, (last + 1) * {STEP}) > s THEN least(e, (last + 1) * {STEP}) ELSE s + {STEP} END AS e, round(c / (j - i)::DOUBLE, 9) AS confidence FROM z JOIN w USING (song, k)",
    ),
}

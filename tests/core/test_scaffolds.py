"""The scaffold against a plain walk along a song, and by hand."""

import random

from lineweave.operators import scaffolds as S

LINES, LENGTHS = "song long, line long, s long, e long", "song long, whole long"


def plain(lines, anchors, whole, tolerance, gap, shortest, sung):
    """lines: (s, e) in order; anchors: {place: (s, e)}."""
    n, at, source, last = len(lines), {}, {}, None
    for i in sorted(anchors):
        a = anchors[i][0]
        if last is not None and a <= last:
            continue
        last, s = a, lines[i][0]
        near = s is not None and abs(s - a) <= tolerance
        at[i], source[i] = (s, "kept") if near else (a, "caption")
    if not at:
        return [(s, e, "kept") for s, e in lines]
    floor = 0
    for i in sorted(at):
        if at[i] < floor:
            at[i], source[i] = floor, "caption"
        floor = at[i]
    pinned = set(at)
    for i in range(n):
        if i in pinned:
            continue
        before = at[i - 1] if i else 0
        nxt = next((j for j in range(i, n) if j in pinned), n)
        first = next((j + 1 for j in range(i, -1, -1) if j in pinned), 0)
        lo = at[first - 1] if first else 0
        hi = at[nxt] if nxt < n else max(whole, lo + (nxt - first + 1) * shortest)
        s = lines[i][0]
        if s is not None and before + gap <= s <= hi - (nxt - i) * shortest:
            at[i], source[i] = s, "kept"
        else:
            at[i], source[i] = before + (hi - before) // (nxt - i + 1), "interp"
    out = []
    for i in range(n):
        cap = (at[i + 1] if i + 1 < n else max(whole, at[i] + shortest)) - gap
        e = {"kept": cap if lines[i][1] is None else min(lines[i][1], cap), "caption": min(max(anchors[i][1], at[i] + sung) if i in anchors else cap, cap), "interp": cap}[source[i]]
        out.append((at[i], max(e, at[i] + shortest), source[i]))
    return out


def run(spark, songs, tolerance, gap, shortest, sung):
    lines = [(k, i, *x) for k, (ls, _, _) in enumerate(songs) for i, x in enumerate(ls)]
    anchors = [(k, i, *x) for k, (_, a, _) in enumerate(songs) for i, x in a.items()]
    df = S.scaffold_plan(spark.createDataFrame(lines, LINES), spark.createDataFrame(anchors + anchors[:1], LINES), spark.createDataFrame([(k, w) for k, (_, _, w) in enumerate(songs)], LENGTHS), tolerance, gap, shortest, sung)
    got = {}
    for r in df.orderBy("song", "line").collect():
        got.setdefault(r.song, []).append((r.new_s, r.new_e, r.source))
    return got


def test_like_a_walk(spark):
    rng = random.Random(6)
    songs = []
    for _ in range(60):
        n = rng.randint(1, 12)
        lines = [(s, s + rng.randint(0, 60)) if (s := rng.randint(0, 900)) % 11 else (None, None) for _ in range(n)]
        if rng.random() < 0.6:
            lines.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        anchors = {i: (a := rng.randint(0, 900) if rng.random() < 0.4 else (lines[i][0] or 5) + rng.randint(-9, 9), a + rng.randint(0, 80)) for i in range(n) if rng.random() < 0.5}
        songs.append((lines, anchors, 1000))
    got = run(spark, songs, 10, 2, 5, 20)
    for k, (lines, anchors, whole) in enumerate(songs):
        assert got[k] == plain(lines, anchors, whole, 10, 2, 5, 20), songs[k]


def test_what_stays_and_what_moves(spark):
    stays = [(102, 120), (148, 165), (301, 320)], {0: (100, 130), 2: (300, 330)}, 450
    moves = [(102, 120), (550, 560), (301, 320)], {0: (100, 130), 2: (300, 330)}, 450
    trailing = [(50, 60), (None, None), (None, None)], {0: (50, 80)}, 350
    shared = [(50, 60), (55, 65), (400, 410)], {0: (200, 260), 1: (200, 260), 2: (400, 430)}, 600
    none = [(7, 9), (3, 4)], {}, 100
    got = run(spark, [stays, moves, trailing, shared, none], 10, 1, 5, 20)
    assert got[0] == [(102, 120, "kept"), (148, 165, "kept"), (301, 320, "kept")]
    assert got[1][1] == (201, 300, "interp")
    assert [x[0] for x in got[2]] == [50, 150, 250] and got[2][2] == (250, 349, "interp")
    assert got[3] == [(200, 260, "caption"), (300, 399, "interp"), (400, 410, "kept")]
    assert got[4] == [(7, 9, "kept"), (3, 4, "kept")]
    empty = S.scaffold_plan(spark.createDataFrame([], LINES), spark.createDataFrame([], LINES), spark.createDataFrame([], LENGTHS), 10)
    assert empty.collect() == []

"""Shown times by hand, and repeats against a plain loop."""

import random
from statistics import median

from pyspark.sql import functions as F

from lineweave.operators import shown as D

LINES = "song long, line long, text string, s long, e long"


def frame(spark, rows):
    return spark.createDataFrame(rows, LINES)


def readable(spark, lines, voice):
    rows = D.readable(frame(spark, lines), frame(spark, voice), 30, 1, 10, 5, 3).collect()
    return {r.line: (r.new_s, r.new_e) for r in rows}


def test_readable_times(spark):
    voice = [(1, 0, "", 0, 30), (1, 1, "", 62, 70), (1, 2, "", 100, 170), (1, 3, "", 203, 204)]
    lines = [
        (1, 1, "", 5, 20),  # the voice goes on to 30, then silence: 10 to read
        (1, 2, "", 60, 68),  # starts with the voice at 62, ends with it at 70, and 10 to read
        (1, 3, "", 95, 98),  # lasts 5 at least; voice follows within 10
        (1, 4, "", 110, 120),  # goes on with the voice by 30 at most
        (1, 5, "", 180, 181),  # to read, and so long enough
        (1, 6, "", 200, 205),  # too little would be left after the voice's start
        (1, 7, "", None, 3),
    ]
    got = readable(spark, lines, voice)
    assert got[1] == (5, 40) and got[2] == (62, 80) and got[3] == (95, 100) and got[4] == (110, 150) and got[5] == (180, 191) and got[6] == (200, 215)
    assert got[7] == (None, 3)
    meets = readable(spark, [(1, 1, "", 5, 20), (1, 2, "", 28, 40)], [(1, 0, "", 0, 100)])
    assert meets == {1: (5, 27), 2: (27, 70)}  # 27 is before the next line; a gap of 1 closes at its middle
    assert readable(spark, [], voice) == {} and readable(spark, [(2, 1, "", 0, 9)], voice) == {1: (0, 19)}


def plain(starts, factor, least, excess):
    starts = list(map(float, starts))
    for _ in starts:
        steps = [b - a for a, b in zip(starts, starts[1:])]
        m = median(steps)
        worst = max(range(len(steps)), key=lambda k: (steps[k], -k))
        if m <= least or steps[worst] <= factor * m or steps[worst] - m <= excess:
            break
        starts[worst + 1 :] = [t - (steps[worst] - m) for t in starts[worst + 1 :]]
    return [int(t // 1) for t in starts]


def test_repeats_like_a_loop(spark):
    rng = random.Random(8)
    rows, want, line = [], {}, 0
    for song in range(25):
        t = 0
        for text in ("a", "b ", " b", "", None):
            n = rng.randint(1, 7)
            starts = [t := t + rng.choice([10, 10, 11, 12, 30, 90]) for _ in range(n)]
            lines = list(range(line, line + n))
            rows += [(song, k, text, s, s + 4) for k, s in zip(lines, starts)]
            line += n
            want[song, text] = (lines, starts)
    got = {r.line: (r.new_s, r.new_e) for r in D.even_repeats(frame(spark, rows), 3, 1.5, 2, 3).collect()}
    expect = {}
    for song in range(25):
        a = want[song, "a"]
        b = [x + y for x, y in zip(want[song, "b "], want[song, " b"])]  # one text but for blanks
        for lines, starts in (a, b):
            if len(lines) >= 3:
                expect |= {k: (s, s + 4) for k, s in zip(lines, plain(starts, 1.5, 2, 3))}
    assert got == expect and any(got[k][0] != s for _, k, _, s, _ in rows if k in got)
    assert D.even_repeats(frame(spark, rows).where(F.lit(False))).collect() == []


def test_words_are_held_while_there_is_voice(spark):
    voice = frame(spark, [(1, 0, "", 0, 20), (1, 1, "", 22, 40), (1, 2, "", 70, 100)])
    rows = [
        (1, 1, 1, 0, 5, 200),  # up to the next word
        (1, 1, 2, 15, 18, 200),  # the voice goes on over a short gap to 40; held
        (1, 1, 3, 45, 50, 200),  # in silence: stays
        (1, 1, 4, 66, 68, 200),  # voice follows soon, up to 100, no more than 25
        (1, 1, 5, 90, 130, 200),  # ends in silence
        (1, 2, 1, None, 5, 9),
        (1, 3, 1, 96, 99, 102),  # what is silent before the line's end is short
    ]
    words = spark.createDataFrame(rows, "song long, line long, k long, s long, e long, line_e long")
    got = {(r.line, r.k): r.new_e for r in D.hold_sung(words, voice, 10, 25, 5).collect()}
    assert got == {(1, 1): 15, (1, 2): 40, (1, 3): 50, (1, 4): 90, (1, 5): 130, (2, 1): 9, (3, 1): 102}
    assert D.hold_sung(words.where(F.lit(False)), voice, 10, 25, 5).collect() == []


def test_next_region(spark):
    asks = spark.createDataFrame([(1, 5, "a"), (1, 10, "b"), (1, 11, "c"), (1, None, "d"), (2, 1, "e")], "song long, t long, n string")
    voice = frame(spark, [(1, 0, "", 8, 10), (1, 1, "", 12, 20), (1, 2, "", 12, None)])
    at = lambda after: {r.n: r.region and tuple(r.region) for r in D.next_region(asks, voice, after).collect()}
    assert at(False) == {"a": (8, 10), "b": (8, 10), "c": (12, 20), "d": None, "e": None}
    assert at(True) == {"a": (8, 10), "b": (12, 20), "c": (12, 20), "d": None, "e": None}
